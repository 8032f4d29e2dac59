"""Structured Streaming: chunk state and postings kept up to date as entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import key_hash
from ..operators import chunks, monitor
from ..schemas import CHUNK_BYTES
from ..sources.shared import written

CHUNKED = "domain string, ord long, chunk int, pos long"
#: Bytes of a log whose postings lie in one list.
SPAN = 1 << 26


def chunk_stream(entries: DataFrame, path: str, checkpoint: str, limit: int = CHUNK_BYTES):
    """Appends domain, ord, chunk, pos of a stream of entries (domain, ord, entry_id, size) to the table at path.

    Each batch is rolled as ``chunks.rolled`` does, in range-sorted blocks, so
    no task holds a domain; what it carries on is one row a domain. Entries of
    a batch are taken in the order of ord, and all of them after those of the
    batches before, also where their ord is smaller. An entry with the id of
    the entry before it is a repeated delivery and is dropped.
    """

    def add(batch: DataFrame, number: int) -> None:
        reader = batch.sparkSession.read.schema(chunks.OPEN)
        state = reader.parquet(f"{path}-open/batch={number - 1}") if number else batch.sparkSession.createDataFrame([], chunks.OPEN)
        found = written(chunks.rolled_on(batch, state, limit), "rolled")
        # a batch that is run again writes its own folders again
        found.where(~F.col("carried")).select("domain", "ord", "chunk", "pos").write.mode("overwrite").parquet(f"{path}/batch={number}")
        last = chunks.open_chunks(found)
        last.unionByName(state.join(last, "domain", "left_anti")).write.mode("overwrite").parquet(f"{path}-open/batch={number}")

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def posting_stream(entries: DataFrame, path: str, checkpoint: str):
    """Appends postings (domain, span, key_hash, batch, positions) of each batch to the table at path; a batch is an index segment.

    A list holds the positions of SPAN bytes, so a frequent key has many lists.
    """

    def add(batch: DataFrame, number: int) -> None:
        hashed = batch.select("domain", key_hash(F.col("key")).alias("key_hash"), F.floor(F.col("pos") / SPAN).alias("span"), "pos")
        found = hashed.groupBy("domain", "span", "key_hash").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        # a batch that is run again writes its own folder again
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_stream(samples: DataFrame, path: str, checkpoint: str, n: int) -> DataFrame:
    """The last n samples of each key (key, rank, id, ts, value) of a stream of samples (key, id, ts, value), after all that has arrived.

    Each batch is joined with what the batches before left, n rows a key.
    """

    def add(batch: DataFrame, number: int) -> None:
        found = monitor.recent(batch, n, ["id"])
        if number:
            held = batch.sparkSession.read.parquet(f"{path}/batch={number - 1}")
            found = monitor.recent(found.drop("rank").unionByName(held.drop("rank")), n, ["id"])
        # a batch that is run again writes its own folder again
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = samples.sparkSession
    try:
        found = spark.read.parquet(path)
    except AnalysisException:  # nothing has arrived yet
        return spark.createDataFrame([], samples.schema).withColumn("rank", F.lit(0))
    return found.where(F.col("batch") == found.agg(F.max("batch").alias("b")).first()["b"]).drop("batch")
