"""Mixing sources to target weights: weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and
with it, in shuffled order, divided by the source's target. All documents are
range-sorted by finish time and cut where their words reach the total budget,
so at each point of the sorted mix the sources stand in the ratio of their
targets. A source whose target exceeds its size goes round again, up to
``repeats`` times.

DataFrame functions only. No task sees a whole source: running sums are taken
over parts of a source and raised by the sums of the parts before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source in one running sum, about.
PART_ROWS = 2048
_HASH_RANGE = 1 << 32


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, lacks (source is null), place, n, source_size, target of each source.

    Sources stand in code point order, null last, and take the weights in turn.
    Targets share the sum of all sizes by weight. One that would exceed
    ``repeats`` times its source stops there, and the others share the rest:
    with sources in the order of size / weight, those stop whose limit lies
    below the level that the remaining ones would get.
    """
    found = sizes.groupBy("source", "lacks").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy("lacks", "source")
    placed = found.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("limit", repeats * F.col("source_size"))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(_before(filling)), F.lit(0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    levels = placed.withColumn("level", rest / open_weight)
    # levels rise while sources stop and fall from then on, so the highest that a source's limit reaches is the final one
    level = F.max(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("limit").cast("double"), F.col("weight") * level)
    return levels.select("source", "lacks", "place", "n", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """The mix of all docs (doc_id, text, source).

    Returns a row per input row: doc_id, size (words), source_size, target (of
    its source, in words), taken (words that the mix takes, repeats counted).

    The order within a source is that of md5(doc_id as text), so reruns agree.
    A null text has no words; rows without words take nothing. A null source is
    a source of its own; rows with a null doc_id are shuffled by their texts.
    Repeated rows are documents of their own. An empty table gives an empty
    result. Other columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("lacks"), size_of(F.col("text")).alias("size"), key.alias("key"))
    rows = written(rows, "sizes")
    goals = written(targets(rows, weights, repeats), "targets")

    parts = F.ceil(F.col("n") / PART_ROWS)
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts / F.lit(_HASH_RANGE))
    dealt = rows.join(goals, ["source", "lacks"]).withColumn("part", part)
    sums = dealt.groupBy("place", "part").agg(F.sum("size").alias("sum"))
    base = sums.select("place", "part", F.coalesce(F.sum("sum").over(_before(Window.partitionBy("place").orderBy("part"))), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = dealt.withColumn("own", F.sum("size").over(within)).join(base, ["place", "part"])
    queued = queued.select("doc_id", "size", "source_size", "target", "place", (F.col("base") + F.col("own")).alias("reached"))
    queued = written(queued, "queued")

    turns = F.sequence(F.lit(0), F.least(F.lit(repeats), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size")).cast("int"))) - 1)
    turned = queued.where("size > 0").select("size", "place", "target", "source_size", "reached", F.explode(turns).alias("turn"))
    total = F.col("reached") + F.col("turn") * F.col("source_size")
    timed = turned.select("size", "place", (total / F.col("target")).alias("finish"), total.alias("total"))
    by = ["finish", "place", "total"]
    spread = timed.repartitionByRange(*by).withColumn("block", F.spark_partition_id())
    spread = written(spread, "finish-times")  # later reads must see the same blocks
    blocks = spread.groupBy("block").agg(F.sum("size").alias("sum"))
    ahead = blocks.select("block", F.coalesce(F.sum("sum").over(_before(Window.orderBy("block"))), F.lit(0)).alias("ahead"))
    running = Window.partitionBy("block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = spread.withColumn("own", F.sum("size").over(running)).join(ahead, "block")
    budget = goals.agg(F.sum("source_size").alias("budget"))
    last = cumulated.join(F.broadcast(budget)).where(F.col("ahead") + F.col("own") <= F.col("budget")).agg(F.max(F.struct(*by)).alias("cut")).first()["cut"]  # one row

    cut = F.struct(*(F.lit(last[c] if last else None).cast(timed.schema[c].dataType).alias(c) for c in by))

    def taken(turn: int) -> Column:
        if last is None:
            return F.lit(0)
        reached = F.col("reached") + turn * F.col("source_size")
        inside = F.struct((reached / F.col("target")).alias("finish"), F.col("place"), reached.alias("total")) <= cut
        goes = (F.col("size") > 0) & (F.lit(turn) < F.size(turns))
        return F.when(goes & inside, 1).otherwise(0)

    copies = sum((taken(t) for t in range(1, repeats)), taken(0))
    return queued.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """The mixed rows of docs, with their columns: each as often as the mix takes it.

    Rows that share a doc_id are repeated alike, as the one taken most often.
    """
    decided = mixed(docs, weights, repeats).where("taken > 0").groupBy("doc_id").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("copies"))
    whole = docs.select(F.struct("*").alias("row"))  # one column, so that no name of docs can clash
    joined = whole.join(decided, F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS lacks,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents),
s AS (
  SELECT source, lacks, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY lacks, source) - 1 AS place
  FROM d GROUP BY source, lacks),
w AS (SELECT *, (place % 3 + 1)::BIGINT AS weight, 3 * source_size AS lim FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size)::BIGINT FROM w)
             - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM w),
t AS (
  SELECT *, least(lim::DOUBLE, weight * (SELECT max(level) FROM l WHERE lim / weight >= level)) AS target
  FROM l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         (sum(d.size) OVER (PARTITION BY t.place ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS reached
  FROM d JOIN t ON d.source = t.source AND d.lacks = t.lacks),
r AS (
  SELECT q.*, turn, reached + turn * source_size AS total, (reached + turn * source_size) / target AS finish
  FROM q, range(3) AS x(turn)
  WHERE size > 0 AND turn < greatest(1, ceil(target / source_size))),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, total ROWS UNBOUNDED PRECEDING) AS running FROM r),
k AS (SELECT place, reached, sum(size)::BIGINT AS taken FROM c WHERE running <= (SELECT sum(size) FROM d) GROUP BY place, reached)
SELECT q.doc_id, q.size, q.source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(k.taken, 0) ELSE 0 END AS taken
FROM q LEFT JOIN k ON q.place = k.place AND q.reached = k.reached
"""
