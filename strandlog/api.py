"""Archive: create, put, get, scan and delete domains kept as partitioned Parquet."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import domain_id, fits_inline, key_hash, stored_size
from .operators import chunks
from .operators.ordering import numbered
from .schemas import CHUNK_BYTES
from .sources.shared import claimed, removed, written


class DomainExists(ValueError):
    """A domain of that name is there."""


class InvalidDomain(ValueError):
    """No domain of that name is there."""


#: Options of a domain, and what they are without being given.
OPTIONS = {"nrepl": 3, "keycache": False, "noindex": False}


def checked(given: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """defaults with what is given, each as its default's type; ValueError for an unknown name or a value that is none.

    Numbers and flags may come as text: digits, or true, false, 1 and 0.
    """
    found = dict(defaults)
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"unknown option: {name}")
        text = str(value).lower()
        if isinstance(defaults[name], bool):
            if text not in ("true", "false", "1", "0"):
                raise ValueError(f"{name} is true or false, not {value!r}")
            found[name] = text in ("true", "1")
        elif not text.isdecimal():
            raise ValueError(f"{name} is a number from 0, not {value!r}")
        else:
            found[name] = int(text)
    return found


class Archive:
    """Domains under a path: a table of their chunks and a table of entries.

    Both are partitioned by a hash of the domain's name, entries also by chunk
    and sorted by key hash inside files, so a lookup reads one domain and skips
    most row groups. A chunk is full once it has more than ``chunk_bytes``; the
    next entry begins a new one. Several callers may create domains at a time;
    puts into one domain come one after the other.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.path, self.chunk_bytes = spark, path.rstrip("/"), chunk_bytes

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    @staticmethod
    def _mark(name: str) -> str:
        return hashlib.md5(name.encode()).hexdigest()

    def domains(self) -> DataFrame:
        """A row a chunk of each domain."""
        return self._read("domains", "domain_id string, name string, chunk int, nrepl int, keycache boolean, noindex boolean, mark string").drop("mark")

    def entries(self) -> DataFrame:
        return self._read("entries", "batch long, ord long, entry_id long, key string, value string, key_hash long, size long, domain string, mark string, chunk int")

    def _of(self, name: str) -> DataFrame:
        return self.entries().where(F.col("mark") == self._mark(name))

    def _options(self, name: str) -> dict | None:
        rows = self._read("domains", "name string, nrepl int, keycache boolean, noindex boolean, mark string").where(F.col("mark") == self._mark(name)).limit(1).collect()
        return {k: rows[0][k] for k in OPTIONS} if rows else None

    def _add_chunks(self, name: str, numbers: DataFrame, options: dict) -> None:
        """Adds domain rows for the chunks (chunk)."""
        rows = numbers.select(F.lit(name).alias("name"), F.col("chunk").cast("int").alias("chunk"), *[F.lit(options[k]).cast("int" if k == "nrepl" else "boolean").alias(k) for k in OPTIONS], F.lit(self._mark(name)).alias("mark"))
        rows = rows.select(domain_id(F.col("name"), F.col("chunk")).alias("domain_id"), *rows.columns)
        rows.coalesce(1).write.mode("append").partitionBy("mark").parquet(f"{self.path}/domains")

    def create(self, name: str, **options: Any) -> str:
        """Makes a domain and returns the id of its first chunk; DomainExists if the name is taken. Of callers at a time one succeeds."""
        found = checked(options, OPTIONS)
        if not claimed(self.spark, f"{self.path}/names/{self._mark(name)}"):
            raise DomainExists(name)
        self._add_chunks(name, self.spark.range(1).select(F.lit(0).alias("chunk")), found)
        return hashlib.md5(f"0 {name}".encode()).hexdigest()

    def delete(self, name: str) -> None:
        """Removes a domain with its entries; InvalidDomain if there is none."""
        if self._options(name) is None:
            raise InvalidDomain(name)
        mark = self._mark(name)
        for folder in (f"entries/mark={mark}", f"domains/mark={mark}", f"names/{mark}"):
            removed(self.spark, f"{self.path}/{folder}")

    def put(self, name: str, pairs: DataFrame, order: str) -> None:
        """Appends pairs (key, value) in the order of a column that is unique in them; keys that are too long are an error.

        Only the open chunk is looked at, whatever the domain holds.
        """
        options = self._options(name)
        if options is None:
            raise InvalidDomain(name)
        key, value = F.col("key").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit(""))
        fits = F.when(fits_inline(key), key).otherwise(F.raise_error(F.lit("key too large")).cast("string"))
        last = self._of(name).agg(F.max("chunk").alias("c")).first()["c"] or 0
        known = self._of(name).where(F.col("chunk") == last).agg(F.max("batch").alias("b"), F.sum("size").alias("s")).first()
        batch = (known["b"] or 0) + 1
        rows = numbered(pairs.select(F.col(order).alias("_by"), fits.alias("key"), value.alias("value")), ["_by"], "ord")
        rows = written(rows.select("ord", "key", "value", stored_size(F.col("key"), F.col("value")).alias("size")), "put")
        state = self.spark.createDataFrame([(name, last, known["s"], known["s"], -1)] if known["s"] else [], chunks.OPEN)
        # each entry is its own id here: pairs that repeat are entries of their own
        rolled = chunks.rolled_on(rows.select(F.lit(name).alias("domain"), "ord", F.col("ord").alias("entry_id"), "size"), state, self.chunk_bytes)
        rolled = written(rolled.where("not carried").select("ord", "chunk"), "chunks")
        full = rows.join(rolled, "ord").select(
            F.lit(batch).cast("long").alias("batch"), "ord", key_hash(F.concat_ws(" ", F.lit(name), F.lit(str(batch)), "ord")).alias("entry_id"),
            "key", "value", key_hash(F.col("key")).alias("key_hash"), "size", F.lit(name).alias("domain"), F.lit(self._mark(name)).alias("mark"), "chunk",
        )
        full.sortWithinPartitions("chunk", "key_hash").write.mode("append").partitionBy("mark", "chunk").parquet(f"{self.path}/entries")
        self._add_chunks(name, rolled.where(F.col("chunk") > last).select("chunk").distinct(), options)

    def get(self, name: str, key: str) -> DataFrame:
        """All values of a key in the order of their arrival, from all chunks; none for an unknown key or domain.

        A domain without an index is answered by a scan.
        """
        found = self._of(name).where(F.col("key") == key)
        if not (self._options(name) or OPTIONS)["noindex"]:
            found = found.where(F.col("key_hash") == key_hash(F.lit(key)))
        return found.orderBy("batch", "ord").select("value")

    def get_single(self, name: str, key: str) -> str:
        """The first value of a key; KeyError if there is none."""
        row = self.get(name, key).limit(1).first()
        if row is None:
            raise KeyError(key)
        return row["value"]

    def get_many(self, name: str, keys: DataFrame) -> DataFrame:
        """key, batch, ord, value of all requested keys (key): one join for all of them."""
        wanted = keys.select("key").distinct().withColumn("key_hash", key_hash(F.col("key")))
        return self._of(name).join(wanted, ["key_hash", "key"], "left_semi").select("key", "batch", "ord", "value")

    def scan(self, name: str) -> DataFrame:
        """The entries of a domain, chunk by chunk."""
        return self._of(name).drop("mark")
