"""Point and bulk lookup: every value of a key, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import key_hash


def many(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries whose key is in keys (key): a semi-join, repeated keys count once."""
    return entries.join(keys.select("key"), "key", "left_semi")


def of_key(entries: DataFrame, key: str) -> DataFrame:
    """All entries of one key, in order; none for an unknown one."""
    return entries.where(F.col("key") == key).orderBy("domain", "pos")


def single(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """domain, key, value: the first value of each requested key in each domain. Map-side partial minima, no sort."""
    found = many(entries, keys).groupBy("domain", "key").agg(F.min_by("value", "pos").alias("value"))
    return found.select("domain", "key", "value")


def via_index(entries: DataFrame, postings: DataFrame, keys: DataFrame) -> DataFrame:
    """The same as ``many``, by way of an index: hashes to positions to entries, whose keys are compared again."""
    hashes = keys.select(key_hash(F.col("key")).alias("key_hash")).distinct()
    at = postings.join(hashes, "key_hash", "left_semi").select("domain", F.explode("positions").alias("pos")).distinct()
    return many(entries.join(at, ["domain", "pos"], "left_semi"), keys)


def at(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (domain, pos) with entry_id, key, value of the entry that begins exactly there, and reply: ok, or invalid_entry if none does."""
    found = entries.select("domain", "pos", "entry_id", "key", "value", F.lit("ok").alias("_reply"))
    joined = asked.select("domain", "pos").join(found, ["domain", "pos"], "left")
    return joined.select("domain", "pos", "entry_id", "key", "value", F.coalesce("_reply", F.lit("invalid_entry")).alias("reply"))
