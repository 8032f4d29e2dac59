"""Sequence packing: shortest-pack-first over the length histogram.

Each document becomes token ids plus an end id and is cut into pieces of at
most ``capacity`` ids. The histogram of piece lengths (at most ``capacity``
rows, whatever the corpus) goes to the driver, where lengths are placed longest
first: the pieces of a length go to the packs with the most room, whole groups
of equal packs at a time, so only counts of packing patterns change. The
patterns, again bounded by the capacity, are joined back to the pieces by
their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, ranked, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rows that one ranking window holds.
RANK_ROWS = 4096
#: Beyond these characters two Unicode versions may split a text differently.
_BEYOND_LATIN = re.compile("[^\x00-ɏ‐-‧€]")
#: White space in one run that tiktoken gets at most; its splitter panics at about 1,000,000.
SPACE_RUN = 100_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{SPACE_RUN},}}")


def encoder(path: str, specials_are_text: bool = False):
    """text -> ids, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    A byte-level BPE is the same function in tiktoken, which is four times as
    fast: its ranks are the ids in the file's vocabulary. Texts with characters
    beyond Latin, a long run of white space or the string of an added token,
    and any that it refuses, go through tokenizers itself. With
    ``specials_are_text`` a special token's string is split like any other text.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = specials_are_text
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def by_tokenizers(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    kind = spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type") == "BPE" and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
    if not plain:
        return by_tokenizers
    alphabet, codes, extra = set(ByteLevel.alphabet()), {}, 0
    for b in range(256):  # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        if chr(b) in alphabet:
            codes[chr(b)] = b
        else:
            codes[chr(256 + extra)] = b
            extra += 1
    added = spec.get("added_tokens", [])
    special = {x["content"] for x in added}
    # what the added tokens can be found by; one that is found in normalised or stripped text leaves its bare string in any case
    told = [x["content"].strip() for x in added if not (specials_are_text and x.get("special"))]
    apart = re.compile("|".join(map(re.escape, told))) if all(told) and told else None
    if not all(told):
        return by_tokenizers
    ranks = {bytes(codes[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    splits = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=splits, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _BEYOND_LATIN.search(text) or len(text) >= SPACE_RUN and _LONG_SPACE.search(text) or apart and apart.search(text):
            return by_tokenizers(text)
        try:
            return fast.encode_ordinary(text)
        except (ValueError, RuntimeError):
            return by_tokenizers(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, specials_are_text: bool = False) -> DataFrame:
    """Pieces of each document (doc_id, text): its ids and end_id, cut every ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, specials_are_text)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    rows.extend((doc, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first over {length: count}: (lengths of a pack, number of such packs)."""
    packs: dict[int, list[list]] = defaultdict(list)  # by the ids they hold: [lengths, count]
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        for held in sorted(packs):
            if held + length > capacity or not left:
                break
            while packs[held] and left:
                lengths, count = packs[held].pop()
                used = min(count, left)
                if count > used:
                    packs[held].append([lengths, count - used])
                grown.append((held + length, [(*lengths, length), used]))
                left -= used
        # a new pack is the shortest of all, so it takes this length until no more fits
        fit = capacity // length
        for lengths, count in ((fit, left // fit), (left % fit, 1)):
            if lengths and count:
                grown.append((lengths * length, [(length,) * lengths, count]))
        for held, pack in grown:
            packs[held].append(pack)
    return [(tuple(lengths), count) for held in sorted(packs, reverse=True) for lengths, count in packs[held]]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, packs, offset) of every run of equal lengths of every pattern."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in found:
        offset = 0
        for length, run in groupby(lengths):
            held = len(list(run))
            rows.append((length, rank[length], rank[length] + held * count - 1, sequence, count, offset))
            rank[length] += held * count
            offset += held * length
        sequence += count
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, specials_are_text: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is one piece, its end id alone.
    Repeated rows are packed each; a null doc_id stays null. The string of a
    special token in a text becomes that token's id, as the tokenizers library
    does by default; ``specials_are_text`` keeps it ordinary text. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = written(pieces(docs, tokenizer, end_id, capacity, specials_are_text), "pieces")
    counts = cut.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most capacity rows
    places = spark.createDataFrame(slots(patterns(histogram, capacity)), "length long, low long, high long, sequence long, packs long, first long")
    bounded = spark.createDataFrame(sorted(histogram.items()), "length long, n long")
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    rows = ranked(cut, "length", order, F.xxhash64("doc_id", "start", "ids_crc32"), bounded, RANK_ROWS, "rank")
    placed = rows.join(F.broadcast(places), (rows["length"] == places["length"]) & F.col("rank").between(F.col("low"), F.col("high")))
    at = F.col("rank") - F.col("low")
    offset = F.col("first") + rows["length"] * F.floor(at / F.col("packs"))
    return placed.select("doc_id", "start", rows["length"], "ids_crc32", "doc_tokens", (F.col("sequence") + at % F.col("packs")).alias("sequence_id"), offset.cast("long").alias("offset"))
