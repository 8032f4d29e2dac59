"""Line-first cleaning: rules judge single lines, then the loss judges the document.

Lines that fail a punctuation, navigation or boilerplate rule are removed. A
document that loses more than half of its words that way is rejected; so is
one that fails the base statistics (too few words, or too many of them in
windows that repeat).

Boilerplate is learned from the corpus: a line of up to ``MAX_BOILERPLATE_WORDS``
words that stands between many different pairs of lines. Copies of a document
have it between the same two, so a text that is copied often is none. Phrases
of page furniture in the corpus's languages count too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Text, blocks, windows

# Limits of the rules.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MIN_UNENDED_WORDS = 8  # a line without end punctuation needs so many words
MAX_SYMBOLS_A_WORD = 0.25
MAX_MARKS_A_WORD = 0.4  # exclamation and question marks
MIN_SEPARATORS = 3
MIN_SEPARATOR_SHARE = 0.2
MAX_BOILERPLATE_WORDS = 40
MAX_LOST_SHARE = 0.5
# A line is boilerplate from this share of all documents on, in different contexts, and from this number at least.
BOILERPLATE_SHARE = 0.001
MIN_CONTEXTS = 10
# Characters of scripts without spaces, of which two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")

SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset(x.encode() for x in ("|", "||", "/", ">", ">>", "»", "›", "•", "·", "*", "-", "–", "—", "::", "→"))
ENDINGS = tuple(x.encode() for x in (".", "!", "?", ":", ";", '"', "'", ")", "]", "…", "”", "’", "»", "。", "！", "？", "」", "؟", "।"))
# Phrases of page furniture, lower case.
BOILERPLATE = (
    # English
    "accept all cookies", "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "follow us on", "forgot your password", "log in to", "lorem ipsum", "powered by",
    "privacy policy", "read more", "share on facebook", "share this", "sign in to", "sign up for", "skip to content",
    "subscribe to our", "terms of service", "terms of use", "this site uses cookies", "use of cookies", "we use cookies",
    # German
    "alle rechte vorbehalten", "cookies akzeptieren", "diese website verwendet cookies", "jetzt anmelden", "klicken sie hier",
    "mehr erfahren", "nach oben", "newsletter abonnieren", "passwort vergessen", "weiterlesen", "zum inhalt springen",
    # French
    "accepter les cookies", "cliquez ici", "conditions d'utilisation", "haut de page", "lire la suite", "mot de passe oublié",
    "nous utilisons des cookies", "partager sur facebook", "suivez-nous sur", "tous droits réservés",
    # Spanish
    "aceptar cookies", "compartir en facebook", "haga clic aquí", "iniciar sesión", "leer más", "olvidaste tu contraseña",
    "todos los derechos reservados", "utilizamos cookies", "volver arriba",
)
_BOILERPLATE = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_removed_lines long, n_kept_words long, clean_text string"
)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule that needs no other lines."""
    n = len(words)
    if n < MIN_UNENDED_WORDS and not line.rstrip(b" \t\r\x0b\x0c").endswith(ENDINGS):
        if line.isascii() or len(_UNSPACED.findall(line.decode("utf-8", "replace"))) < 2 * MIN_UNENDED_WORDS:
            return True
    if len(line) - len(line.translate(None, SYMBOLS)) > MAX_SYMBOLS_A_WORD * n:
        return True
    if line.count(b"!") + line.count(b"?") > MAX_MARKS_A_WORD * n and n > 2:
        return True
    alone = sum(w in SEPARATORS for w in words)
    if alone >= MIN_SEPARATORS and alone >= MIN_SEPARATOR_SHARE * n:
        return True
    return n <= MAX_BOILERPLATE_WORDS and _BOILERPLATE.search(line.lower()) is not None


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True)


def _mixed(a: int, b: int) -> int:
    """A 64-bit hash of two of them, in order."""
    return ((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F + (1 << 63)) % (1 << 64) - (1 << 63)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, context) of the lines with up to MAX_BOILERPLATE_WORDS words: hashes of the line and of its two neighbours, each pair once a block."""
    for _, text in blocks(batches):
        found: set[tuple[int, int]] = set()
        for d in range(text.n):
            lines = [x for x in text.data[text.docs[d] : text.docs[d + 1]].tobytes().split(b"\n") if x.strip()]
            if len(lines) > 1:  # one line without neighbours is a text, and its copies have the same context
                hashes = [0, *map(line_hash, lines), 0]
                found.update((hashes[k + 1], _mixed(hashes[k], hashes[k + 2])) for k, x in enumerate(lines) if len(x.split()) <= MAX_BOILERPLATE_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["line", "context"])


def frequent_lines(docs: DataFrame, share: float = BOILERPLATE_SHARE, least: int = MIN_CONTEXTS) -> list[int]:
    """Hashes of the lines of docs (text) that stand in least, and share of all rows, different contexts.

    Counted over all rows, each pair of line and context before the shuffle
    once a block. A row has each line's occurrences among its own lines, so
    there are at most (lines a row) / share such lines at any size of docs.
    """
    pairs = docs.select("text").mapInArrow(_contexts, "line long, context long").distinct()
    limit = max(least, share * docs.count())
    counted = pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    return [r["line"] for r in counted.select("line").collect()]


def _repeat_words(text: Text) -> np.ndarray:
    """Words of each document that lie in a window found twice or more in it."""
    hashes = text.hashes()
    found, at = windows(hashes, text.first, REPEAT_WINDOW)
    doc = np.searchsorted(text.first, at, "right") - 1
    order = np.lexsort((found, doc))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (found[order][1:] == found[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[text.first[1:]] - covered[text.first[:-1]]


def _judged(frequent: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in blocks(batches):
            words = text.counts()
            chars = text.per_doc(text.word & ((text.data & 0xC0) != 0x80))
            symbols = text.per_doc(_SYMBOL[text.data])
            repeats = _repeat_words(text)
            failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
            lines = []
            for d in range(text.n):
                raw = text.data[text.docs[d] : text.docs[d + 1]].tobytes()
                seen, again, some, gone, left, out = set(), 0, 0, 0, 0, []
                for line in raw.split(b"\n"):
                    own = line.split()  # at the six white-space bytes
                    if not own:
                        out.append(line)
                        continue
                    some += 1
                    if line in seen:
                        again += 1
                    seen.add(line)
                    if line_fails(line, own) or len(own) <= MAX_BOILERPLATE_WORDS and frequent and line_hash(line) in frequent:
                        gone += 1
                    else:
                        left += len(own)
                        out.append(line)
                lines.append((again, some, gone, left, b"\n".join(out)))
            again, some, gone, left, clean = (list(c) for c in zip(*lines, strict=True))
            lost = np.array(left) < (1 - MAX_LOST_SHARE) * words
            columns = [
                part.column(0), pa.array(words), pa.array(chars), pa.array(symbols), pa.array(again, pa.int64()), pa.array(repeats), pa.array(failed),
                pa.array(~(failed | lost)), pa.array(some, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.int64()), pa.array(clean, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, verdict and cleaned text of every row of docs (doc_id, text).

    Returns a row per input row: doc_id; n_words, word_chars (code points in
    words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    one), n_repeat_words; base_failed; kept (the verdict); n_lines and
    n_removed_lines (of lines with a word); n_kept_words; clean_text (the lines
    that stay, lines without words among them).

    A null or empty text has no words and fails the base. Repeated rows are
    judged each. An empty table gives an empty result. Other columns are
    ignored. Only pairs of line hashes are shuffled; memory is bounded by the
    longest text.
    """
    frequent = frozenset(frequent_lines(docs))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_judged(frequent), SCHEMA)


def _oracle() -> str:
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    ends = "|".join(re.escape(x.decode()) for x in ENDINGS).replace("'", "''")
    phrases = " OR ".join(f"contains(low, {quoted([x])})" for x in BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
w AS (
  SELECT *, len(ws) AS n, coalesce(lag(line) OVER o, '') AS prev, coalesce(lead(line) OVER o, '') AS next, count(*) OVER (PARTITION BY doc_id) AS lines,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         len(list_filter(ws, lambda x: x IN ({quoted(sorted(x.decode() for x in SEPARATORS))}))) AS alone
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l) WHERE len(ws) > 0
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT line FROM w WHERE n <= {MAX_BOILERPLATE_WORDS} AND lines > 1 GROUP BY line
  HAVING count(DISTINCT {{'a': prev, 'b': next}}) >= greatest({MIN_CONTEXTS}, {BOILERPLATE_SHARE} * (SELECT count(*) FROM documents))),
r AS (
  SELECT *, (n < {MIN_UNENDED_WORDS} AND NOT regexp_matches(rtrim(line, E' \t\r\x0b\x0c'), '(?:{ends})$')
             AND len(regexp_extract_all(line, '[\x{{0e00}}-\x{{0e7f}}\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}]')) < {2 * MIN_UNENDED_WORDS})
         OR len(regexp_extract_all(line, '[#*$%&|<>]')) > {MAX_SYMBOLS_A_WORD}::DOUBLE * n
         OR (n > 2 AND len(regexp_extract_all(line, '[!?]')) > {MAX_MARKS_A_WORD}::DOUBLE * n)
         OR (alone >= {MIN_SEPARATORS} AND alone >= {MIN_SEPARATOR_SHARE}::DOUBLE * n)
         OR (n <= {MAX_BOILERPLATE_WORDS} AND (line IN (SELECT line FROM f) OR {phrases})) AS fails
  FROM w),
s AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (fails) AS n_removed_lines,
         coalesce(sum(n) FILTER (NOT fails), 0) AS n_kept_words
  FROM r GROUP BY doc_id),
h AS (
  SELECT doc_id, p, array_to_string(words[p:p + {REPEAT_WINDOW - 1}], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {REPEAT_WINDOW - 2}, 1))) AS p FROM d)),
m AS (SELECT doc_id, p FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, seq) > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM m, range({REPEAT_WINDOW}) AS t(k) GROUP BY doc_id),
j AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_kept_words >= {1 - MAX_LOST_SHARE}::DOUBLE * n_words AS kept
FROM j
"""


ORACLE_SQL = _oracle()
