"""Chat formatting: quotation linking and reply order.

1. Lines of a message that begin with ``>`` marks are quoted; the number of
   marks is their level. Consecutive lines of one level are a passage, so where
   a mail program broke its lines does not matter. What is left is the
   message's own text.
2. Passages are normalised and hashed: every run of ``WINDOW`` words, and each
   shorter sentence, line or passage as a whole. The hashes are joined to those
   of the latest earlier message of the conversation whose own text has them.
   The message that the most hashes of the lowest linked level come from is the
   parent.
3. Messages without a linked quote answer the message before them. Runs of
   messages of which each answers the one before form a segment; segments form
   a tree, whose depth-first order comes from ranking its Euler tour by pointer
   doubling. Only segments take part in that, and only those of conversations
   with more than one.

Orders run over range-sorted blocks with the state of the blocks before, never
over one conversation or one frequent line in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import latest, numbered
from .store import written

#: Words of a run that is hashed.
WINDOW = 6
_MARKS = r"^[ \t]*(?:>[ \t]*)+"
# How a line before a quote names its author.
_ATTRIBUTION = r"(?i)\b(wrote|writes|schrieb|écrit|escribió)\s*:\s*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _plain(text: Column) -> Column:
    """Without marks, in lower case, white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, _MARKS, "")), r"\s+", " "))


def _keys(text: Column, lines: Column) -> Column:
    """Hashes of a passage (normalised) and its lines: its runs of WINDOW words, and shorter sentences, lines and itself whole."""
    words = F.split(text, " ")
    runs = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WINDOW), " ")))).otherwise(F.array().cast("array<bigint>"))
    units = F.concat(F.split(text, r"(?<=[.!?…]) "), lines, F.array(text))
    short = F.filter(units, lambda u: (u != "") & (F.size(F.split(u, " ")) < WINDOW))
    return F.array_distinct(F.concat(runs, F.transform(short, lambda u: F.xxhash64(u))))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``quotes`` (whether a line is quoted) and ``passages``: (level, lines) of each run of lines of one level.

    A line that announces a deeper quote has that quote's level and no text.
    """
    raw = F.split(F.coalesce(F.col("text"), F.lit("")), "\r\n|\n|\r")
    rows = messages.withColumn("_raw", raw).withColumn("_levels", F.transform("_raw", _level))

    def line(text: Column, at: Column) -> Column:
        level, after = F.get("_levels", at), F.coalesce(F.get("_levels", at + 1), F.lit(0))
        naming = (after > level) & text.rlike(_ATTRIBUTION)
        return F.struct(F.when(naming, after).otherwise(level).alias("level"), F.when(~naming, text).otherwise(F.lit("")).alias("text"))

    rows = rows.withColumn("quotes", F.exists("_levels", lambda x: x > 0))
    rows = rows.withColumn("_lines", F.when(F.col("quotes"), F.transform("_raw", line)))
    level = lambda at: F.get("_lines", at)["level"]
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    rows = rows.withColumn("_starts", F.filter(every, lambda i: (i == 0) | (level(i) != level(i - 1))))

    def passage(start: Column, at: Column) -> Column:
        end = F.coalesce(F.get("_starts", at + 1), F.size("_lines"))
        return F.struct(level(start).alias("level"), F.transform(F.slice("_lines", start + 1, end - start), lambda l: l["text"]).alias("lines"))

    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("_raw").alias("lines")))
    return rows.withColumn("passages", F.when(F.col("quotes"), F.transform("_starts", passage)).otherwise(whole)).drop("_raw", "_levels", "_lines", "_starts")


def _hashed(rows: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, place, passage, level, key) of the quoted or the own passages."""
    each = rows.select("conv_id", "place", F.posexplode("passages").alias("passage", "p")).where(F.col("p.level") > 0 if quoted else F.col("p.level") == 0)
    lines = F.transform("p.lines", _plain)
    plain = each.select("conv_id", "place", "passage", F.col("p.level").alias("level"), lines.alias("_lines"))
    plain = plain.withColumn("_text", F.array_join(F.filter("_lines", lambda l: l != ""), " "))
    return plain.select("conv_id", "place", "passage", "level", F.explode(_keys(F.col("_text"), F.col("_lines"))).alias("key"))


def _parents(rows: DataFrame) -> DataFrame:
    """(place, parent, n_linked) of the messages with a linked quote; n_linked counts passages."""
    asking = rows.where("quotes")
    quoted = _hashed(asking, True).groupBy("conv_id", "key", "place").agg(F.min(F.struct("level", "passage")).alias("first"))
    quoted = written(quoted.select("conv_id", "key", "place", "first.level", "first.passage"), "quoted")
    talks = asking.select("conv_id").distinct()
    own = _hashed(rows.join(talks, "conv_id", "left_semi"), False).select("conv_id", "place", "key").distinct()
    own = own.join(quoted.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    # at one place the quoting row comes first: a message does not quote itself
    both = quoted.withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    source = F.when(F.col("kind") == 1, F.struct("conv_id", "key", "place"))
    filled = latest(both, ["conv_id", "key", "place", "kind"], source, "quotes")
    linked = filled.where((F.col("kind") == 0) & (F.col("_latest.conv_id") == F.col("conv_id")) & (F.col("_latest.key") == F.col("key")))
    votes = linked.groupBy("place", "level", F.col("_latest.place").alias("parent")).agg(F.count("*").alias("hits"))
    passages = linked.groupBy("place").agg(F.count_distinct("passage").alias("n_linked"))
    best = F.max_by("parent", F.struct(-F.col("level"), "hits", "parent"))
    return votes.groupBy("place").agg(best.alias("parent")).join(passages, "place")


def _tour(segments: DataFrame) -> DataFrame:
    """(segment, first) for a forest of segments (conv_id, segment, attach, up, size): messages that come before it in its conversation."""
    placed = numbered(segments.withColumn("_deep", -F.coalesce("attach", F.lit(0))), ["conv_id", "up", "_deep", "segment"], "row")
    placed = written(placed, "segments")
    lagged = placed.select((F.col("row") + 1).alias("row"), F.col("segment").alias("left"), F.col("conv_id").alias("_c"), F.col("up").alias("_u"))
    # what comes just before: entering a segment follows leaving the sibling to its left, or else entering its parent
    sided = placed.join(lagged, "row", "left").withColumn("left", F.when((F.col("_c") == F.col("conv_id")) & F.col("_u").eqNullSafe(F.col("up")), F.col("left")))
    enter = sided.select(F.struct("segment", F.lit(0).alias("k")).alias("id"), F.when(F.col("left").isNotNull(), F.struct(F.col("left").alias("segment"), F.lit(1).alias("k"))).when(F.col("up").isNotNull(), F.struct(F.col("up").alias("segment"), F.lit(0).alias("k"))).alias("pre"), "size")
    # leaving a segment follows leaving its last child, or else entering it
    lasts = placed.where("up is not null").groupBy(F.col("up").alias("segment")).agg(F.max_by("segment", "row").alias("child"))
    leave = placed.join(lasts, "segment", "left").select(F.struct("segment", F.lit(1).alias("k")).alias("id"), F.struct(F.coalesce("child", "segment").alias("segment"), F.when(F.col("child").isNotNull(), 1).otherwise(0).alias("k")).alias("pre"), F.lit(0).cast("long").alias("size"))
    steps = written(enter.unionByName(leave).select("id", "pre", F.lit(0).cast("long").alias("sum"), "size"), "tour")
    # sum: sizes of the steps from pre (with it) to this one (without it)
    steps = steps.alias("s").join(steps.select(F.col("id").alias("pid"), F.col("size").alias("psize")), F.col("s.pre") == F.col("pid"), "left").select("id", "pre", F.coalesce("psize", F.lit(0)).alias("sum"))
    steps = written(steps, "tour")
    while steps.where("pre is not null").limit(1).count():
        ahead = steps.select(F.col("id").alias("pid"), F.col("pre").alias("ppre"), F.col("sum").alias("psum"))
        steps = steps.join(ahead, F.col("pre") == F.col("pid"), "left").select("id", F.col("ppre").alias("pre"), (F.col("sum") + F.coalesce("psum", F.lit(0))).alias("sum"))
        steps = written(steps, "tour")
    return steps.where("id.k = 0").select(F.col("id.segment").alias("segment"), F.col("sum").alias("first"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Every row of messages (conv_id, turn, role, text) with its place in the reply order of its conversation.

    Returns conv_id, turn, role; parent_turn (of the message that it answers;
    null for a first one); linked (whether a quote told so); position (from 0,
    depth first: answers follow what they answer, earlier ones first);
    n_quoted and n_linked (passages); text (without quoted lines and the lines
    that announce them, trimmed).

    Earlier means a smaller turn; rows that share one follow in the order of
    role and text. Null turns come first, null conv_ids are conversations of
    one message each. A null text is empty. A quote that matches no earlier
    message is removed but links nothing. An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = numbered(rows, ["conv_id", "turn", "role", "text"], "place")
    rows = written(parsed(rows), "messages")
    links = written(_parents(rows), "links")

    own = F.array_join(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["lines"])), "\n")
    quoted = F.size(F.filter("passages", lambda p: (p["level"] > 0) & F.exists(p["lines"], lambda l: _plain(l) != ""))).cast("long")
    slim = rows.select("conv_id", "turn", "role", "place", F.trim(F.regexp_replace(own, r"^\s+|\s+$", "")).alias("text"), quoted.alias("n_quoted")).join(links, "place", "left")
    firsts = rows.groupBy("conv_id").agg(F.min("place").alias("begin"))
    begun = slim.join(firsts, "conv_id", "left").withColumn("begins", F.col("conv_id").isNull() | (F.col("place") == F.col("begin"))).drop("begin")
    parent = F.when(F.col("begins"), None).otherwise(F.coalesce("parent", F.col("place") - 1))
    begun = begun.withColumn("linked", F.col("parent").isNotNull()).withColumn("parent", parent).withColumn("opens", F.col("begins") | (F.col("parent") != F.col("place") - 1))
    cut = written(latest(begun, ["place"], F.when(F.col("opens"), F.col("place")), "cuts").withColumnRenamed("_latest", "segment"), "cut")

    sizes = cut.groupBy("segment").agg(F.count("*").alias("size"))
    heads = cut.where("opens").select("conv_id", "segment", F.col("parent").alias("attach")).join(sizes, "segment")
    branched = heads.where("attach is not null").select("conv_id").distinct()
    some = heads.join(branched, "conv_id", "left_semi")
    ups = cut.select(F.col("place").alias("attach"), F.col("segment").alias("up"))
    tour = _tour(some.join(ups, "attach", "left").select("conv_id", "segment", "attach", "up", "size"))
    turns = cut.select(F.col("place").alias("parent"), F.col("turn").alias("parent_turn"))
    told = cut.join(tour, "segment", "left").join(turns, "parent", "left")
    position = F.coalesce("first", F.lit(0)) + F.col("place") - F.col("segment")
    return told.select("conv_id", "turn", "role", "parent_turn", "linked", position.cast("long").alias("position"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")
