"""Quotation linking: conversations in reply order, without the quotes.

A line's level is the number of its leading `>` marks; lines of one level that follow each other
are a passage. Quoted passages and their lines are hashed after normalisation and joined, within a
conversation, to the latest earlier message that has them itself: as all its own text, or as one of
its own passages, paragraphs or lines. A passage that no message has whole goes to the message that
most of its lines lead to. The best match of a message is its parent, and replies follow their
parents. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._asof import latest_earlier
from ._spark import checkpointed


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[\\s\\p{Cntrl}]+", " "))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, whatever it does with it."""
    return F.get(F.transform(F.array(value), body), 0)


def passages(text: Column) -> Column:
    """Array of (level, text) of a message's passages in order; blank lines end none of them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, "^((?:[ \t]*>)*)", 1), "[^>]", "")).alias("level"), F.regexp_replace(x, "^(?:[ \t]*>)+[ \t]?", "").alias("text")))

    def cut(x: Column, starts: Column) -> Column:
        size = lambda a, k: F.coalesce(F.get(starts, k + 1), F.size(x)) - a
        return F.transform(starts, lambda a, k: F.struct(F.get(x, a)["level"].alias("level"), F.array_join(F.transform(F.slice(x, a + 1, size(a, k)), lambda y: y["text"]), "\n").alias("text")))

    first = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["level"] != F.get(x, i - 1)["level"]))
    return _once(lines, lambda x: _once(first(x), lambda starts: cut(x, starts)))


def _lines(text: Column) -> Column:
    """The normalised lines of a text; blank ones are empty. Joined, they are the normalised text."""
    return F.transform(F.split(text, "\n"), _normal)


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _offered(own: Column) -> Column:
    """What a message has itself, of the normalised lines of its own passages: all, passages, paragraphs, lines."""
    lines = F.flatten(own)
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n{2,}"), lambda x: F.trim(F.translate(x, "\n", " ")))
    return F.array_distinct(F.concat(F.array(_joined(lines)), F.transform(own, _joined), paragraphs, lines))


def _asked(quote: Column) -> Column:
    """(level, units) of a quoted passage: itself whole, then its lines by their length."""
    unit = lambda x, whole, w: F.struct(x.alias("x"), F.lit(whole).alias("whole"), w.cast("long").alias("w"))

    def units(q: Column) -> Column:
        lines = F.filter(F.array_distinct(q["lines"]), lambda x: (x != "") & (x != q["x"]))
        return F.concat(F.array(unit(q["x"], 1, F.lit(0))), F.transform(lines, lambda x: unit(x, 0, F.length(x))))

    whole = _once(_lines(quote["text"]), lambda x: F.struct(_joined(x).alias("x"), x.alias("lines")))
    return F.struct(quote["level"].alias("level"), _once(whole, units).alias("units"))


def _key(turn: Column) -> Column:
    """A turn as 20 digits whose order as text is that of the turns, negative ones too."""
    return F.lpad((turn.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", share: float = 0.5) -> DataFrame:
    """One row per message: conv_col, turn_col, own_text, n_quotes, n_linked, parent_turn, path.

    own_text is the message without quoted lines; n_quotes counts its quoted passages that are not
    blank, n_linked those found in an earlier message: whole, or else by lines, if those that lead
    to one message hold at least `share` of the characters of the passage's distinct lines (of
    messages with as many characters the latest counts). parent_turn is the latest message that its
    outermost linked level quotes, or else the turn before it; null for a conversation's first
    message. path has the turns from the first message down to this one, each plus 2**63 as 20 digits: in its order every message
    follows its parent, and replies to one message come in order of turn. It is as long as the
    chain of replies is deep.

    A null text is empty: no quotes and an empty own text. Rows with a null conversation or turn
    are kept with no links, parent or path. Of messages with the same conversation and turn every
    one is kept; they link alike and share a path. Integer turns. Other columns are ignored; no
    rows give none.
    """
    rows = messages.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), passages(F.col(text_col)).alias("p"))
    rows = checkpointed(rows.withColumn("id", F.monotonically_increasing_id()))
    own = F.filter("p", lambda x: x["level"] == 0)
    own_text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), "^\\s+|\\s+$", "")
    texts = _once(F.transform(own, lambda x: _lines(x["text"])), _offered)
    known = F.col("c").isNotNull() & F.col("t").isNotNull()
    none = F.lit(None)
    have = rows.filter(known).select("c", "t", F.explode(texts).alias("x"), none.cast("long").alias("id"), none.cast("int").alias("k"), none.cast("int").alias("level"), none.cast("int").alias("whole"), none.cast("long").alias("w"))
    # at level n a quote repeats a message's own text
    ask = rows.filter(known).select("c", "t", "id", F.posexplode(F.transform(F.filter("p", lambda x: x["level"] > 0), _asked)).alias("k", "q"))
    ask = ask.select("c", "t", "id", "k", "q.level", F.explode("q.units").alias("u")).select("c", "t", "u.x", "id", "k", "level", "u.whole", "u.w")
    both = checkpointed(have.union(ask).filter("x <> ''").select("c", "t", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"), "id", "k", "level", "whole", "w"))
    linked = latest_earlier(both, ["c", "h1", "h2"], "t", F.when(F.col("id").isNull(), F.col("t"))).filter("id is not null")
    # one exchange serves the three groupings
    votes = linked.select("id", "k", "level", "found", "whole", "w").repartition("id").groupBy("id", "k", "level", "found").agg(F.max("whole").alias("whole"), F.sum("w").alias("w"))
    quoted = votes.groupBy("id", "k", "level").agg(F.sum("w").alias("total"), F.max(F.when(F.col("found").isNotNull(), F.struct("whole", "w", "found"))).alias("best"))
    quoted = quoted.select("id", "level", F.when((F.col("best.whole") == 1) | (F.col("best.w") >= share * F.col("total")), F.col("best.found")).alias("found"))
    best = quoted.groupBy("id").agg(F.count("*").alias("n_quotes"), F.count("found").alias("n_linked"), F.min(F.when(F.col("found").isNotNull(), F.struct("level", (-F.col("found")).alias("t"))))["t"].alias("minus"))
    turns = rows.filter(known).select("c", "t").distinct()
    before = latest_earlier(turns, ["c"], "t", F.col("t")).select("c", "t", F.col("found").alias("before"))
    named = rows.select("id", "c", "t", own_text.alias("own_text")).join(best, "id", "left").join(before, ["c", "t"], "left")
    named = checkpointed(named.select("id", "c", "t", "own_text", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce(-F.col("minus"), "before").alias("parent")))

    # paths of turns from the first message down: a round doubles those that do not begin there yet,
    # and whole ones take no further part
    fields = ("c", "t", "up", "path")
    paths = checkpointed(named.filter(known).groupBy("c", "t").agg(F.min("parent").alias("up")).withColumn("path", F.array("t")).select(*fields))
    whole, open_ = paths.filter("up is null"), paths.filter("up is not null")
    while not open_.isEmpty():
        above = whole.union(open_).select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        grown = open_.join(above, (F.col("c") == F.col("c2")) & (F.col("up") == F.col("t2")))
        grown = checkpointed(grown.select("c", "t", F.col("up2").alias("up"), F.concat("path2", "path").alias("path")))
        whole, open_ = whole.union(grown.filter("up is null")), grown.filter("up is not null")
    paths = whole
    digits = F.transform("path", _key)
    out = named.join(paths.select("c", "t", F.array_join(digits, "/").alias("path")), ["c", "t"], "left")
    return out.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), "own_text", F.col("n_quotes").cast("long").alias("n_quotes"), F.col("n_linked").cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"), "path")
