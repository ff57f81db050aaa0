"""Which text one agent wrote was later read by another: the shingle detector as set operations.

The order of reading and writing in a world is one number, the step; what a matcher would keep as
state (windows seen, postings, boilerplate, deliveries) is then a window function over steps.

Texts are shuffled, not their windows: a task gets the texts of some worlds, or of some of their
agents, makes their windows and lets them meet, and what leaves it are runs of windows. The texts are
gone through twice: the windows that an agent had before part what it writes into originated spans,
and then the new windows of the spans meet what others read.

Spark takes the rows that are made of texts to be as few as the texts, and would send all windows to
the driver and to every task; joins of windows, spans and pieces ask to be merged instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspan.functions import text as T
from driftspan.operators.labels import call_resource, canonical_resource
from driftspan.sources.io import checkpointed

MAX_POSTINGS = 50
SPAN = ("sagent", "sstep", "sat", "s", "e")
#: A task makes the windows of about so many characters; a world or agent of more than MOST_CHARS
#: would be one task's, so its windows are shuffled by their hashes.
TASK_CHARS, MOST_CHARS = 1_000_000, 50_000_000


def exchanges_from_turns(turns: DataFrame) -> DataFrame:
    """(world, agent, pos, ord, stop): one exchange per assistant turn, in world order; the
    request is every earlier turn, kept as the pointer pos."""
    order = Window.partitionBy("world").orderBy("pos", "agent")
    return turns.filter("role = 'assistant'").select("world", "agent", "pos", F.row_number().over(order).alias("ord"), F.lit("end_turn").alias("stop"))


def parts_in_order(turns: DataFrame) -> DataFrame:
    """(world, agent, ex, step, kind r or w, pos, text, and role and call_id where turns have them):
    what each exchange newly reads, then writes.

    A turn is read by the next assistant turn of its agent, its exchange: a request repeats the
    history before it, so that the turns since the last exchange are what it adds, each as often as
    it stands there. Turns after the last exchange are never read.
    """
    ahead = Window.partitionBy("world", "agent").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    at = turns.withColumn("ex", F.last_value(F.when(F.col("role") == "assistant", F.col("pos")), ignoreNulls=True).over(ahead)).filter("ex is not null")
    kind = F.when(F.col("role") == "assistant", "w").otherwise("r")
    steps = at.withColumn("step", F.row_number().over(Window.partitionBy("world").orderBy("ex", "agent", "pos")))
    return steps.select("world", "agent", "ex", "step", kind.alias("kind"), "pos", "text", *[c for c in ("role", "call_id") if c in turns.columns])


def novel_windows(windows: DataFrame) -> DataFrame:
    """Windows whose agent had not read or written them before this step."""
    first = F.min("step").over(Window.partitionBy("world", "agent", "h"))
    return windows.withColumn("first", first).filter("first = step").drop("first")


def cut_pieces(parts: DataFrame, min_decoded: int = 16) -> DataFrame:
    """Each part's pieces between opaque blobs (at: raw offset), and the decoded text of encoded
    runs in pieces that are read, as pieces of kind d with their codec and raw range [ts, te)."""
    whole = T.mask_opaque(parts.select("world", "agent", "step", "kind", "text"), "text")
    decoded = T.decode_tokens(whole.filter("kind = 'r'"), "piece", min_decoded)
    place = F.col("at") + F.col("start")
    decoded = decoded.select("world", "agent", "step", F.lit("d").alias("kind"), "at", F.col("decoded").alias("piece"), "codec", place.alias("ts"), (place + F.length("token")).alias("te"))
    none = [F.lit(None).cast("string").alias("codec"), F.lit(-1).alias("ts"), F.lit(-1).alias("te")]
    return whole.select("world", "agent", "step", "kind", "at", "piece", *none).union(decoded)


def window_rows(pieces: DataFrame, k: int) -> DataFrame:
    """A row (off, h) for every window of the folded pieces."""
    return T.shingles(pieces.withColumn("folded", T.fold(F.col("piece"))).drop("piece"), "folded", k)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """The windows that occur more than once in their world, with `first`, the step at which their
    agent first read or wrote them; decoded text is looked up only, and not seen."""
    # Rows are kept narrow while all windows move, and sorted by hash first, which tells nearly all
    # of them apart; most are gone before agents are told apart.
    kinds, coded = "rwd", ("codec", "ts", "te")
    narrow = windows.withColumn("kind", F.expr(f"cast(position(kind, '{kinds}') as tinyint)"))
    narrow = narrow.withColumn("coded", F.when(F.col("codec").isNotNull(), F.struct(*coded))).drop(*coded)
    again = narrow.repartition("world", "h").withColumn("n", F.count("*").over(Window.partitionBy("h", "world"))).filter("n > 1").drop("n")
    again = again.withColumn("kind", F.expr(f"substring('{kinds}', kind, 1)")).withColumns({"codec": F.col("coded.codec"), "ts": F.coalesce("coded.ts", F.lit(-1)), "te": F.coalesce("coded.te", F.lit(-1))}).drop("coded")
    return again.withColumn("first", F.min(F.when(F.col("kind") != "d", F.col("step"))).over(Window.partitionBy("h", "world", "agent")))


def folded_pieces(pieces: DataFrame) -> DataFrame:
    return pieces if "folded" in pieces.columns else pieces.withColumn("folded", T.fold(F.col("piece")))


def among_windows(texts: DataFrame, keys: list[str], k: int, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """body(windows) of the windows of texts (keys, text, ...), which body looks at by keys and h or less.

    The windows of a key lie in one partition, with those of a few other keys; those of a key of more
    than MOST_CHARS lie in many.
    """
    sizes = texts.groupBy(*keys).agg(F.sum(F.length("text")).alias("chars"))
    found = sizes.agg(F.sum("chars").alias("all"), F.max("chars").alias("most")).first()
    parts = math.ceil((found["all"] or 1) / TASK_CHARS)
    if (found["most"] or 0) <= MOST_CHARS:
        return body(T.shingles(texts.repartition(parts, *keys), "text", k))
    large = sizes.filter(F.col("chars") > MOST_CHARS).select(*keys)
    rest = body(T.shingles(texts.join(large, keys, "left_anti").repartition(parts, *keys), "text", k))
    return rest.unionByName(body(T.shingles(texts.join(large, keys, "left_semi"), "text", k).repartition(parts, *keys, "h")))


def runs_of(seen: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi): the runs of windows with consecutive offsets."""
    island = F.col("off") - F.row_number().over(Window.partitionBy(*by).orderBy("off"))
    return seen.withColumn("island", island).groupBy(*by, "island").agg(F.min("off").alias("lo"), F.max("off").alias("hi")).drop("island")


#: What tells the pieces of a part apart, read, written or decoded.
PLACE = ("world", "step", "agent", "kind", "at", "codec", "ts", "te")


def seen_runs(pieces: DataFrame, k: int) -> DataFrame:
    """(world, step, at, lo, hi): the runs of windows in written pieces (folded) that their agent had
    read or written at an earlier step."""

    def runs(windows: DataFrame) -> DataFrame:
        first = F.min("step").over(Window.partitionBy("h", "world", "agent"))
        seen = windows.withColumn("first", first).filter("wrote and first < step")
        return runs_of(seen, ["world", "agent", "step", "at"]).drop("agent")

    own = pieces.filter("kind <> 'd'").select("world", "agent", "step", (F.col("kind") == "w").alias("wrote"), "at", F.col("folded").alias("text"))
    return among_windows(own, ["world", "agent"], k, runs)


def marked_runs(pieces: DataFrame, k: int) -> DataFrame:
    """(PLACE, seen, lo, hi): the runs of windows of the pieces (folded) that are worth a second look:
    seen ones, as of seen_runs, and others that are both written and read or decoded in their world."""

    def runs(windows: DataFrame) -> DataFrame:
        # most windows occur once, and are gone before agents are told apart
        by, wrote = Window.partitionBy("h", "world"), F.col("kind") == 1
        again = windows.withColumn("n", F.count("*").over(by)).filter("n > 1").drop("n")
        again = again.withColumn("first", F.min(F.when(F.col("coded").isNull(), F.col("step"))).over(Window.partitionBy("h", "world", "agent")))
        again = again.withColumns({"met": F.bool_or(wrote).over(by) & F.bool_or(~wrote).over(by), "seen": wrote & (F.col("first") < F.col("step"))}).filter("met or seen")
        found = runs_of(again.select("world", "step", "agent", "kind", "at", "coded", "seen", "off"), ["world", "step", "agent", "kind", "at", "coded", "seen"])
        kind = F.when(F.col("coded").isNotNull(), "d").when(wrote, "w").otherwise("r")
        return found.withColumns({"kind": kind, "codec": F.col("coded.codec"), "ts": F.coalesce("coded.ts", F.lit(-1)), "te": F.coalesce("coded.te", F.lit(-1))}).select(*PLACE, "seen", "lo", "hi")

    narrow = [(F.col("kind") == "w").cast("tinyint").alias("kind"), "at", F.when(F.col("kind") == "d", F.struct("codec", "ts", "te")).alias("coded")]  # all windows are sorted in these rows
    return among_windows(pieces.select("world", "step", "agent", *narrow, F.col("folded").alias("text")), ["world"], k, runs)


def spans_between(seen: DataFrame, pieces: DataFrame, k: int, min_span: int, min_word_chars: int) -> DataFrame:
    """(world, SPAN, raw): runs of new windows of the written pieces that are long and wordy enough.

    seen: (world, step, at, off) of the windows that their agent had before.
    """
    return spans_of(runs_of(seen, ["world", "step", "at"]), pieces, k, min_span, min_word_chars).drop("said")


def spans_of(runs: DataFrame, pieces: DataFrame, k: int, min_span: int, min_word_chars: int) -> DataFrame:
    """(world, SPAN, piece, said) from the runs (world, step, at, lo, hi) of windows that their agent had before.

    Windows touch over fewer than k offsets, so only runs of k seen ones, or those at an end, part two
    spans. said: the span's runs of new windows, as folded texts with their place.
    """
    by = ["world", "step", "at"]
    w = folded_pieces(pieces.filter("kind = 'w'")).withColumn("nw", F.length("folded") - k + 1).filter("nw > 0")
    ends = w.select(*by, "nw")
    runs = runs.join(ends.hint("merge"), by).select(*by, "lo", "hi", F.expr(f"hi - lo + 1 >= {k} or lo = 0 or hi = nw - 1").alias("parts"))
    ends = ends.select(*by, F.explode(F.array(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi")), F.struct(F.col("nw").alias("lo"), F.col("nw").alias("hi")))).alias("x")).select(*by, "x.lo", "x.hi", F.lit(True).alias("parts"))
    order = Window.partitionBy(*by).orderBy("lo")
    gaps = runs.union(ends).withColumn("s", F.last_value(F.when(F.col("parts"), F.col("hi") + 1), ignoreNulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = gaps.withColumn("next", F.lead("lo").over(order)).filter("hi + 1 < next")
    spans = gaps.groupBy(*by, "s").agg((F.max("next") - 1 + k).alias("e"), F.collect_list(F.struct((F.col("hi") + 1).alias("a"), (F.col("next") - 1 + k).alias("b"))).alias("said"))
    spans = spans.join(w.select(*by, "agent", "piece", "folded").hint("merge"), by)
    spans = spans.filter(T.good_span(F.expr("substring(folded, s + 1, e - s)"), min_span, min_word_chars))
    said = F.expr("transform(said, x -> struct(x.a as a, substring(folded, x.a + 1, x.b - x.a) as text))")
    return spans.select("world", F.col("agent").alias("sagent"), F.col("step").alias("sstep"), F.col("at").alias("sat"), "s", "e", "piece", said.alias("said"))


def texts_read(pieces: DataFrame) -> DataFrame:
    """(PLACE, lo, text): what pieces (folded) that are read or decoded have, as shared_runs takes it."""
    return pieces.filter("kind <> 'w'").select(*PLACE, F.lit(0).alias("lo"), F.col("folded").alias("text"))


def texts_posted(spans: DataFrame) -> DataFrame:
    """(world, SPAN, text): what spans (said) post, as shared_runs takes it."""
    return spans.select("world", *SPAN, F.explode("said").alias("x")).select("world", *SPAN, "x.text")


def marked_texts(marked: DataFrame, pieces: DataFrame, spans: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The texts read and posted that have a part in shared runs, from the marked runs that are not seen."""
    runs = marked.filter("not seen").drop("seen", "agent").withColumn("way", F.coalesce("codec", F.lit(""))).drop("codec")
    texts = pieces.select(*PLACE, F.coalesce("codec", F.lit("")).alias("way"), "folded")
    runs = runs.join(texts.hint("merge"), ["world", "step", "kind", "at", "way", "ts", "te"]).withColumn("text", F.expr(f"substring(folded, lo + 1, hi - lo + {k})"))
    written = runs.filter("kind = 'w'").select("world", F.col("step").alias("sstep"), F.col("at").alias("sat"), "lo", "hi", "text")
    posted = written.join(spans.select("world", *SPAN).hint("merge"), ["world", "sstep", "sat"]).filter(f"lo >= s and hi + {k} <= e")
    return runs.filter("kind <> 'w'").select(*PLACE, "lo", "text"), posted.select("world", *SPAN, "text")


def shared_runs(read: DataFrame, posted: DataFrame, k: int, min_span: int, max_postings: int) -> DataFrame:
    """(PLACE, SPAN, a, b): the runs of windows that texts read (PLACE, lo, text: from place lo of a
    piece) share with spans that another agent posted earlier (world, SPAN, text).

    At most max_postings spans of a window are posted, the first ones; from the step of the next on
    the window is boilerplate.
    """
    coded = ["codec", "ts", "te"]
    read = read.select("world", "step", "agent", "at", F.struct("kind", "lo", *coded).alias("read"), F.lit(0).alias("s"), F.lit(0).alias("e"), "text")
    posted = posted.select("world", F.col("sstep").alias("step"), F.col("sagent").alias("agent"), F.col("sat").alias("at"), F.lit(None).cast(read.schema["read"].dataType).alias("read"), "s", "e", "text")

    def runs(windows: DataFrame) -> DataFrame:
        by, post = Window.partitionBy("h", "world"), F.col("read").isNull()
        met = windows.withColumns({"p": F.bool_or(post).over(by), "r": F.bool_or(~post).over(by)}).filter("p and r").drop("p", "r")
        met = met.withColumn("rank", F.when(post, F.dense_rank().over(by.orderBy(~post, "step", "at", "s"))))
        span = F.struct(F.col("agent").alias("sagent"), F.col("step").alias("sstep"), F.col("at").alias("sat"), "s", "e")
        met = met.withColumns({"spans": F.collect_set(F.when(F.col("rank") <= max_postings, span)).over(by), "cutoff": F.min(F.when(F.col("rank") == max_postings + 1, F.col("step"))).over(by)})
        met = met.filter(~post & (F.col("cutoff").isNull() | (F.col("step") < F.col("cutoff"))))
        earlier = F.filter("spans", lambda x: (x["sstep"] < F.col("step")) & (x["sagent"] != F.col("agent")))
        hits = met.select("world", "step", "agent", "read.kind", "at", *[f"read.{c}" for c in coded], (F.col("read.lo") + F.col("off")).alias("off"), F.explode(earlier).alias("x")).select(*PLACE, "off", "x.*")
        return T.covered_runs(hits, [*PLACE, *SPAN], k).filter(F.col("b") - F.col("a") >= min_span)

    return among_windows(read.unionByName(posted), ["world"], k, runs)


def raw_range(piece: Column, at: Column, a: Column, b: Column) -> Column:
    """Struct (a, b): the raw offsets of the folded characters [a, b) of a piece at offset `at`.

    In ASCII text without escapes and runs of white space a folded character stands where it stood.
    """
    plain = F.struct((at + a).alias("a"), (at + b).alias("b"))
    return F.when(~piece.rlike(r"\\|^\s|\s\s|[^\x00-\x7f]"), plain).otherwise(T.let(T.fold_mapped(piece), lambda f: F.struct((at + F.get(f["starts"], a)).alias("a"), (at + F.get(f["ends"], b - 1)).alias("b"))))


def postings(written: DataFrame, spans: DataFrame, k: int, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """(world, h, SPAN, cutoff): each span's new windows (world, step, at, off, h), at most
    max_postings spans of a window; from step cutoff on the window is boilerplate."""
    w = written.select("world", F.col("step").alias("sstep"), F.col("at").alias("sat"), "off", "h")
    own = w.join(spans.select("world", *SPAN).hint("merge"), ["world", "sstep", "sat"]).filter(f"off >= s and off + {k} <= e").select("world", "h", *SPAN).distinct()
    return ranked_postings(own, max_postings)


def ranked_postings(own: DataFrame, max_postings: int) -> DataFrame:
    by = Window.partitionBy("world", "h")
    ranked = own.withColumn("rank", F.dense_rank().over(by.orderBy("sstep", "sat", "s"))).filter(F.col("rank") <= max_postings + 1)
    ranked = ranked.withColumn("cutoff", F.min(F.when(F.col("rank") == max_postings + 1, F.col("sstep"))).over(by))
    return ranked.filter(F.col("rank") <= max_postings).drop("rank")


def shingle_lookup(reads: DataFrame, posted: DataFrame) -> DataFrame:
    """The windows read that another agent posted earlier, with the span; each once, as windows differ
    by place and postings by span."""
    p = posted.select(F.col("world").alias("pw"), F.col("h").alias("ph"), *SPAN, "cutoff")
    met = reads.join(p.hint("merge"), (F.col("world") == F.col("pw")) & (F.col("h") == F.col("ph")) & (F.col("sstep") < F.col("step")) & (F.col("sagent") != F.col("agent")) & (F.col("cutoff").isNull() | (F.col("step") < F.col("cutoff"))))
    return met.select("world", "step", "agent", "kind", "at", "codec", "ts", "te", "off", *SPAN)


def explained(runs: DataFrame, pieces: DataFrame, spans: DataFrame, min_span: int, min_word_chars: int) -> DataFrame:
    """(world, step, agent, a, b, class, SPAN, rs, re): shared runs as raw ranges [a, b) of the part read,
    with their class and the span's raw range [rs, re).

    A run of windows shared with a span must be long and wordy enough; of decoded text the whole
    token is the range. Of several readings of a range the first in reach counts: text as it is,
    then decoded; a range that only two string levels explain is two_string_levels.
    spans: (world, SPAN, piece), of the runs at least. What comes out is checkpointed: it is narrow, and read more than once.
    """
    plain = runs.filter("kind = 'r'").join(pieces.filter("kind = 'r'").select("world", "step", "at", F.col("piece").alias("read"), "folded").hint("merge"), ["world", "step", "at"])
    plain = plain.filter(T.good_span(F.substring("folded", F.col("a") + 1, F.col("b") - F.col("a")), min_span, min_word_chars)).drop("folded")
    texts = spans.select("world", "sstep", "sat", "s", "e", "piece").distinct().hint("merge")
    plain = plain.join(texts, ["world", "sstep", "sat", "s", "e"])
    plain = plain.withColumn("r", raw_range(F.col("read"), F.lit(0), F.col("a"), F.col("b"))).withColumn("o", raw_range(F.col("piece"), F.lit(0), F.col("s"), F.col("e")))
    found = T.classify(F.expr("substring(piece, o.a + 1, o.b - o.a)"), F.expr("substring(read, r.a + 1, r.b - r.a)"))
    plain = plain.select("world", "step", "agent", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"), found.alias("class"), F.lit(0).alias("way"), *SPAN, (F.col("sat") + F.col("o.a")).alias("rs"), (F.col("sat") + F.col("o.b")).alias("re"))
    decoded = runs.filter("kind = 'd'").select("world", "step", "agent", F.col("ts").alias("a"), F.col("te").alias("b"), F.concat(F.lit("decoded:"), "codec").alias("class"), *SPAN).distinct().join(texts, ["world", "sstep", "sat", "s", "e"])
    decoded = decoded.withColumn("o", raw_range(F.col("piece"), F.lit(0), F.col("s"), F.col("e")))
    decoded = decoded.select("world", "step", "agent", "a", "b", "class", F.lit(1).alias("way"), *SPAN, (F.col("sat") + F.col("o.a")).alias("rs"), (F.col("sat") + F.col("o.b")).alias("re"))
    one = plain.union(decoded).groupBy("world", "step", "agent", "a", "b", *SPAN, "rs", "re")
    return checkpointed(one.agg(F.min(F.struct((F.col("class") == "two_string_levels").alias("out"), "way", "class"))["class"].alias("class")))


def routed(found: DataFrame, parts: DataFrame, calls: DataFrame | None) -> DataFrame:
    """Adds reader_ex, read_pos, carrier and route: direct:..., or channel:... where the call that
    a tool result answers names a resource. Of calls with one id the request's last counts.

    calls: world, agent, pos, call_id, tool, args.
    """
    at = parts.select("world", "step", F.col("ex").alias("reader_ex"), F.col("pos").alias("read_pos"), "role", F.col("call_id") if "call_id" in parts.columns else F.lit(None).cast("string").alias("call_id"))
    rows = found.join(at, ["world", "step"])
    carrier = F.when(F.col("role") == "system", "system_prompt").when(F.col("role") == "tool", "tool_result").otherwise("user_turn")
    if calls is None:
        rows = rows.withColumn("call", F.lit(None).cast("struct<tool: string, args: string>"))
    else:
        asked = rows.filter("role = 'tool'").select("world", "agent", "reader_ex", "call_id").distinct()
        last = asked.join(calls, ["world", "agent", "call_id"]).filter("pos < reader_ex").groupBy("world", "agent", "reader_ex", "call_id").agg(F.max_by(F.struct("tool", "args"), "pos").alias("call"))
        rows = rows.join(last, ["world", "agent", "reader_ex", "call_id"], "left")
    resource = canonical_resource(call_resource(F.col("call.args")))["key"]
    tool = F.coalesce(F.concat(F.lit("channel:"), resource), F.concat(F.lit("direct:tool:"), F.coalesce("call.tool", F.lit("unknown"))))
    return rows.withColumn("carrier", carrier).withColumn("route", F.when(F.col("role") == "tool", tool).otherwise(F.concat(F.lit("direct:"), carrier))).drop("call", "role", "call_id")


def scan(turns: DataFrame, calls: DataFrame | None = None, k: int = T.K, min_span: int = T.K, min_word_chars: int = 20, max_postings: int = MAX_POSTINGS, min_decoded: int = 16) -> tuple[DataFrame, DataFrame]:
    """(hits, spans): all matches as of detect() with `reread` and those out of reach (class
    two_string_levels), and the originated spans (world, SPAN, piece)."""
    parts = parts_in_order(turns)
    pieces, min_span = checkpointed(folded_pieces(cut_pieces(parts, min_decoded))), max(k, min_span)
    marked = checkpointed(marked_runs(pieces, k))
    spans = checkpointed(spans_of(marked.filter("seen").select("world", "step", "at", "lo", "hi"), pieces, k, min_span, min_word_chars).drop("piece", "said"))
    written = pieces.filter("kind = 'w'").select("world", F.col("step").alias("sstep"), F.col("at").alias("sat"), "piece")
    runs = checkpointed(shared_runs(*marked_texts(marked, pieces, spans, k), k, min_span, max_postings))
    spans = spans.join(written.hint("merge"), ["world", "sstep", "sat"])
    found = routed(explained(runs, pieces, spans, min_span, min_word_chars), parts, calls)
    wrote = parts.filter("kind = 'w'").select("world", F.col("step").alias("sstep"), F.col("ex").alias("sender_ex"), F.col("pos").alias("sender_pos"))
    found = found.join(wrote, ["world", "sstep"]).withColumnRenamed("agent", "reader").withColumnRenamed("sagent", "sender")
    first = F.min(F.when(F.col("class") != "two_string_levels", F.col("reader_ex"))).over(Window.partitionBy("world", "sender", "sender_ex", "sender_pos", "rs", "re", "reader", "route"))
    found = found.withColumn("reread", F.col("route").startswith("channel:") & (F.col("reader_ex") > first))
    return found.select("world", "reader", "reader_ex", "read_pos", "a", "b", "class", "carrier", "route", "sender", "sender_ex", "sender_pos", F.col("rs").alias("s"), F.col("re").alias("e"), "reread"), spans


def detect(turns: DataFrame, calls: DataFrame | None = None, k: int = T.K, min_span: int = T.K, min_word_chars: int = 20, max_postings: int = MAX_POSTINGS, min_decoded: int = 16) -> DataFrame:
    """One row per match: world, reader, reader_ex, read_pos, a, b, class, carrier, route, sender,
    sender_ex, sender_pos, s, e.

    [a, b) are characters of the text read, [s, e) of the span written. Text is compared with
    opaque values masked, string escapes of any depth undone, lower case and white space folded;
    hexadecimal, base64 and URL-encoded runs are also looked up decoded. What only two string
    levels explain is no match; a span that a channel delivered to a reader in an earlier exchange
    is not matched there again.

    turns: world, agent, pos, role (system, user, assistant or tool), text, and call_id where tool
    results have one; calls: world, agent, pos, call_id, tool, args. Null texts have no parts.
    """
    hits, _ = scan(turns, calls, k, min_span, min_word_chars, max_postings, min_decoded)
    return hits.filter("class <> 'two_string_levels' and not reread").drop("reread")


def first_reads(hits: DataFrame) -> DataFrame:
    """Hits of a span (world, sid, reader, route, ord) but those a reader had by that route in an earlier exchange."""
    first = F.min("ord").over(Window.partitionBy("world", "sid", "reader", "route"))
    return hits.withColumn("__first", first).filter((F.col("route") == "direct") | (F.col("ord") == F.col("__first"))).drop("__first")


def credential_agents(exchanges: DataFrame) -> DataFrame:
    """(world, credential, detector_agent): one detector agent per credential, by first exchange."""
    first = exchanges.groupBy("world", "credential").agg(F.min("ord").alias("first"))
    return first.withColumn("detector_agent", F.dense_rank().over(Window.partitionBy("world").orderBy("first"))).drop("first")


def group_transmissions(matches: DataFrame) -> DataFrame:
    """One row per reader exchange, sender and route: n_matches, n_chars, first_pos, first_a, and the
    evidence in order of the place read, an array of (read_pos, a, b, class, carrier, sender_ex, sender_pos, s, e)."""
    items = F.sort_array(F.collect_list(F.struct("read_pos", "a", "b", "class", "carrier", "sender_ex", "sender_pos", "s", "e")))
    rows = matches.groupBy("world", "reader", "reader_ex", "sender", "route").agg(F.count("*").alias("n_matches"), F.sum(F.col("b") - F.col("a")).cast("long").alias("n_chars"), items.alias("evidence"))
    return rows.withColumn("first_pos", F.get("evidence", 0)["read_pos"]).withColumn("first_a", F.get("evidence", 0)["a"].cast("long"))


def world_summary(turns: DataFrame, hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(world, agents, exchanges, spans, matches, rereads, out_of_reach, transmissions) of every world
    from the two tables of scan(...); matches count rereads."""
    base = turns.groupBy("world").agg(F.count_distinct("agent").alias("agents"), F.count_if(F.col("role") == "assistant").alias("exchanges"))
    near = F.col("class") != "two_string_levels"
    kept = near & ~F.col("reread")
    per = hits.groupBy("world").agg(F.count_if(near).alias("matches"), F.count_if(near & F.col("reread")).alias("rereads"), F.count_if(~near).alias("out_of_reach"), F.count_distinct(F.when(kept, F.struct("reader", "reader_ex", "sender", "route"))).alias("transmissions"))
    out = base.join(spans.groupBy("world").agg(F.count("*").alias("spans")), "world", "left").join(per, "world", "left")
    return out.fillna(0, ["spans", "matches", "rereads", "out_of_reach", "transmissions"])
