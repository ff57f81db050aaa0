"""Benchmark decontamination with a distributed positional inverted index.

1. The benchmark's words are counted over all documents.
2. Each window of an item gets its two rarest words as anchors. Only anchors need postings:
   (term, document, positions), one row per term and document.
3. Postings meet the anchors by term. An item position p and a document position q lie on the
   diagonal q - p; a window can only occur on a diagonal that holds both of its anchors.
4. Along these diagonals the document's words are compared with the item's, and runs as long as
   a window are hits.

Which words a task lets through to a shuffle is decided by a bitmap of fixed size over word
hashes, so nothing that grows with benchmark or corpus is broadcast unchecked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed
from ._text import ALNUM, U64, hashed_texts

BITMAP_BITS = 22
#: Candidates of up to so many item words (8 bytes each) are broadcast; more are shuffled.
BROADCAST_WORDS = 2_000_000


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64), kind))


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id as text, words): word hashes of each item; items without words go."""

    def rows(batches):
        for batch in batches:
            words = [w.view(np.int64) for w in hashed_texts(batch.column(1), ALNUM)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(words, pa.int64())], names=["item_id", "words"])

    return items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(rows, "item_id string, words array<long>").filter("size(words) > 0").distinct()


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bits of the top hash bits of column term; 2**BITMAP_BITS at most come to the driver."""
    bits = np.zeros(1 << BITMAP_BITS, bool)
    found = terms.select(F.shiftrightunsigned("term", 64 - BITMAP_BITS).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    bits[found] = True
    return bits


def _let_through(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[(words >> U64(64 - BITMAP_BITS)).astype(np.int64)])


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, n): how often words whose bits the terms share occur in all documents."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def count(batches):
        found, counts = np.empty(0, U64), np.empty(0, np.int64)
        for batch in batches:
            parts = [w[_let_through(w, bits.value)] for w in hashed_texts(batch.column(0), ALNUM)]
            found, at = np.unique(np.concatenate([found, *parts]), return_inverse=True)
            more = np.concatenate([counts, np.ones(len(at) - len(counts), np.int64)])
            counts = np.bincount(at, weights=more, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["term", "n"])

    return docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def positional_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(term, doc, positions): where each of the terms stands in each document, from 0."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def post(batches):
        for batch in batches:
            names, source, positions = [], [], []
            for i, words in enumerate(hashed_texts(batch.column(1), ALNUM)):
                at = _let_through(words, bits.value)
                if not len(at):
                    continue
                at = at[np.argsort(words[at], kind="stable")]
                starts = np.flatnonzero(np.concatenate([[True], words[at][1:] != words[at][:-1]]))
                names.append(words[at][starts])
                source.append(np.full(len(starts), i))
                positions += np.split(at, starts[1:])
            names = np.concatenate([*names, np.empty(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), batch.column(0).take(pa.array(np.concatenate([*source, np.empty(0, np.int64)]).astype(np.int64))), _lists(positions, pa.int32())], names=["term", "doc", "positions"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(post, f"term long, doc {kind}, positions array<int>")
    return found.join(terms.select("term").distinct(), "term", "left_semi")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, start, position, term): the words of each item's windows."""
    last = F.greatest(F.size("words") - width, F.lit(0))
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    return starts.select("item_id", "start", F.posexplode(F.slice("words", F.col("start") + 1, width)).alias("k", "term")).select("item_id", "start", (F.col("start") + F.col("k")).alias("position"), "term")


def anchors(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(item_id, position, term, needed): the two rarest words of each window, each place once.

    needed: how many anchors an occurrence has at least, 1 for items of one word.
    """
    windows = _windows(items, width).join(counts, "term")  # a window with a word that no document has cannot occur
    order = Window.partitionBy("item_id", "start").orderBy("n", "position")
    size = Window.partitionBy("item_id", "start")
    ranked = windows.withColumn("rank", F.row_number().over(order)).withColumn("known", F.count("*").over(size))
    length = items.select("item_id", F.least(F.size("words"), F.lit(width)).alias("length"))
    kept = ranked.join(length, "item_id").filter("known = length and rank <= 2")
    return kept.select("item_id", "position", "term", F.least("length", F.lit(2)).alias("needed")).distinct()


def diagonals(index: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, item_id, diagonals): where enough anchors of an item stand in line in a document."""
    met = index.join(places, "term").select("doc", "item_id", "position", "needed", F.explode("positions").alias("q"))
    lines = met.groupBy("doc", "item_id", (F.col("q") - F.col("position")).alias("diagonal")).agg(F.count("*").alias("anchors"), F.first("needed").alias("needed"))
    return lines.filter("anchors >= needed").groupBy("doc", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(doc, query_id, start, end): spans of at most `slop` words that hold all terms of a query.

    index: positional_index(...); queries: (query_id, words), hashes as of item_words. Each place of
    the query's rarest term gives the shortest span around it, the first of equals, if that is short
    enough: from every place of a term before it, the span reaches to the first place of each other
    term; end is exclusive. A query's terms count once each; a query without terms has no match.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    lengths = index.groupBy("term").agg(F.sum(F.size("positions")).alias("n"))
    whole = terms.join(lengths, "term").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "term")))
    total = terms.groupBy("query_id").agg(F.count("*").alias("total"))
    met = index.join(whole.join(total, "query_id"), "term")
    rare = met.filter("rank = 1").select("query_id", "doc", "total", F.explode("positions").alias("q"))
    other = met.filter("rank > 1").select("query_id", "doc", "positions")
    near = rare.join(other, ["query_id", "doc"], "left").withColumn("p", F.expr(f"filter(positions, x -> abs(x - q) < {slop})"))
    near = near.groupBy("query_id", "doc", "q", "total").agg(F.collect_list("p").alias("near")).filter("size(near) = total - 1 and not exists(near, xs -> size(xs) = 0)")
    spans = near.withColumn("starts", F.expr("array_union(array(q), filter(flatten(near), x -> x < q))"))
    ends = "array_max(transform(near, xs -> array_min(filter(xs, x -> x >= s))))"
    spans = spans.withColumn("span", F.expr(f"array_min(transform(filter(starts, s -> not exists(near, xs -> not exists(xs, x -> x >= s))), s -> struct(greatest(q, coalesce({ends}, q)) + 1 - s as length, s as start)))"))
    return spans.filter(f"span.length <= {slop}").select("doc", "query_id", F.col("span.start").alias("start"), F.expr("span.start + span.length").alias("end")).distinct()


def _hits(words: np.ndarray, item: np.ndarray, diagonal: int, width: int) -> list[tuple[int, int]]:
    """Runs [a, b) of document words along one diagonal that hold whole windows of the item."""
    a, b = max(0, diagonal), min(len(words), diagonal + len(item))
    same = np.concatenate([[False], words[a:b] == item[a - diagonal : b - diagonal], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a + s, a + e) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if e - s >= min(width, len(item))]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id_col, the `keep` columns, n_words, n_hit, items (sorted texts), spans (start, end).

    Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased.
    A window is `width` words of an item in a row, or a whole shorter item; spans are the document
    words inside any occurrence, merged, end exclusive.

    Null and empty texts have no words and no hits, items without words or with a null id none
    either. Only a row's text decides: documents are searched by a hash of id and text, and rows
    that share it are looked at with each other's candidates, which changes nothing. So repeated
    and null ids come back once each with the result of their own text. Items that repeat an id
    with other texts are all looked for. Other columns are ignored.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    picked = docs.select(*columns, *[] if text_col in columns else [text_col]).withColumn("__doc", F.xxhash64(id_col, text_col))
    items = checkpointed(item_words(benchmark, item_col, item_text_col))
    counts = term_counts(docs, text_col, items.select(F.explode("words").alias("term")))
    items_numbered = items.withColumn("item", F.xxhash64("item_id", "words"))
    places = checkpointed(anchors(items_numbered.select(F.col("item").alias("item_id"), "words"), counts, width))
    index = positional_index(picked, "__doc", text_col, places)
    found = diagonals(index, places).join(items_numbered.select("item", F.col("item_id").alias("name"), "words"), F.col("item_id") == F.col("item"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("name", "words", "diagonals")).alias("candidates"))
    found = checkpointed(found.select(F.col("doc").alias("__doc"), F.col("candidates").alias("__candidates")))
    words = found.agg(F.sum(F.aggregate("__candidates", F.lit(0).cast("long"), lambda n, c: n + F.size(c["words"]) + F.size(c["diagonals"])))).first()[0] or 0
    if words <= BROADCAST_WORDS:
        found = F.broadcast(found)
    joined = picked.join(found, "__doc", "left").drop("__doc")
    at, schema, n_columns = joined.columns.index(text_col), joined.select(*columns).schema, len(columns)

    def verify(batches):
        for batch in batches:
            n_words, n_hit, names, spans = [], [], [], []
            for words, candidates in zip(hashed_texts(batch.column(at), ALNUM), batch.column(-1).to_pylist(), strict=True):
                marks, own = np.zeros(len(words) + 1, np.int64), set()
                words = words.view(np.int64)
                for c in candidates or ():
                    item = np.array(c["words"], np.int64)
                    for d in c["diagonals"]:
                        for a, b in _hits(words, item, d, width):
                            marks[a] += 1
                            marks[b] -= 1
                            own.add(c["name"])
                inside = np.cumsum(marks[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                n_words.append(len(words))
                n_hit.append(int(inside.sum()))
                names.append(sorted(own))
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_columns], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*columns, "n_words", "n_hit", "items", "spans"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return joined.mapInArrow(verify, f"{kinds}, n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>")


def digest(items: list[str]) -> str:
    """What a query's items_sha256 is, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
