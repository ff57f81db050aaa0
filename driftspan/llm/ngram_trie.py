"""A bigram language model held as Elias-Fano tries, learned from and applied to whole corpora.

Text goes through Spark as blocks of a few million tokens. A block sends its distinct words and
its distinct word pairs, never its text, to the shards of two trie levels, so a frequent word or
pair is one entry per block. Blocks and shards both grow with the square root of the corpus, so
that a message has some hundreds of pairs however large it is, and messages grow in proportion:

- level 1, sharded by word: the word hashes as an Elias-Fano sequence, with their counts;
- level 2, sharded by context word (a context with above an eighth of a shard's tokens by pair): contexts and
  their pointers into the successors are Elias-Fano sequences, and so are the successors, each
  given relative to its context and made monotone by the context's rank; a leaf has the
  quantised log probability count(context, word) / (count(context) + mu).

A shard writes its level to a file, maps it into memory and answers every block's entries by
successor search in the context's range. Blocks then score their documents:
p(word | context) = leaf + mu / (count(context) + mu) * p(word), which sums to one up to
the quantisation (a 65,000th of twelve decades). The first word's context is the end token.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed
from ._text import SPACED, U64, hashed_texts, mix
from .elias_fano import EliasFano, pack, unpack

END = mix(np.array([0x656E64], U64))
#: Tokens of a block and of a shard at least, and pairs that a block sends to a shard on average.
SIDE_TOKENS, MESSAGE_PAIRS = 4_000_000, 512
#: UTF-8 bytes of a token, to size the blocks before there are tokens.
TOKEN_BYTES = 6
#: Strength of the word distribution in a context; a few hundred suits contexts of all sizes.
MU = 300.0
_DECADES, _STEPS = 12.0, 65_534
_ROW = "kind string, block string, shard int, data binary, n long"
#: Contexts kept on the driver are at most so many (16 bytes each).
MOST_HOT = 1 << 20


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pack(list(arrays)))


def _expand(data: bytes) -> list[np.ndarray]:
    return unpack(zstandard.ZstdDecompressor().decompress(data))


def _by_frequency(values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct values, most frequent first, each value's place among them byte by byte, so that they compress)."""
    own, places, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(own), "<u4")
    rank[order] = np.arange(len(own), dtype="<u4")
    planes = rank[places].view(np.uint8).reshape(-1, 4)
    return own[order], [np.ascontiguousarray(planes[:, k]) for k in range(4)]


def _from_planes(planes: list[np.ndarray]) -> np.ndarray:
    return np.stack(planes, axis=1).reshape(-1).view("<u4")


def _squeeze_block(tokens: np.ndarray, sizes: np.ndarray) -> bytes:
    words, planes = _by_frequency(tokens)
    return _squeeze(words, *planes, sizes)


def _expand_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted words, each token's place among them, token counts of the documents)."""
    words, *planes, sizes = _expand(data)
    ranks = _from_planes(planes)
    order = np.argsort(words)
    place = np.empty(len(words), np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    return words[order], place[ranks], sizes


@contextmanager
def mapped(arrays: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The arrays, written to a file of this task and mapped into memory; the file goes at the end."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(pack(arrays))
        yield unpack(np.memmap(path, np.uint8, mode="r"))
    finally:
        os.unlink(path)


def _quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 is kept for absent entries."""
    return (1 + np.rint(np.clip(np.log10(p) / _DECADES + 1, 0, 1) * _STEPS)).astype(np.uint16)


def _dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 0, 0.0, 10.0 ** (((codes.astype(np.float64) - 1) / _STEPS - 1) * _DECADES))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


@dataclass
class NgramTrie:
    """levels: (kind level1 or level2, shard, data) rows; the rest is small and on the driver."""

    levels: DataFrame
    n_tokens: int
    n_types: int
    shards: int
    hot: tuple[np.ndarray, np.ndarray]
    mu: float


def side_tokens(n_tokens: int) -> int:
    """How many tokens blocks and shards have: n / side of each send (n / side)**2 messages, n / MESSAGE_PAIRS at most."""
    return max(SIDE_TOKENS, math.isqrt(MESSAGE_PAIRS * n_tokens))


def token_blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """(block, ids, held_out, data, n, n_train): documents as tokens of a block.

    data: the words' hashes, each token's word, each document's token count. A block lies in one
    partition of docs, so for large corpora these should be as large (spark.sql.files.maxPartitionBytes).
    """
    most = side_tokens((docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // TOKEN_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches):
        serial = 0
        ids: list[pa.Array] = []
        marks: list[bool] = []
        words: list[np.ndarray] = []

        def block():
            sizes = np.array([len(w) + 1 for w in words], np.int64)
            tokens = np.concatenate([x for w in words for x in (w, END)])
            learned = sizes[np.array(marks, bool)].sum()
            column = pa.concat_arrays(ids)
            row = [pa.array([f"{TaskContext.get().partitionId()}.{serial}"]), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.array([[not m for m in marks]], pa.list_(pa.bool_())), pa.array([_squeeze_block(tokens, sizes)], pa.binary()), pa.array([len(tokens)], pa.int64()), pa.array([int(learned)], pa.int64())]
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "held_out", "data", "n", "n_train"])

        held = 0
        for batch in batches:
            lo = 0
            for i, w in enumerate(hashed_texts(batch.column(1), SPACED)):
                words.append(w.copy())
                marks.append(bool(batch.column(2)[i].as_py()))
                held += len(w) + 1
                if held >= most:
                    ids.append(batch.column(0).slice(lo, i + 1 - lo))
                    lo = i + 1
                    yield block()
                    serial, held, ids, marks, words = serial + 1, 0, [], [], []
            if lo < batch.num_rows:
                ids.append(batch.column(0).slice(lo))
        if words:
            yield block()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return picked.mapInArrow(build, f"block string, ids array<{kind}>, held_out array<boolean>, data binary, n long, n_train long")


def _rows(rows: list[tuple]) -> pa.Table:
    kind, block, shard, data, n = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table([pa.array(kind, pa.string()), pa.array(block, pa.string()), pa.array(shard, pa.int32()), pa.array(data, pa.binary()), pa.array(n, pa.int64())], names=["kind", "block", "shard", "data", "n"])


def _learned(held_out: list[bool], places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(held_out, bool), sizes)


def _pairs(places: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Of each token, context place * 2**32 + place; a document's first token follows the end token."""
    before = np.empty(len(places), U64)
    before[1:] = places[:-1]
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = end
    return (before << U64(32)) | places.astype(U64)


def _pair_shards(vocabulary: np.ndarray, pairs: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    own = _shard_of(vocabulary, shards)
    out = own[(pairs >> U64(32)).astype(np.int64)]
    if len(hot):
        spread = np.isin(vocabulary, hot)[(pairs >> U64(32)).astype(np.int64)]
        out[spread] = (out[spread] + own[(pairs[spread] & U64(0xFFFFFFFF)).astype(np.int64)]) % shards
    return out


def _send_words(shards: int):
    def send(batches):
        for batch in batches:
            for block, marks, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                vocabulary, places, sizes = _expand_block(data)
                counts = np.bincount(places[_learned(marks, places, sizes)], minlength=len(vocabulary)).astype(np.uint32)
                cuts = np.searchsorted(_shard_of(vocabulary, shards), np.arange(shards + 1))
                yield from _rows([("ask", block, s, _squeeze(vocabulary[a:b], counts[a:b]), 0) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]).to_batches()

    return send


def _send_pairs(shards: int, hot):
    def send(batches):
        for batch in batches:
            for block, marks, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                vocabulary, places, sizes = _expand_block(data)
                end = int(np.searchsorted(vocabulary, END)[0])
                every = _pairs(places, sizes, end)
                pairs = np.unique(every)
                learned, n = np.unique(every[_learned(marks, places, sizes)], return_counts=True)
                counts = np.zeros(len(pairs), np.uint32)
                counts[np.searchsorted(pairs, learned)] = n
                to = _pair_shards(vocabulary, pairs, shards, hot.value[0])
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(shards + 1))
                rows = []
                for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        own = pairs[order[a:b]]
                        contexts, runs = np.unique(own >> U64(32), return_counts=True)
                        words, planes = _by_frequency((own & U64(0xFFFFFFFF)).astype(np.int64))
                        rows.append(("ask", block, s, _squeeze(vocabulary[contexts.astype(np.int64)], runs.astype(np.uint32), vocabulary[words], *planes, counts[order[a:b]]), 0))
                yield from _rows(rows).to_batches()

    return send


def _word_level(table: pa.Table, least: int) -> pa.Table:
    """Builds or takes one shard of level 1 and answers the blocks that ask with counts."""
    shard = table.column("shard")[0].as_py()
    asked, level, rows = [], None, []
    for kind, block, data in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == "level1":
            level = unpack(data)
        else:
            asked.append((block, *_expand(data)))
    if level is None:
        words, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([a[2] for a in asked])).astype(np.int64)
        words, counts = words[counts > 0], counts[counts > 0]
        level = [*EliasFano.build(words).to_arrays(), counts]
        rows.append(("level1", None, shard, pack(level), len(words)))
        rows += [("hot", None, shard, w.tobytes(), int(c)) for w, c in zip(words[counts > least], counts[counts > least], strict=True)]
    with mapped(level) as (header, low, high, counts):
        words = EliasFano(header, low, high)
        for block, asks, _ in asked:
            at = words.find(asks)
            rows.append(("counts", block, shard, _squeeze(np.where(at >= 0, counts[at] if len(counts) else 0, 0).astype(np.int64)), 0))
        del words, header, low, high, counts
    return _rows(rows)


def _pair_level(table: pa.Table, mu: float, hot: tuple[np.ndarray, np.ndarray], keep: bool) -> pa.Table:
    """Builds or takes one shard of level 2 and gives it (keep) or answers the blocks that ask with leaf codes."""
    shard = table.column("shard")[0].as_py()
    asked, level, rows = [], None, []
    for kind, block, data in zip(table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == "level2":
            level = unpack(data)
        else:
            contexts, runs, words, *planes, counts = _expand(data)
            asked.append((block, contexts, words[_from_planes(planes)], counts, runs))
    if level is None:
        level = _build_pairs(asked, mu, hot)
    if keep:
        return _rows([("level2", None, shard, pack(level), len(level[-1]))])
    with mapped(level) as arrays:
        contexts, pointers, words, successors = (EliasFano(*arrays[3 * k : 3 * k + 3]) for k in range(4))
        codes = arrays[12]
        for block, asks, after, _, runs in asked:
            out = np.zeros(len(after), np.uint16)
            row = contexts.find(asks)
            end = np.zeros(len(asks), np.int64)
            end[row >= 0] = pointers[row[row >= 0] + 1].astype(np.int64)
            row, end = np.repeat(row, runs), np.repeat(end, runs)
            own, at = np.unique(after, return_inverse=True)
            word = words.find(own)[at]
            known = np.flatnonzero((row >= 0) & (word >= 0))
            # successor search for the word relative to its context, within the context's range
            want = row[known].astype(U64) * U64(max(1, words.n)) + word[known].astype(U64)
            at = successors.next_geq(want)
            hit = np.flatnonzero(at < end[known])
            hit = hit[successors[at[hit]] == want[hit]]
            out[known[hit]] = codes[at[hit]]
            rows.append(("codes", block, shard, _squeeze(out), 0))
        del contexts, pointers, words, successors, codes, arrays
    return _rows(rows)


def _build_pairs(asked: list[tuple], mu: float, hot: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    counts = np.concatenate([a[3] for a in asked])
    learned = counts > 0
    counts = counts[learned].astype(np.int64)
    contexts, row = np.unique(np.concatenate([np.repeat(a[1], a[4]) for a in asked])[learned], return_inverse=True)
    words, word = np.unique(np.concatenate([a[2] for a in asked])[learned], return_inverse=True)
    relative, at = np.unique(row.astype(U64) * U64(max(1, len(words))) + word.astype(U64), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(relative)) if len(relative) else np.empty(0)
    row = (relative // U64(max(1, len(words)))).astype(np.int64)
    of_context = np.bincount(row, weights=total, minlength=len(contexts)) if len(relative) else np.empty(0)
    names, totals = hot
    if len(names) and len(contexts):  # these contexts have successors in other shards too
        near = np.minimum(np.searchsorted(names, contexts), len(names) - 1)
        of_context = np.where(names[near] == contexts, totals[near], of_context)
    pointers = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(contexts)))]).astype(U64)
    codes = _quantise(total / (of_context[row] + mu)) if len(relative) else np.empty(0, np.uint16)
    return [x for v in (contexts, pointers, words, relative) for x in EliasFano.build(v).to_arrays()] + [codes]


def _score(table: pa.Table, n_tokens: int, n_types: int, shards: int, hot: np.ndarray, mu: float) -> pa.Table:
    """Scores of one block's documents from the answers of both levels."""
    counts, codes, own = {}, {}, None
    for i, kind in enumerate(table.column("kind").to_pylist()):
        if kind == "block":
            own = table.slice(i, 1)
        else:
            (counts if kind == "counts" else codes)[table.column("shard")[i].as_py()] = _expand(table.column("data")[i].as_py())[0]
    vocabulary, places, sizes = _expand_block(own.column("data")[0].as_py())
    c = np.concatenate([counts[s] for s in sorted(counts)]).astype(np.float64)
    single = (c + 0.5) / (n_tokens + 0.5 * (n_types + 1))
    every = _pairs(places, sizes, int(np.searchsorted(vocabulary, END)[0]))
    pairs, at = np.unique(every, return_inverse=True)
    to = _pair_shards(vocabulary, pairs, shards, hot)
    leaf = np.zeros(len(pairs), np.uint16)
    if codes:  # each shard answers its pairs in their order
        leaf[np.argsort(to, kind="stable")] = np.concatenate([codes[s] for s in sorted(codes)])
    context, word = (pairs >> U64(32)).astype(np.int64), (pairs & U64(0xFFFFFFFF)).astype(np.int64)
    logs = np.log10(_dequantise(leaf) + mu / (c[context] + mu) * single[word])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    known = np.add.reduceat((c > 0)[places].astype(np.int64), starts)
    out = [own.column("ids").combine_chunks().flatten(), own.column("held_out").combine_chunks().flatten(), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n_tokens, np.int64)), pa.array(np.add.reduceat(np.log10(single)[places], starts)), pa.array(np.add.reduceat(logs[at], starts))]
    return pa.table(out, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _by_shard(rows: DataFrame, shards: int):
    """Rows grouped by shard, each shard a partition of its own."""
    return rows.repartitionById(shards, F.col("shard")).groupBy("shard")


def _apply(blocks: DataFrame, id_col: str, kind: str, model: NgramTrie | None, n_tokens: int, shards: int, mu: float) -> tuple[DataFrame, NgramTrie]:
    source, context = blocks.select("block", "held_out", "data"), blocks.sparkSession.sparkContext
    least = max(n_tokens // MOST_HOT, n_tokens // (8 * shards))
    asks = source.mapInArrow(_send_words(shards), _ROW)
    if model:
        asks = asks.union(model.levels.filter("kind = 'level1'"))
    first = checkpointed(_by_shard(asks, shards).applyInArrow(lambda t: _word_level(t, least), _ROW))
    if model:
        n_types, hot = model.n_types, model.hot
    else:
        n_types = first.filter("kind = 'level1'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        found = first.filter("kind = 'hot'").select("data", "n").collect()  # MOST_HOT and n_tokens / least rows at most
        names, totals = np.frombuffer(b"".join(bytes(r["data"]) for r in found), U64), np.array([r["n"] for r in found], np.int64)
        hot = (names[np.argsort(names)], totals[np.argsort(names)])
    shared = context.broadcast(hot)
    asks = source.mapInArrow(_send_pairs(shards, shared), _ROW)
    if model:
        asks = asks.union(model.levels.filter("kind = 'level2'"))

    def second(keep: bool) -> DataFrame:
        return _by_shard(asks, shards).applyInArrow(lambda t: _pair_level(t, mu, shared.value, keep), _ROW)

    if not model:
        model = NgramTrie(first.filter("kind = 'level1'").union(second(True)), n_tokens, n_types, shards, hot, mu)
    empty = blocks.select("ids", "held_out").schema
    answers = first.filter("kind = 'counts'").union(second(False)).select("kind", "block", "shard", "data", F.lit(None).cast(empty["ids"].dataType).alias("ids"), F.lit(None).cast(empty["held_out"].dataType).alias("held_out"))
    rows = blocks.select(F.lit("block").alias("kind"), "block", F.lit(-1).alias("shard"), "data", "ids", "held_out").union(answers)
    scores = rows.groupBy("block").applyInArrow(lambda t: _score(t, n_tokens, n_types, shards, shared.value[0], mu), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores.withColumnRenamed("id", id_col), model


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> tuple[DataFrame, NgramTrie]:
    """(scores, model): learns from the rows where train holds and scores all rows.

    scores has one row per input row: id_col, held_out (not trained on), n_tokens, n_known,
    train_tokens, base_score and score, both log10. Tokens are what white space leaves of the
    text with A-Z lower-cased, and one end. Null and empty texts are the end alone. Repeated rows
    count and are scored once each; null ids are kept; a null train is false; without training
    rows every token is unknown. Other columns are ignored. Of a table without rows the scores are
    empty and the model has no tokens. The model's second level is made when it is first used:
    write model.levels to keep it.
    """
    blocks = checkpointed(token_blocks(docs, id_col, text_col, train))
    n_all, n_tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    return _apply(blocks, id_col, docs.schema[id_col].dataType.simpleString(), None, n_tokens, max(1, -(-n_all // side_tokens(n_all))), mu)


def score(docs: DataFrame, model: NgramTrie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same scores for other documents, all held out, from a fitted model."""
    blocks = checkpointed(token_blocks(docs, id_col, text_col, F.lit(False)))
    return _apply(blocks, id_col, docs.schema[id_col].dataType.simpleString(), model, model.n_tokens, model.shards, model.mu)[0]
