"""Document classes by supervised subword embeddings: a text is the average of the learned vectors
of its hashed words and character n-grams, and a softmax over that average gives its class.

Each word also counts by how far back it last stood in the text (new, next to it, up to 2, 4, ...
words before), as vectors of single words cannot tell running text from one word over and over.

Training is numpy stochastic gradient descent, a document at a time, on a bounded sample of the
labelled rows. In each epoch a fixed number of shards of the sample are each one Spark task that
starts from the same weights, and the driver averages what the shards return. No task holds more
than a batch of texts and the weights, and the driver holds one set of weights a shard.

The class of a text is linear in the average, so a cell's vector and the output layer reduce to one
number per class; scoring sums these over all features of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed
from ._text import SPACED, U64, hash_words, mix, text_slices

#: Words and n-grams each have 2**BITS cells, each with a vector of DIM numbers.
BITS, DIM = 16, 8
#: Lengths of the n-grams, in characters.
ORDERS = (2, 3, 4)
#: Labelled documents that training uses at most: those whose ids have the smallest hashes.
TRAIN_ROWS = 8192
SHARDS, EPOCHS = 8, 4
#: Steps of the output layer and of the vectors. An average over thousands of features moves little
#: when its parts do, so the vectors need the larger one.
OUTPUT_RATE, VECTOR_RATE = 0.5, 100.0
SEED = 11
#: Cells of the gaps between equal words.
GAPS = 64


@dataclass
class Weights:
    """vectors: cells x DIM; output: classes x DIM; bias: one number a class."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def cell_logits(self) -> np.ndarray:
        """What one feature of each cell adds to each class before the average: cells x classes."""
        return self.vectors.astype(np.float64) @ self.output.T.astype(np.float64)


def fresh_weights(classes: int) -> Weights:
    r = np.random.default_rng(SEED)
    return Weights(((r.random(((2 << BITS) + GAPS, DIM)) - 0.5) / DIM).astype(np.float32), (r.standard_normal((classes, DIM)) / DIM).astype(np.float32), np.zeros(classes, np.float32))


def _gaps(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word the power of two of the words since it stood in its text before, 0 where it is new."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((words, owner))
    again = np.flatnonzero((words[order[1:]] == words[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    out = np.zeros(len(words), np.int64)
    out[order[again + 1]] = np.frexp((order[again + 1] - order[again]).astype(np.float64))[1]
    return out


def feature_cells(column) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each run of whole texts: its first row, and for words, gaps between equal words and each
    n-gram length the cells with every text's first and end place in them."""
    for lo, _, data, offsets in text_slices(column):
        words, bounds = hash_words(data, offsets, SPACED)
        found = [((words >> U64(64 - BITS)).astype(np.int64), bounds[:-1], bounds[1:]), (_gaps(words, bounds) + (2 << BITS), bounds[:-1], bounds[1:])]
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(lead)])[offsets]
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        points = np.where((points >= 9) & (points <= 13), U64(32), points)
        for order in ORDERS:
            n = max(0, len(points) - order + 1)
            h = np.full(n, order, U64)
            for j in range(order):
                h = h * U64(0x9E3779B97F4A7C15) + points[j : j + n]
            cells = (mix(h) >> U64(64 - BITS)).astype(np.int64) + (1 << BITS)
            found.append((cells, np.minimum(ends[:-1], n), np.maximum(np.minimum(ends[:-1], n), ends[1:] - order + 1)))
        yield lo, found


def _descend(w: Weights, cells: np.ndarray, label: int, step: float) -> None:
    """One step for one document; a text without features moves the bias only."""
    if len(cells):
        counts = np.bincount(cells, minlength=len(w.vectors))
        used = np.flatnonzero(counts)
        share = (counts[used] / len(cells)).astype(np.float32)
        mean = share @ w.vectors[used]
    else:
        mean = np.zeros(w.vectors.shape[1], np.float32)
    logits = w.output @ mean + w.bias
    odds = np.exp(logits - logits.max())
    error = odds / odds.sum()
    error[label] -= 1
    back = error @ w.output
    w.output -= (step * OUTPUT_RATE) * np.outer(error, mean)
    w.bias -= (step * OUTPUT_RATE) * error
    if len(cells):
        w.vectors[used] -= (step * VECTOR_RATE) * np.outer(share, back)


def train_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents: those whose ids have the smallest hashes.

    An id's label is its smallest one, and of several texts of an id the one with the smallest hash
    counts; rows without an id or a label are left out.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    known = docs.select(F.col(id_col).alias("id")).filter("id is not null")
    own = own.groupBy("id").agg(F.min("label").alias("label")).join(known, "id", "left_semi")
    own = checkpointed(own.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "id")
    # few rows, so that the hot id of a table of repeats is merged before the shuffle
    return texts.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(sample: DataFrame, classes: int = 2, epochs: int = EPOCHS, shards: int = SHARDS) -> Weights:
    """The weights after `epochs` passes over the sample (id, text, label from 0 to classes - 1).

    Steps shrink from epoch to epoch in a straight line. Shards that lost no row weigh as many as
    they have rows. Without rows every class stays equally likely.
    """
    weights = fresh_weights(classes)
    size = weights.vectors.shape
    dealt = checkpointed(sample.select("id", "text", "label").repartition(shards))  # never more tasks, as each returns all weights
    for epoch in range(epochs):
        shared = sample.sparkSession.sparkContext.broadcast(weights)
        step = 1.0 - epoch / epochs

        def run(batches, shared=shared, step=step):
            start, n = shared.value, 0
            w = Weights(start.vectors.copy(), start.output.copy(), start.bias.copy())
            for batch in batches:
                labels = batch.column(1).to_pylist()
                for lo, families in feature_cells(batch.column(0)):
                    for i in range(len(families[0][1])):
                        _descend(w, np.concatenate([c[a[i] : b[i]] for c, a, b in families]), labels[lo + i], step)
                n += len(labels)
            if n:
                yield pa.RecordBatch.from_pydict({"n": [n], "vectors": [w.vectors.tobytes()], "output": [w.output.tobytes()], "bias": [w.bias.tobytes()]})

        found = dealt.sortWithinPartitions(F.xxhash64("id", F.lit(epoch))).select("text", "label").mapInArrow(run, "n long, vectors binary, output binary, bias binary").collect()
        total = sum(r["n"] for r in found)
        if not total:
            break
        mean = [sum(np.frombuffer(r[part], np.float32) * np.float32(r["n"] / total) for r in sorted(found, key=lambda r: (r["n"], r["bias"]))) for part in ("vectors", "output", "bias")]
        weights = Weights(mean[0].reshape(size), mean[1].reshape(classes, size[1]), mean[2])
        shared.destroy()
    return weights


def predict(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: id_col, the `keep` columns, and probabilities, an array by class.

    Every word and n-gram of the whole text counts. A null, empty or blank text has the odds that
    the bias alone (and a blank text's own spaces) give. Repeated rows and null ids come back once
    each; an empty table gives none.
    """
    logits = weights.cell_logits()
    shared = docs.sparkSession.sparkContext.broadcast((logits, weights.bias.astype(np.float64)))
    kept = docs.select(F.col(id_col), *(keep or []))
    schema, width = kept.schema, len(kept.columns)

    def run(batches):
        logits, bias = shared.value
        for batch in batches:
            odds = np.zeros((batch.num_rows, len(bias)))
            for lo, families in feature_cells(batch.column(width)):
                n = np.zeros(len(families[0][1]), np.int64)
                sums = np.zeros((len(n), len(bias)))
                for cells, starts, ends in families:
                    some = np.flatnonzero(ends > starts)
                    n += ends - starts
                    if len(some):
                        at = np.stack([starts[some], ends[some]], axis=1).ravel()
                        for k in range(len(bias)):
                            sums[some, k] += np.add.reduceat(np.append(logits[cells, k], 0.0), at)[::2]
                odds[lo : lo + len(n)] = sums / np.maximum(n, 1)[:, None] + bias
            odds = np.exp(odds - odds.max(1, keepdims=True)) if len(odds) else odds
            odds /= odds.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(list(odds), pa.list_(pa.float64()))], names=[*schema.names, "probabilities"])

    picked = docs.select(F.col(id_col), *(keep or []), F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", probabilities array<double>")
