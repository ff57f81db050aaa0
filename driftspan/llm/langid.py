"""Language identification by multinomial naive Bayes over hashed character n-grams.

Every text counts whole. Training adds up n-gram counts per language and hash cell on the
executors; the model is one matrix of log probabilities, cells by languages, whose size the
parameters bound. Scoring is a product of the texts' sparse n-gram counts with that matrix, done
for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 16
ORDERS = (1, 2, 3)
#: The model holds at most so many languages; more are refused.
MOST_LANGUAGES = 256
SLICE_CHARS = 1 << 19
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray  # cells x languages, float32


def _slices(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, bounds) of runs of whole lower-cased texts, each between spaces.

    Two spaces end a text, so that all n-grams that reach into the next text begin with blanks.
    """
    lo, held, parts = 0, 0, []
    for i, t in enumerate(texts):
        parts.append(f" {(t or '').lower()}  ")
        held += len(parts[-1])
        if held >= SLICE_CHARS or i == len(texts) - 1:
            yield lo, np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            lo, held, parts = i + 1, 0, []


def _cells(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hash cell of the n-gram that starts at each code point, white space as one space."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, order, np.uint32)
    for j in range(order):
        h = (h ^ points[j : j + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _blank(points: np.ndarray, order: int) -> np.ndarray:
    """Which n-grams are a run of blanks, or start with two: they tell nothing."""
    n = len(points) - order + 1
    out = points[:n] == 32
    return out & (points[1 : n + 1] == 32) if order > 1 else out


def _normal(points: np.ndarray) -> np.ndarray:
    """Digits, punctuation and controls of ASCII count as a space, so that they tell nothing."""
    letter = (points > 127) | ((points >= 97) & (points <= 122))
    return np.where(letter, points, np.uint32(32))


def train(docs: DataFrame, text_col: str, lang_col: str, bits: int = CELL_BITS, orders: tuple[int, ...] = ORDERS) -> Model:
    """The model of all rows with a text and a language.

    Counts are per language and cell: at most MOST_LANGUAGES * 2**bits rows come to the driver.
    More than MOST_LANGUAGES languages are a ValueError; none is left out.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    prior = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(prior) > MOST_LANGUAGES:
        raise ValueError(f"column {lang_col} has more than {MOST_LANGUAGES} languages")
    languages = sorted(prior)
    place = {x: i for i, x in enumerate(languages)}
    size = 1 << bits

    def count(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for lo, points, bounds in _slices(batch.column(0).to_pylist()):
                points = _normal(points)
                owner = np.array([place.get(x, -1) for x in names[lo : lo + len(bounds) - 1]])
                for lang in set(owner.tolist()) - {-1}:
                    own = np.concatenate([points[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(owner == lang)])
                    total = counts.setdefault(lang, np.zeros(size, np.int64))
                    for order in orders:
                        total += np.bincount(_cells(own, order, bits)[~_blank(own, order)], minlength=size)
        for lang, total in counts.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), lang), pa.int32()), pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["lang", "cell", "n"])

    found = rows.mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((size, max(1, len(languages))))
    counts[found["cell"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    smooth = (counts + 0.5) / (counts.sum(0) + 0.5 * size)
    total = sum(prior.values())
    return Model(languages, np.log([prior[x] / total for x in languages] or [1.0]), np.log(smooth).astype(np.float32))


def _sparse_counts(points: np.ndarray, bounds: np.ndarray, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cells, counts): each text's distinct n-gram cells in order, and how often it has them."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds)) << np.uint64(bits)
    keys = []
    for order in orders:
        cells = _cells(points, order, bits)
        use = np.flatnonzero(~_blank(points, order)) if len(cells) else np.empty(0, np.int64)
        keys.append(owner[use] | cells[use].astype(np.uint64))
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), counts


def _times(rows: np.ndarray, cells: np.ndarray, counts: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times a matrix of cells by columns, in double precision."""
    out = np.zeros((n, matrix.shape[1]))
    if len(rows):
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        for k in range(matrix.shape[1]):
            out[rows[starts], k] = np.add.reduceat(counts * matrix[:, k][cells].astype(np.float64), starts)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, bits: int = CELL_BITS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """One row per input row: id_col, the `keep` columns, lang_pred and score.

    lang_pred is the language of the highest posterior, ties to the first in order of name; score
    is that posterior of the text's mean n-gram times the square root of their number, so it is 0
    to 1 and does not saturate with length. A null text or one without a letter is `und` with
    score 0; so is everything when nothing was learned. Repeated rows and null ids come back once
    each. Only the text decides. A `keep` column of the name text_col is taken as the text itself,
    which then goes to the workers once. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col), *(keep or []))
    schema = picked.schema
    width = len(schema)
    if text_col in schema.names:
        at = schema.names.index(text_col)
    else:
        picked, at = docs.select(F.col(id_col), *(keep or []), F.col(text_col).alias("__text")), width

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(at).to_pylist()
            for lo, raw, bounds in _slices(texts):
                rows, cells, counts = _sparse_counts(_normal(raw), bounds, orders, len(m.log_probability).bit_length() - 1)
                sums = _times(rows, cells, counts, m.log_probability, len(bounds) - 1)
                n = np.maximum(np.diff(bounds), 1).astype(np.float64)
                best = np.argmax(sums + m.log_prior, axis=1)
                tempered = sums / np.sqrt(n)[:, None] + m.log_prior
                tempered = np.exp(tempered - tempered.max(1, keepdims=True))
                post = tempered[np.arange(len(best)), best] / tempered.sum(1)
                for i, b in enumerate(best.tolist()):
                    t = texts[lo + i]
                    known = bool(m.languages) and t is not None and any(map(str.isalpha, t))
                    langs.append(m.languages[b] if known else UNKNOWN)
                    scores.append(float(post[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*schema.names, "lang_pred", "score"])

    return picked.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double")
