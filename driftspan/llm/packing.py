"""Best-fit packing of documents into fixed-length sequences after a dominance reduction.

Documents become token ids with an end id, and pieces of at most `capacity` ids. Packing needs
only how many pieces there are of each length, so the plan is made from that table, which has
at most `capacity` rows however large the corpus is:

1. Reduction (Martello and Toth). With item j in a bin, a set {j, k} dominates every other set
   that holds j if the other items of any such set weigh no more than k together: exchanging
   them loses nothing. That is proven here when k fills the bin exactly, or when no two or more
   of the smaller items reach a weight above k that still fits. Such sets are fixed for good
   and leave the instance.
2. Best fit, in decreasing length, for what remains.

Both work on counts, so equal bins are one pattern with a multiplicity. The pieces then get
their rank among the pieces of their length, and the rank gives sequence and offset.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed

END_ID = 2
#: Rows ranked together in one task.
RANK_ROWS = 50_000

#: Fixed pattern: how the byte-level pre-tokenizer cuts a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are left to the tokenizers library, whose cost is linear for any text.
FAST_CHARS = 1 << 20
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible characters stand for their byte, others for U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes: what
    Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives.

    A byte-level BPE whose merges stand in the order of their ids is also what tiktoken computes
    from the same vocabulary, several times faster and without a cache. It is used for texts of
    Latin letters, whose character classes both libraries share. Texts with an added token or with
    other scripts, and tokenizers of another kind, go through the tokenizers library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        added = [re.escape(t["content"]) for t in settings["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None
        self.fast = self._ranked(settings)

    @staticmethod
    def _ranked(settings: dict):
        """encode_ordinary over the tokenizer's own vocabulary, or None if it is of another kind."""
        model, cut = settings["model"], settings["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        first = len(_byte_letters())
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and settings["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        if not plain or any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(merges)):
            return None
        from tiktoken import Encoding

        byte = {letter: b for b, letter in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if i < first + len(merges)}
        return Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and len(text) <= FAST_CHARS and not _OTHER.search(text) and not (self.added and self.added.search(text)):
            return array("I", self.fast(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids or ids_crc32, place) of all pieces; place is unique per row.

    A document of more than `capacity` ids is cut so that only its first piece may be shorter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    payload = "ids binary" if ids else "ids_crc32 long"
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode, row = encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                source, number, start, length, out = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    data = encode(text) + end
                    n = len(data) // 4
                    count = -(-n // capacity)
                    for k in range(count):
                        a, b = (max(0, n - (count - k) * capacity), n - (count - k - 1) * capacity)
                        source.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        out.append(data[4 * a : 4 * b] if ids else zlib.crc32(data[4 * a : 4 * b]))
                place = np.arange(row, row + len(source))
                row += len(source)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary() if ids else pa.int64()), pa.array(place, pa.int64())],
                    names=["id", "piece", "start", "length", payload.split()[0], "place"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, {payload}, place long")


def _reachable(lengths: list[int], most: int) -> int:
    """Bit s is set if two or more of these lengths, each any number of times, can weigh s <= most."""
    mask = (1 << (most + 1)) - 1
    one = 0
    for x in lengths:
        if x <= most:
            one |= 1 << x
    many, step = 0, one
    while step:
        grown = 0
        for x in lengths:
            if x <= most:
                grown |= step << x
        step = grown & mask & ~many
        many |= step
    return many


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], dict[int, int]]:
    """(patterns fixed for good with their multiplicities, remaining counts)."""
    left = {x: n for x, n in counts.items() if n}
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(pattern: tuple[tuple[int, int], ...], times: int) -> None:
        fixed.append((pattern, times))
        for x, q in pattern:
            left[x] -= q * times
            if not left[x]:
                del left[x]

    again = True
    while again:
        again = False
        present = sorted(left)
        sums = _reachable(present, capacity - present[0]) if present else 0  # a superset, as counts only fall
        for j in reversed(present):
            while j in left:
                room = capacity - j
                fitting = [x for x in left if x <= room and (x != j or left[j] > 1)]
                if not fitting:
                    take(((j, 1),), left[j])
                    again = True
                    break
                k = max(fitting)
                if k != room and (sums & ((1 << (room + 1)) - 1)) >> (k + 1):
                    break
                if k == j:
                    take(((j, 2),), left[j] // 2)
                else:
                    take(((max(j, k), 1), (min(j, k), 1)), min(left[j], left[k]))
                again = True
    return fixed, left


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit-decreasing on counts: patterns ((length, times), ...) with multiplicities."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((pattern, times))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, pattern, times = capacity, (), n
            each = room // x
            full = min(times, n // each)
            put(room - each * x, (*pattern, (x, each)), full)
            n -= full * each
            times -= full
            if n and times:
                last = min(n, each)
                put(room - last * x, (*pattern, (x, last)), 1)
                n -= last
                times -= 1
            if pattern:
                put(room, pattern, times)
    return [b for room in rooms for b in bins[room]]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, times per sequence, first sequence, first offset) by rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in [*fixed, *best_fit_decreasing(left, capacity)]:
        offset = 0
        for x, q in pattern:
            slots.setdefault(x, []).append((ranks[x], q, sequence, offset))
            ranks[x] += q * times
            offset += q * x
        sequence += times
    if ranks != counts:
        raise AssertionError("the plan places other pieces than there are")
    return {x: np.array(rows, np.int64) for x, rows in slots.items()}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids (or ids_crc32), sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and ids are packed once each; null
    ids are kept. Texts of any length are cut, never shortened. An added token's string in a text
    is that token, as the tokenizer has it. Other columns are ignored; no rows give no sequences.
    Sequences have no gaps before their last piece; offset is a piece's place in its sequence.
    """
    spark = docs.sparkSession
    rows = checkpointed(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.sparkContext.broadcast(plan(counts, capacity))

    # ranks within a length: salted, so that no length is one task's work
    salts = max(1, -(-sum(counts.values()) // RANK_ROWS)) * 4
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("place")) - 1)

    keep = ["id", "piece", "start", "length", "ids" if ids else "ids_crc32"]

    def place(batches):
        for batch in batches:
            n = batch.num_rows
            length, rank = (batch.column(len(keep) - 2).to_numpy(), batch.column(len(keep)).to_numpy())
            sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
            for x in np.unique(length).tolist():
                at, table = np.flatnonzero(length == x), slots.value[x]
                row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ranked.select(*keep, "rank").mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
