"""Token counts under a unigram vocabulary, with forward scores shared by common prefixes.

A text's pre-tokens are its words with a leading word mark. The best segmentation of a prefix
depends on the prefix alone, so pre-tokens that begin alike share its score: each task puts its
distinct, still unknown pre-tokens into a trie, which is walked in sorted order with the scores
of the current path on a stack, and computes one forward step per trie node. The number of tokens
of the best path is stored at each terminal and looked up for every text. No shuffle is needed.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_ENTRIES = 1_000_000
SPACES = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


class UnigramTrie:
    """Token counts of pre-tokens; scores: log probability by piece.

    A character that no piece covers costs one token for each of its UTF-8 bytes, with `byte_score`
    each. Of equal scores the segmentation with fewer tokens counts.
    """

    def __init__(self, scores: dict[str, float], byte_score: float) -> None:
        self.scores, self.byte_score = scores, byte_score
        self.endings = {piece[i:] for piece in scores for i in range(len(piece))}
        self.terminals: dict[str, int] = {}
        self.nodes = 0

    def insert(self, words: set[str]) -> None:
        """Computes and stores the counts of these pre-tokens."""
        scores, endings = self.scores, self.endings
        best: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) of each prefix on the path
        last = ""
        for word in sorted(words):
            depth = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                n = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top = (best[end - 1][0] + n * self.byte_score, best[end - 1][1] - n)
                start = end - 1
                while start >= 0 and (piece := word[start:end]) in endings:
                    score = scores.get(piece)
                    if score is not None:
                        before = best[start]
                        top = max(top, (before[0] + score, before[1] - 1))
                    start -= 1
                best.append(top)
                self.nodes += 1
            last = word
            self.terminals[word] = -best[-1][1]

    def counts(self, texts: list[list[str]]) -> list[int]:
        missing = {w for t in texts for w in t if w not in self.terminals}
        if len(self.terminals) + len(missing) > CACHE_ENTRIES:
            self.terminals = {}
            missing = {w for t in texts for w in t}
        self.insert(missing)
        return [sum(map(self.terminals.__getitem__, t)) for t in texts]


@lru_cache(maxsize=2)
def piece_trie(path: str) -> UnigramTrie:
    """A trie over the pieces of a sentencepiece file; one for each worker process.

    The file's pieces are in order of frequency, and their log probability is taken by Zipf's law
    from that rank; bytes of characters outside the vocabulary rank after the last piece.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
    return UnigramTrie(scores, -math.log(len(pieces) + 1) - total)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_pretokens, n_tokens.

    Pre-tokens are what white space leaves of the text, each with a word mark before it. Null and
    empty texts have none and no tokens. Texts of any length count whole. Repeated rows and null
    ids come back once each; other columns are ignored; no rows give none.
    """

    def run(batches):
        trie = piece_trie(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                texts = [[MARK + w for w in (t or "").translate(SPACES).split(" ") if w] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(trie.counts(texts), pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
