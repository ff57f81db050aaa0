"""The operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables
and clashing column names."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute as B

from driftspan.llm import _text, decontaminate, elias_fano, entry, euclid_lsh, jaccard, langid, ngram_trie, packing, quotes, revisits, sharding, token_counts

rng = np.random.default_rng(3)
WORDS = ["w%d" % i for i in range(60)] + ["Éa", "straße", "a-b", "x_y", "don't"]


def text(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def documents():
    base = text(60, 1)
    docs = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (5, "Two words"), (6, "two  WORDS"), (7, base), (8, base), (9, base.replace("w1 ", "q ", 1)), (10, base + " extra"), (11, text(3000, 2)), (12, "!!! 123 ..."), (13, "a  b \n c")]
    docs += [(20 + i, text(int(n), 50 + i)) for i, n in enumerate(rng.integers(1, 40, 30))]
    docs += [(60 + i, " ".join(w if j != i else "z%d" % i for j, w in enumerate(base.split()))) for i in range(40)]
    return docs


DOCS = documents()
SCHEMA = "doc_id long, text string, rep long, component string, `text_` string"


def frame(spark, docs):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "c", "x") for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 1, 2)])
def test_jaccard(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_LIMIT", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame(spark, DOCS), n=n, num=num, den=den).collect()}
    assert got == B.jaccard(DOCS, n, num, den)


def test_jaccard_empty_and_repeats(spark):
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    got = jaccard.jaccard_groups(frame(spark, [(5, "a b c d"), (5, "a b c d"), (2, "A b c D"), (None, "a b c d"), (None, "q")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 2), (2, 2), (5, 2), (5, 2)]


def test_contamination(spark):
    items = [(1, text(25, 1)), (2, "Two Words"), (3, None), (4, "?!"), (5, text(30, 52)), ("5b", "one"), (7, " ".join(text(60, 1).split()[20:32]))]
    items = [(str(i), t) for i, t in items]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, n_words int")
    found = decontaminate.contamination(frame(spark, DOCS), bench, width=10).collect()
    want = B.contamination(DOCS, items, 10)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), decontaminate.digest(r["items"])) for r in found} == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in found)
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(frame(spark, DOCS), bench.limit(0)).collect())


def test_proximity(spark):
    docs = frame(spark, [(1, "red big fox and blue cat"), (2, "blue x x x x x x x red"), (3, None)])
    queries = decontaminate.item_words(spark.createDataFrame([("q", "red blue")], "item_id string, text string"), "item_id", "text").select(F.col("item_id").alias("query_id"), "words")
    index = decontaminate.positional_index(docs, "doc_id", "text", queries.select(F.explode("words").alias("term")))
    assert [tuple(r) for r in decontaminate.proximity_matches(index, queries, 5).select("doc", "start", "end").collect()] == [(1, 0, 5)]


def test_proximity_against_brute_force(spark):
    r = np.random.default_rng(6)
    docs = [(i, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "x", "y", "z"], r.integers(3, 60)))) for i in range(60)]
    asked, slop = {"q1": "aa bb cc", "q2": "dd ee", "q3": "aa", "q4": "aa absent", "q5": "bb bb ee aa"}, 5
    queries = decontaminate.item_words(spark.createDataFrame(list(asked.items()), "item_id string, text string"), "item_id", "text").select(F.col("item_id").alias("query_id"), "words")
    index = decontaminate.positional_index(frame(spark, docs), "doc_id", "text", queries.select(F.explode("words").alias("term")))
    got = {(f["query_id"], f["doc"], f["start"], f["end"]) for f in decontaminate.proximity_matches(index, queries, slop).collect()}
    for q, text_ in asked.items():
        want = set(text_.split())
        for i, t in docs:
            w = t.split()
            own = {(a, b) for n, d, a, b in got if n == q and d == i}
            assert all(want <= set(w[a:b]) and b - a <= slop for a, b in own)
            fits = [(a, b) for a in range(len(w)) for b in range(a + 1, min(len(w), a + slop) + 1) if want <= set(w[a:b])]
            assert bool(fits) == bool(own)
            if fits:
                assert min(b - a for a, b in fits) == min(b - a for a, b in own)


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(euclid_lsh, "BLOCK_ROWS", 8)
    r = np.random.default_rng(1)
    centres = r.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + r.standard_normal(16) * 0.16).tolist(), int(i % 2)) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, [0.0] * 16, 0), (203, None, 0), (204, rows[0][1], None), (205, [float("nan")] * 16, 1), (206, [None] + [1.0] * 15, 1), (207, [1.0, 2.0], 0), (208, [], 1), (209, [x * 1e200 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], "vec_id long, embedding array<double>, label int, key string, rep int")
    x = {i: np.array(v) / np.abs(v).max() for i, v, l in rows if v and None not in v and l is not None and np.isfinite(v).all() and any(v)}
    lab = {i: l for i, _, l in rows}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(i, j) for i in x for j in x if i != j and lab[i] == lab[j] and len(x[i]) == len(x[j]) and cos(x[i], x[j]) >= 0.93]
    groups = B.closure([i for i, _, _ in rows], links)
    got = {r["vec_id"]: r for r in euclid_lsh.near_vectors(df).collect()}
    n = {i: sum(a == i for a, _ in links) for i in got}
    assert len(got) == len(rows) and len(links) > 200
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * len(links) and all(got[i]["n_links"] <= n[i] for i in got)
    assert sum(got[i]["component_id"] == groups[i] for i in got) >= 0.97 * len(got) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert euclid_lsh.near_vectors(df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = entry.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = [(900, "  lead"), (901, "x \n y\n\nz"), (902, "a   b\tc\n d 'tis it's"), (903, "日本語 テスト ü"), (904, "<|endoftext|> hi"), (905, "\x1c \x85 x"), (906, "tail "), (907, "see a\n\xa0 b"), (908, "price list\n\xa0\xa0item one"), (909, "x <|endoftext|> y"), (None, "no id"), (910, "twice"), (910, "twice"), (911, "é" * 40_000)]
    docs = DOCS + odd
    for ids in (True, False):
        got = packing.pack(frame(spark, docs), path, capacity=64, ids=ids).collect()
        ends, of = {}, {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= 64
        for r in sorted(got, key=lambda r: (r["piece"], r["start"])):
            of.setdefault(r["doc_id"], []).append(r)
        for i, x in docs:
            want, copies = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4"), 2 if i == 910 else 1
            assert sum(r["length"] for r in of[i]) == len(want) * copies and all(r["length"] == 64 for r in of[i] if r["piece"])
            own = of[i][::copies]
            assert [r["start"] for r in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
            cut = [want[r["start"] : r["start"] + r["length"]].tobytes() for r in own]
            assert [bytes(r["ids"]) if ids else r["ids_crc32"] for r in own] == (cut if ids else [zlib.crc32(c) for c in cut])
        assert len(ends) <= -(-sum(ends.values()) // 64) + 1
    assert packing.pack(frame(spark, []), path).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    import random

    from tokenizers import Tokenizer

    path = entry.tokenizer("byte_bpe_50k.json")
    t, encode, r = Tokenizer.from_file(path), packing.Encoder(path), random.Random(1)
    assert encode.fast
    atoms = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "\x1c", "'s", "'ll", "it's", "word", "A", "é", "ß", "1", "²", "½", "ª", "12", "...", "!", "<p>", "</p>", "&nbsp;", "<|endoftext|>", "<|", "_", "-", "’", "—", "日本", "ж", "€", "\x00", "\xad", "\ufeff", "\u200b", "\u0300"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(1, 9))) for _ in range(100_000)]
    texts += [x for c in map(chr, range(0x2100)) for x in (c, f"a{c}b {c}1")] + ["a" * 300_000, " " * 300_000, "ab " * 500_000]
    for x in texts:
        assert encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x[:60])
    other = packing.Encoder(entry.tokenizer("word_bpe_49k.json"))
    assert other.fast is None and other("Hello") == np.array(other.tokenizer.encode("Hello", add_special_tokens=False).ids, "<u4").tobytes()


def best_bins(lengths, capacity):
    """The least number of bins by search."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= lengths[k]:
                b = list(bins)
                b[b.index(room)] -= lengths[k]
                place(k + 1, b)
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_reduction_loses_nothing():
    for seed in range(60):
        r = np.random.default_rng(seed)
        lengths = r.integers(1, 21, r.integers(1, 9)).tolist()
        counts = {x: lengths.count(x) for x in set(lengths)}
        fixed, left = packing.reduce_by_dominance(dict(counts), 20)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + best_bins(rest, 20) == best_bins(lengths, 20)


def test_bigram_scores(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "SIDE_TOKENS", 700)
    monkeypatch.setattr(ngram_trie, "MESSAGE_PAIRS", 5)
    docs = DOCS + [(300 + i, "hot hot hot " + text(9, i)) for i in range(40)]
    scores, model = ngram_trie.fit_and_score(frame(spark, docs), ~(F.crc32(F.col("doc_id").cast("string")) % 5 == 1))
    want = B.bigrams(docs, lambda i: B.crc(i) % 5 != 1, ngram_trie.MU)
    assert model.shards > 2 and len(model.hot[0])

    def near(r, w):
        return (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 and abs(r["score"] - w[4]) <= 2e-4 * w[0] + 1e-9

    got = {r["doc_id"]: r for r in scores.collect()}
    assert set(got) == {i for i, _ in docs} and all(near(got[i], want[i]) for i in got)
    again = {r["doc_id"]: r for r in ngram_trie.score(frame(spark, docs), model).collect()}
    assert all(near(again[i], want[i]) for i in again)
    empty, m = ngram_trie.fit_and_score(frame(spark, []), F.lit(True))
    assert empty.count() == 0 and m.n_tokens == 0
    none, _ = ngram_trie.fit_and_score(frame(spark, [(1, "a b")]), F.lit(None).cast("boolean"))
    assert none.first()["n_known"] == 0


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 9), (40, 7), (900, 2**40), (900, 2**64 - 1)):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = elias_fano.EliasFano(*elias_fano.unpack(elias_fano.pack(elias_fano.EliasFano.build(v).to_arrays())))
        q = np.concatenate([v, v + np.uint64(1), r.integers(0, top, 50, dtype=np.uint64, endpoint=True)])
        assert (e[np.arange(n)] == v).all() and (e.next_geq(q) == np.searchsorted(v, q)).all()


def test_word_hashes():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "  x  ", "é\xa0É b", "b" * 5000 + " A"]
    got = [h.tolist() for h in _text.hashed_texts(pa.array(texts), _text.SPACED)]
    seen = {}
    for t, h in zip(texts, got, strict=True):
        w = B.words(t)
        assert len(w) == len(h) and all(seen.setdefault(a, b) == b for a, b in zip(w, h, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_language(spark):
    rows = [(i, ("the cat and the dog are here " if i % 2 else "le chat et le chien sont ici ") * (1 + i % 3), "en" if i % 2 else "fr") for i in range(40)]
    df = spark.createDataFrame([*rows, (90, None, "en"), (91, "the dog", None)], "doc_id long, text string, lang string")
    model = langid.train(df, "text", "lang")
    probe = spark.createDataFrame([(1, "the cats and dogs"), (2, "les chats et chiens"), (3, None), (4, ""), (5, "123 !?"), (6, "the " * 100_000), (6, "the " * 100_000)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(probe, model).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert all(0 <= r["score"] <= 1 for r in langid.predict(probe, model).collect())
    none = langid.train(df.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in langid.predict(probe, none).collect()} == {"und"} and langid.predict(probe.limit(0), model).count() == 0


@pytest.mark.parametrize("text_kept", [False, True])
def test_language_against_brute_force(spark, text_kept):
    import math

    r = np.random.default_rng(8)
    words = {"x": ["alpha", "beta", "Gamma", "ça"], "y": ["beta", "delta", "epsilon", "ñu"], "z": ["zeta", "eta", "gamma"]}
    rows = [(i, " ".join(r.choice(words[k], r.integers(1, 30))) + r.choice(["", "!", "  12\n"]), k) for i, k in enumerate(r.choice(list("xxxyz"), 120))]
    docs = spark.createDataFrame([(i, t, k, "n") for i, t, k in rows], "doc_id long, text string, lang string, score string").repartition(3)
    bits, orders = 12, (1, 2, 3)

    def cells(t):
        points = langid._normal(np.frombuffer(f" {t.lower()}  ".encode("utf-32-le"), "<u4"))
        return [c for o in orders for c, blank in zip(langid._cells(points, o, bits), langid._blank(points, o), strict=True) if not blank]

    counts = {k: np.full(1 << bits, 0.5) for k in words}
    for _, t, k in rows:
        for c in cells(t):
            counts[k][c] += 1
    prior = {k: math.log(sum(x[2] == k for x in rows) / len(rows)) for k in words}
    model = langid.train(docs, "text", "lang", bits=bits)
    found = langid.predict(docs, model, keep=[F.col("text"), F.col("lang")] if text_kept else None).collect()
    texts = {i: t for i, t, _ in rows}
    for f in found:
        c = cells(texts[f["doc_id"]])
        log = {k: sum(math.log(counts[k][x] / counts[k].sum()) for x in c) for k in words}
        best = max(sorted(words), key=lambda k: log[k] + prior[k])
        post = {k: log[k] / math.sqrt(len(texts[f["doc_id"]]) + 3) + prior[k] for k in words}
        assert f["lang_pred"] == best and abs(f["score"] - 1 / sum(math.exp(post[k] - post[best]) for k in words)) < 1e-4


def test_token_counts(spark):
    scores = {"▁": -1.0, "▁a": -1.5, "a": -2.0, "ab": -2.2, "b": -2.5, "▁ab": -3.0, "aba": -9.0}

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            best.append(max([(best[e - 1][0] - 7.0 * n, best[e - 1][1] - n), *((best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(e) if word[s:e] in scores)]))
        return -best[-1][1]

    trie = token_counts.UnigramTrie(scores, -7.0)
    words = ["▁" + "".join(rng.choice(list("abcé"), rng.integers(0, 8))) for _ in range(300)]
    assert [trie.counts([words[i : i + 7]]) for i in range(0, 300, 7)] == [[sum(map(brute, words[i : i + 7]))] for i in range(0, 300, 7)]
    known = trie.nodes
    trie.counts([words])  # nothing is computed twice
    assert trie.nodes == known
    assert all(trie.terminals[w] == brute(w) for w in words) and trie.nodes <= sum(len(w) for w in set(words))
    real = token_counts.piece_trie(entry.tokenizer("piece_bpe_32k.model"))
    longest = max(map(len, real.scores))

    def tokens(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            n = len(word[e - 1].encode())
            best.append(max([(best[e - 1][0] + n * real.byte_score, best[e - 1][1] - n), *((best[k][0] + real.scores[word[k:e]], best[k][1] - 1) for k in range(max(0, e - longest), e) if word[k:e] in real.scores)]))
        return -best[-1][1]

    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, DOCS), entry.tokenizer("piece_bpe_32k.model")).collect()}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[7] == got[7] and got[7]["n_tokens"] == got[8]["n_tokens"] > 0
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: sum(tokens("▁" + w) for w in B.re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in DOCS}
    assert token_counts.token_counts(frame(spark, []), entry.tokenizer("piece_bpe_32k.model")).count() == 0
    twice = token_counts.token_counts(frame(spark, [(None, "a b"), (1, "a"), (1, "a")]), entry.tokenizer("piece_bpe_32k.model")).collect()
    assert sorted((r["doc_id"] or 0, r["n_pretokens"]) for r in twice) == [(0, 2), (1, 1), (1, 1)]
    assert {i: r["n_pretokens"] for i, r in got.items()} == {i: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, t in DOCS}


def test_shards(spark):
    import hashlib

    limit = 700
    got = {r["doc_id"]: r for r in sharding.extendible_shards(frame(spark, DOCS), limit, round_bits=2).collect()}
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i, _ in DOCS}
    size = {i: len((t or "").encode()) for i, t in DOCS}
    for i, _ in DOCS:
        depth = next(d for d in range(61) if d == 60 or sum(size[j] for j in h if h[j] >> (60 - d) == h[i] >> (60 - d)) <= limit)
        want = format(h[i], "060b")[:depth]
        assert (got[i]["shard"], got[i]["depth"], got[i]["n_bytes"]) == (want, depth, size[i])
    assert sharding.extendible_shards(frame(spark, []), limit).count() == 0
    assert {r["shard"] for r in sharding.extendible_shards(frame(spark, DOCS[:8]), 10**9).collect()} == {""}


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): v for a, v in k.items()}
    rec = [
        ("r1", "http://WWW.a.org/x?utm_q=1", 10, "response", 200, h(etag='"1"', content_type="t", date="d1")), ("r2", "https://a.org/x", 20, "response", 200, h(etag='"2"', last_modified="m2")), ("r3", "https://a.org/x", 30, "response", 404, h(etag='"9"')),
        ("v1", "https://a.org/x#f", 15, "revisit", 304, h(etag='W/"1"', date="d9", content_type="bad")), ("v2", "https://a.org/x", 40, "revisit", 304, h(etag='"1"')), ("v3", "https://a.org/x", 40, "revisit", 304, h(last_modified="m2")),
        ("v4", "https://a.org/x", 10, "revisit", 304, h(etag='"1"')), ("v5", None, 40, "revisit", 304, None), ("v6", "https://a.org/x", None, "revisit", 304, None), ("v7", "https://a.org/x", 40, "revisit", 304, None), ("v7", "https://a.org/x", 40, "revisit", 304, None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rec], "record_id string, url string, ts long, kind string, status int, headers map<string,string>, found string")
    got = revisits.resolve_revisits(df)
    assert sorted((r["record_id"], r["response_id"] or "", r["outcome"]) for r in got.collect()) == [("v1", "r1", "resolved"), ("v2", "r2", "modified"), ("v3", "r2", "resolved"), ("v4", "", "missing"), ("v5", "", "missing"), ("v6", "", "missing"), ("v7", "r2", "unverified"), ("v7", "r2", "unverified")]
    assert got.filter("record_id = 'v1'").first()["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "d9"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_quotes(spark):
    m = [
        (1, 0, "Hello there\nfriend"), (1, 1, "> hello  THERE\n> friend\nYes"), (1, 2, "> > Hello there\n> > friend\n> Yes\nSo"), (1, 3, "> Hello there\n> friend\nBranch"), (1, 4, ">\n> unknown\nNo link"), (1, 5, None),
        (2, 0, "> Hello there\n> friend\nother conversation"), (None, 0, "> x\ny"), (3, 7, "alone"),
    ]
    df = spark.createDataFrame([(*x, "p") for x in m], "conv_id long, turn long, text string, path string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(df).collect()}
    assert {k: (r["own_text"], r["n_quotes"], r["n_linked"], r["parent_turn"]) for k, r in got.items()} == {
        (1, 0): ("Hello there\nfriend", 0, 0, None), (1, 1): ("Yes", 1, 1, 0), (1, 2): ("So", 2, 2, 1), (1, 3): ("Branch", 1, 1, 0), (1, 4): ("No link", 1, 0, 3), (1, 5): ("", 0, 0, 4), (2, 0): ("other conversation", 1, 0, None), (None, 0): ("y", 0, 0, None), (3, 7): ("alone", 0, 0, None)
    }
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["path"])] == [0, 1, 2, 3, 4, 5]
    assert quotes.link_quotes(df.limit(0)).count() == 0
    mail = ["Dear all,\nfirst point\n\nsecond point\nin two lines\n\nregards", "thanks\nnoted", "> first point\n\nagreed\n\n> second point\n> in two lines\nno", "> in two lines\n>\n> regards\n> something else\n\nlast", "> regards\n> some longer line that nobody wrote\nnone", "> Dear all,\n> first point\n\n> second point\n> in two lines\nall"]
    got = {r["turn"]: (r["own_text"], r["n_quotes"], r["n_linked"], r["parent_turn"]) for r in quotes.link_quotes(spark.createDataFrame([(1, i, x) for i, x in enumerate(mail)], "conv_id long, turn long, text string")).collect()}
    # single lines and paragraphs of a message, answers in between, a passage over paragraphs by its lines, too small a share, a quote with an unmarked blank line
    assert got == {0: (mail[0], 0, 0, None), 1: (mail[1], 0, 0, 0), 2: ("agreed\n\nno", 2, 2, 0), 3: ("last", 1, 1, 0), 4: ("none", 1, 0, 3), 5: ("all", 2, 2, 0)}
    base = 1_764_000_000_000
    turns = [(1, base + k, t) for k, t in ((0, "one"), (1, "two"), (2, "> one\nreply to one"), (3, "> two\nreply to two"))] + [(2, -5, "x"), (2, 7, "> x\ny"), (2, 7, "> x\ny")]
    turns.append((3, 0, "line\n" * 20_000 + "> q"))
    paths = quotes.link_quotes(spark.createDataFrame(turns, "conv_id long, turn long, text string")).collect()
    order = lambda c: [r["turn"] for r in sorted((r for r in paths if r["conv_id"] == c), key=lambda r: r["path"])]
    assert order(1) == [base, base + 1, base + 3, base + 2] and order(2) == [-5, 7, 7] and order(3) == [0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    docs = [(i, "the cat and dog sat on mat number " + text(30, i), "en", "s", 1) for i in range(20)] + [(50, "123 ... !", "en", "s", 1), (51, docs_text := "the cat and dog sat on mat number " + text(30, 3), "en", "s", 1), (52, "before " + text(40, 99) + " after", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(40, 99))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in got} == set(range(20)) and docs_text
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in P.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert set(stage.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
