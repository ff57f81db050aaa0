"""Interval joins over a time tree and edits composed by doubling, against plain loops."""

import random

import pytest

from driftspan.operators import labels as L
from driftspan.operators import sequence as Q

YEARS = 100 * 366 * 86_400_000_000


def test_active_at_any_length(spark):
    rng = random.Random(3)
    probes = [(i, rng.choice("ab"), rng.randint(-(10**9), 10**9)) for i in range(200)] + [(900, None, 5), (901, "a", None)]
    spans = [(0, "a", -YEARS, YEARS), (1, "a", -(10**9), None), (2, "b", 0, 0), (3, "b", 5, 4), (4, None, 0, 9), (5, "a", None, 9), (6, "b", 10**9, 10**9 + 1)]
    spans += [(10 + i, rng.choice("ab"), s := rng.randint(-(10**9), 10**9), rng.choice([None, s + 1, s + 60, s + rng.randint(1, 10**9)])) for i in range(60)]
    spans += [(100, "b", probes[0][2], probes[0][2] + 1), (101, "b", 10**9 + 5, None)]
    want = sorted((p, i) for p, k, at in probes for i, key, s, e in spans if k and at is not None and k == key and s is not None and s <= at and (e is None or at < e))
    for grain in (1, 7, 60_000_000):
        i, p = spark.createDataFrame(spans, "id long, key string, start long, end long"), spark.createDataFrame(probes, "id long, key string, at long")
        assert sorted(map(tuple, Q.active_at(i, p, "key", grain).collect())) == want
    assert Q.active_at(i, p.limit(0), "key", 10).count() == 0


def history(n, seed, most=12):
    """Revisions of a page and each line's source, by replaying."""
    rng, out, lines, want = random.Random(seed), [], 0, {}
    sources = []
    for seq in range(n):
        hunks, fresh, at = [], [], 0
        while at <= lines and len(hunks) < 3:
            at = rng.randint(at, lines)
            removed = rng.randint(0, min(2, lines - at))
            hunks.append((at, removed, rng.randint(0, 3 if lines < most else 0)))
            at += removed + 1
        if rng.random() < 0.1:
            hunks = []
        from_ = 0
        for h in hunks:
            fresh += sources[from_ : h[0]] + [seq] * h[2]
            from_ = h[0] + h[1]
        fresh += sources[from_:]
        if not hunks or not seq:
            fresh = [seq] * len(fresh)
        broken = bool(hunks) and rng.random() < 0.05 and seq > 0
        if broken:
            fresh = [seq] * (len(fresh) + 1)
        rng.shuffle(hunks)
        sources, lines = fresh, len(fresh)
        out.append((seq, lines, hunks))
        want[seq] = list(fresh)
    return out, want


@pytest.mark.parametrize("seed", [1, 2])
def test_line_sources_by_replay(spark, seed):
    pages = {f"p{k}": history(n, 10 * seed + k) for k, n in enumerate((1, 2, 40, 65))}
    rows = [(p, s, n, h) for p, (revs, _) in pages.items() for s, n, h in revs]
    rev = spark.createDataFrame(rows, "page string, seq long, n_lines int, hunks array<struct<at: int, removed: int, added: int>>")
    got = {}
    for r in sorted(L.line_sources(rev).collect(), key=lambda r: r["first_line"]):
        own = got.setdefault((r["page"], r["seq"]), [])
        assert len(own) == r["first_line"] and (not own or own[-1] != r["source"])
        own += [r["source"]] * r["lines"]
    assert got == {(p, s): x for p, (_, want) in pages.items() for s, x in want.items() if x}


def test_line_sources_of_a_long_page(spark):
    n = 20_000
    rev = spark.range(n).selectExpr("'p' as page", "id as seq", "case when id < 20 then cast(id + 1 as int) else 20 end as n_lines", "array(named_struct('at', 0, 'removed', 0, 'added', 1), named_struct('at', case when id < 20 then cast(id as int) else 19 end, 'removed', case when id < 20 then 0 else 1 end, 'added', 0)) as hunks")
    got = L.line_sources(rev)
    assert got.count() == 20 * n - 190 and got.filter("source <> seq - first_line or lines <> 1").count() == 0
