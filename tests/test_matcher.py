"""The set-based detector against a loop that keeps state, and the stream against the batch."""

import random


from driftspan.operators import detect as D


def loop(turns, k, most):
    """Matches by stepping through a world's parts with the state a matcher would keep."""
    out = []
    for world in sorted({t[0] for t in turns}):
        parts = []
        own = [t for t in turns if t[0] == world]
        for agent in {t[1] for t in own}:
            mine = sorted((t for t in own if t[1] == agent), key=lambda t: t[2])
            for i, t in enumerate(mine):
                ahead = [x[2] for x in mine[i:] if x[3] == "assistant"]
                if ahead:
                    parts.append((ahead[0], agent, t[2], "w" if t[3] == "assistant" else "r", t[4]))
        parts.sort(key=lambda p: p[:3])
        seen, index, dead, spans = {}, {}, set(), []
        for step, (ex, agent, pos, kind, text) in enumerate(parts, 1):
            windows = {o: text[o : o + k] for o in range(len(text) - k + 1)}
            if kind == "r":
                hits = {}
                for o, h in windows.items():
                    for sid in index.get(h, ()) if h not in dead else ():
                        if spans[sid][1] != agent:
                            hits.setdefault(sid, []).append(o)
                for sid, offs in hits.items():
                    for a, b in runs(offs, k):
                        out.append((world, agent, ex, pos, a, b, *spans[sid][1:]))
            mine = seen.setdefault(agent, set())
            if kind == "w":
                for a, b in runs([o for o, h in windows.items() if h not in mine], k):
                    sid = len(spans)
                    spans.append((step, agent, ex, pos, a, b))
                    for o in range(a, b - k + 1):
                        h = windows[o]
                        if h in mine or h in dead or sid in index.get(h, ()):
                            continue
                        index.setdefault(h, []).append(sid)
                        if len(index[h]) > most:
                            dead.add(h)
            mine.update(windows.values())
    return sorted(out)


def runs(offs, k):
    out = []
    for o in sorted(offs):
        if out and o - out[-1][1] <= 0:
            out[-1][1] = o + k
        else:
            out.append([o, o + k])
    return [tuple(r) for r in out]


def worlds(n, seed=5):
    rng = random.Random(seed)
    turns = []
    for w in range(n):
        for pos in range(rng.randint(3, 6)):
            for agent in range(3):
                turns.append((w, agent, pos, rng.choice(["assistant", "user"]), "".join(rng.choice("ab") for _ in range(rng.randint(3, 9)))))
    return turns


SCHEMA = "world long, agent long, pos long, role string, text string"


def test_set_form_equals_loop(spark):
    turns = worlds(60)
    df = spark.createDataFrame(turns, SCHEMA)
    for k, most in ((3, 1), (4, 2)):
        got = D.detect(df, k=k, min_span=k, min_word_chars=0, max_postings=most).collect()
        want = loop(turns, k, most)
        assert sorted(tuple(r[c] for c in ("world", "reader", "reader_ex", "read_pos", "a", "b", "sender", "sender_ex", "sender_pos", "s", "e")) for r in got) == want and want


BASE = "the wise old harbour master keeps the lamp lit until dawn"


def found(spark, turns, calls=None, **options):
    t = spark.createDataFrame(turns, "world long, agent long, pos long, role string, text string, call_id string")
    c = calls and spark.createDataFrame(calls, "world long, agent long, pos long, call_id string, tool string, args string")
    return D.detect(t, c, **options), D.scan(t, c, **options)


def test_classes_routes_and_rereads(spark):
    import base64
    import json

    quoted = BASE.replace("old", '"old"') + "\nand \U0001f600 beyond"
    once = json.dumps(quoted)[1:-1]
    turns = [
        (1, 1, 0, "assistant", quoted, None), (1, 2, 0, "system", quoted, None), (1, 2, 1, "user", once, None), (1, 2, 2, "user", json.dumps(once)[1:-1], None), (1, 2, 3, "user", quoted.upper().replace(" ", "  "), None),
        (1, 2, 4, "user", "see " + base64.b64encode(quoted.encode()).decode(), None), (1, 2, 5, "user", '{"signature": "' + BASE.replace(" ", "_") + '"}', None), (1, 2, 6, "tool", quoted, "c1"), (1, 2, 7, "tool", quoted, "c2"), (1, 2, 8, "assistant", "noted", None),
        (1, 2, 9, "tool", "again: " + quoted, "c1"), (1, 2, 10, "tool", "again: " + quoted, "c2"), (1, 2, 11, "assistant", "fine", None), (1, 1, 20, "user", None, None),
    ]
    calls = [(1, 2, 5, "c1", "fetch", json.dumps({"path": "/srv/./notes"})), (1, 2, 5, "c2", "say", "{}"), (1, 2, 4, "c2", "old", json.dumps({"profile": "/not/a/path"}))]
    matches, (hits, spans) = found(spark, turns, calls)
    got = {(r["read_pos"], r["carrier"], r["route"], r["class"]) for r in matches.collect()}
    assert got == {
        (0, "system_prompt", "direct:system_prompt", "exact"), (1, "user_turn", "direct:user_turn", "decoded:json_string"), (3, "user_turn", "direct:user_turn", "normalized"), (4, "user_turn", "direct:user_turn", "decoded:base64"),
        (6, "tool_result", "channel:file:/srv/notes", "exact"), (7, "tool_result", "direct:tool:say", "exact"), (10, "tool_result", "direct:tool:say", "exact"),
    }
    texts = {t[2]: t[4] for t in turns if t[1] == 2}
    assert all(texts[r["read_pos"]][r["a"] : r["b"]] == once for r in matches.filter("read_pos = 1").collect()) and all(quoted[r["s"] : r["e"]] == quoted for r in matches.collect())
    s = D.world_summary(spark.createDataFrame(turns, "world long, agent long, pos long, role string, text string, call_id string"), hits, spans).first()
    assert (s["agents"], s["exchanges"], s["spans"], s["rereads"], s["out_of_reach"], s["transmissions"]) == (2, 3, 1, 1, 1, 5)
    groups = {(r["reader_ex"], r["route"]): r for r in D.group_transmissions(matches).collect()}
    assert groups[8, "direct:user_turn"]["n_matches"] == 3 and [e["read_pos"] for e in groups[8, "direct:user_turn"]["evidence"]] == [1, 3, 4]
