import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import conversation_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_nodes(strings):
    """Nodes of {conv_id: ((role, text), ...)}."""
    nodes = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) > len(q) and r[: len(q)] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(strings[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(r)) for c, r in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return brute_nodes({c: own.get(c - c % 5 if c >= 0 else c + -c % 5, ())[: h[c]] + own[c][h[c] :] for c in own})


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, pos string, digest string")


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(("batch", "segment"), [(200_000, 1024), (40, 3), (7, 1)])
def test_against_brute_force(spark, monkeypatch, batch, segment):
    monkeypatch.setattr(trie, "_BATCH", batch)
    monkeypatch.setattr(trie, "_SEGMENT", segment)
    monkeypatch.setattr(trie, "_PIECE", 3)
    rng = random.Random(batch)
    rows = [(c, None if rng.random() < 0.1 else rng.randrange(6), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "long " * 5])) for c in range(120) for _ in range(rng.randrange(12))]
    rows += [(7, 0, "user", "hi")] * 3 + [(None, 1, "user", "lost")] + [(c, t, "user", "same") for c in range(200, 260) for t in range(4)] + [(-12, 1, "a", "b"), (-10, 0, "a", "b")]
    assert got(trie.rebuilt_trie(table(spark, rows).repartition(5))) == brute(rows)


def test_long_texts_and_long_conversations(spark):
    rows = [(c, t, "user", f"{t}" if t < 2500 + c else f"{c} {t}") for c in (5, 6, 7) for t in range(3000)] + [(10, 0, "user", "é" * 300_000), (11, 0, "user", "é" * 300_000)]
    turns = trie.with_beginnings(trie.turns_of(table(spark, rows)))
    nodes = {(r.conv_id, r.depth): r for r in trie.build(turns).collect()}
    assert nodes[5, 2505].n_convs == 3 and nodes[6, 2506].n_convs == 2 and nodes[7, 3000].n_children == 0 and nodes[5, 0].n_leaves == 4
    assert nodes[10, 1].saved_tokens == 600_000 and nodes[5, 3000].saved_tokens == 0 and len(nodes) == 1 + 2505 + 495 + 1 + 494 + 494 + 1


def test_empty_and_turnless(spark):
    assert got(trie.rebuilt_trie(table(spark, []))) == []
    rows = [(c, 0, "user", "x") for c in range(1, 5)]  # heads are of an absent conversation 0
    assert got(trie.rebuilt_trie(table(spark, rows))) == brute(rows)


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert trie.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=40))
def test_tries_hold_every_prefix(strings):
    tries = trie.Tries()
    for s in strings:
        tries.insert([s[:d].encode() for d in range(len(s) + 1)])
    (total,), least = tries.sums([[1] * len(strings)], list(range(len(strings))))
    want = {}
    for i, s in enumerate(strings):
        for d in range(len(s) + 1):
            want.setdefault(s[:d], []).append(i)
    nodes = {}
    for node, (top, end, of) in enumerate(zip(tries.top, tries.end, tries.of, strict=True)):
        for d in range(top + 1, end + 1) if end else [0]:
            nodes[tries.digests[of][d].decode()] = (total[node], least[node])
        if end:  # reached at its handle
            assert tries.handles[tries.digests[of][trie.fattest(top, end)]] == node
    assert nodes == {p: (len(m), min(m)) for p, m in want.items()}
    assert len(tries.handles) == len(tries.first) == max(len(tries.top) - 1, 0)
