import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pathclear.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, head string, n string, ids string, key string, least int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "n", "i", "k", 3) for r in rows], SCHEMA)


def built(rows):
    """Rebuilt conversations by plain loops."""
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            # Ties go by the id of a turn.
            id_ = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            held[c].append((turn is not None, turn or 0, id_, role, text))
    held = {c: [t[3:] for t in sorted(v)] for c, v in held.items()}
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = held.get(base, [])[:h] + own[h:]
    return out


def nodes(convs):
    """All nodes by gathering every prefix."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = [(7, None, None, None), (7, None, "user", "a"), (7, 2, "user", "é😀"), (7, 2, "user", "é😀"), (None, 1, "user", "lost"),
            (12, 0, "user", ""), (12, 1, None, "x"), (-13, 0, "user", "a"), (-13, 1, "user", "b"), (-15, 5, "user", "z"), (1001, 3, "user", "only")]
    for c in range(20, 140):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {rng.randint(0, 1)} of {t}"))
    for c in range(200, 260):  # copies, one of them longer than the others
        rows += [(c, t, "user", f"shared {t}") for t in range(15 + (c == 230))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "chunk"), [(20_000, 5000), (4, 3)])
def test_nodes_are_those_of_all_prefixes(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(trie, "CONTAINER", size)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = conversations(5)
    got = trie.prefix_trie(trie.rebuilt(trie.turn_arrays(frame(spark, rows))))
    assert sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                   for r in got.collect()), key=str) == nodes(built(rows))


def test_no_conversations_and_turnless_ones(spark):
    assert trie.prefix_trie(trie.turn_arrays(frame(spark, []))).collect() == []
    # 1000 is absent and all of 1003's turns are within its first h.
    rows = [(1003, t, "user", "x") for t in range(min(1, zlib.crc32(b"1003") % 9))] or [(1003, 0, "user", "x")]
    got = trie.prefix_trie(trie.rebuilt(trie.turn_arrays(frame(spark, rows)))).collect()
    assert [tuple(r) for r in got if r.depth == 0][0][:2] == (1003, 0)
    assert len(got) == len(nodes(built(rows)))


def test_a_long_common_prefix_takes_one_round(spark, monkeypatch):
    monkeypatch.setattr(trie, "CONTAINER", 100)
    rounds = []
    burst = trie._burst
    monkeypatch.setattr(trie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    rows = [(c, t, "user", f"same {t}" if t < 80 else f"own {c}") for c in range(12) for t in range(82)]
    convs = {c: [("user", f"same {t}" if t < 80 else f"own {c}") for t in range(82)] for c in range(12)}
    got = trie.prefix_trie(trie.turn_arrays(frame(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == nodes(convs)
    assert len(rounds) == 2
