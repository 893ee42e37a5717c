import hashlib
import random
import zlib

import pytest

from pathclear.llm import merkle

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, part string, node string, at long, count long, "
          "block long, mark long, claimed string")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "n", 1, 2, 3, 4, "c") for r in rows], SCHEMA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """All levels up to a single node, and each first node's siblings."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1 : run + 8]))
        at //= 8
    return out


def expected(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(parts, key=lambda k: b"" if k is None else b"=" + k.encode())
    trees = {k: climb([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in parts.items()}
    top = climb([trees[k][-1][0] for k in order])
    out = []
    for nth, k in enumerate(order):
        for at, (_, _, own, r) in enumerate(sorted(parts[k], key=lambda x: x[:3])):
            path = sides(trees[k], at) + sides(top, nth)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r[0], text, *r[2:])
            for a, b in path:
                node = h(*a, node, *b)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], h(*(s for a, b in path for s in a + b)), node, node == top[-1][0]))
    return sorted(out, key=str)


def documents(n, langs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Some Text", "lower", "", None, "É Ü 😀", "A" * 300_000]), rng.choice(langs), rng.choice([None, "s", ""]), rng.choice([None, i]))
            for i in range(n)]
    return rows + [(3, "Tie", langs[0], "s", 1), (3, "Tie", langs[0], "s", 1), (3, "other", langs[0], "s", 1), (None, "X", langs[0], None, None),
                   (None, "Y", "lone", None, None)]


@pytest.mark.parametrize(("n", "langs", "kept"), [(7, ["en"], 3), (600, ["en", "en", "en", "de", None, ""], 3),
                                                 (700, ["en", "en", None], 1), (150, [f"l{i}" for i in range(20)], 1)])
def test_proofs_are_those_of_whole_trees(spark, n, langs, kept):
    rows = documents(n, langs)
    made = merkle.document_manifest(frame(spark, rows), merkle.tampered_text(), kept)
    got = merkle.verified(made, "doc_id", "claimed").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_paths_fold_to_the_root_and_other_ids_work(spark):
    rows = spark.createDataFrame([(f"d{i}", "t", "en", "s", 1) for i in range(70)], "doc_id string, text string, lang string, source string, n_chars long")
    got = merkle.proofs(merkle.document_manifest(rows), "doc_id").collect()
    assert len({r.doc_id for r in got}) == 70
    for r in got:
        assert merkle.folded(r.leaf, [(p.left, p.right) for p in r.path]) == r.root
        assert merkle.folded("0" * 64, [(p.left, p.right) for p in r.path]) != r.root


def test_empty_table_and_single_row(spark):
    made = merkle.document_manifest(frame(spark, []))
    assert merkle.verified(made, "doc_id", "claimed").collect() == []
    one = (1, None, None, None, None)
    row, = merkle.verified(merkle.document_manifest(frame(spark, [one])), "doc_id", "claimed").collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(*one)
    assert row.proof_sha256 == h()
