import collections
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pathclear.llm import packing, pieces, sections, tree_bpe
from pathclear.llm.pieces import Encoder
from tests.llm import rows as R

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABET = ["a", "b", "'s", "'", " ", "  ", "\n", "é", "日本", "😀", "1", "23", ".", "!!", "<|endoftext|>", "́", "Σ",
            "the", "ing", "\t", "_", "'re", "'ll", "A", "ß", "½", "　", "\x1c", "İ"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_librarys(path):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "x" * 3000]
    encoder = Encoder(path, tree_bpe._long if path == BYTE else None)
    ids, edges = encoder.encode(texts)
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(edges[:-1], edges[1:], strict=True)] == want


def test_ids_stay_right_when_the_known_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr("pathclear.llm.pieces.KEPT", 10)
    encoder, rng = Encoder(BYTE), random.Random(2)
    for _ in range(5):
        text = R.words(rng, 300)
        assert encoder.encode([text])[0].tolist() == encoder.whole(text)


def test_tree_concatenation_is_exact():
    rng, library = random.Random(4), Tokenizer.from_file(BYTE)
    table = tree_bpe.byte_table(library)

    def encode(text):
        return library.encode(text, add_special_tokens=False).ids

    for _ in range(1200):
        letters = rng.choice([["a"], ["a", "b"], list("abcdefghij"), ["th", "in", "'s", "'", "!", "1", "é", "😀"], ["\n", "\t", "x"], ["=", "-"]])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 100)))
        assert tree_bpe.encode_unsplit(text, encode, table, rng.choice([1, 2, 3, 5, 8])) == encode(text), text


def test_documents_encode_and_decode_as_the_library_does(spark):
    library = Tokenizer.from_file(BYTE)
    got = tree_bpe.encode_documents(R.frame(spark), BYTE).collect()
    want = collections.Counter()
    for i, t in R.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert tree_bpe.encode_documents(R.empty(spark), BYTE).count() == 0


def test_long_texts_are_cut_at_the_tokenizers_white_space(spark):
    space = pieces.classes() == pieces._SPACE
    cuts = {c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and tree_bpe._CUT.search("x" + chr(c))}
    assert cuts == set(np.flatnonzero(space).tolist())
    library = Tokenizer.from_file(BYTE)
    texts = ["f(a)\x1f" * 30_000, "one f(a)\x1f\x1e" * 9_000 + "\x1f)" * 30_000]
    batch = pa.RecordBatch.from_pydict({"text_key": ["0", "1"], "text": texts})
    for part in tree_bpe._segments([])([batch]):
        row = part.to_pylist()[0]
        if row["seq"] and not row["soft"]:  # a hard cut has white space after it
            assert space[ord(row["text"][0])]
    got = {r.doc_id: r for r in tree_bpe.encode_documents(R.frame(spark, list(enumerate(texts))), BYTE).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == library.encode(t, add_special_tokens=False).ids and got[i].decoded == t


@pytest.mark.parametrize("kind", ["prose", "even", "few", "ones"])
def test_plans_place_every_piece_once(kind):
    rng = np.random.default_rng(6)
    lengths = {"prose": np.clip(np.exp(rng.normal(5, 1, 4000)), 1, 500).astype(int), "even": rng.integers(1, 501, 2000),
               "few": rng.choice([200, 90, 3, 490], 3000), "ones": np.ones(1234, int)}[kind]
    counts = np.bincount(lengths, minlength=501)
    fill, got = collections.Counter(), collections.Counter()
    spans = collections.defaultdict(list)
    for length, first, bins, each, start, offset in packing.plan_runs(counts, 500).tolist():
        assert first == got[length]
        got[length] += bins * each
        for b in range(start, start + bins):
            fill[b] += each * length
            spans[b] += [(offset + k * length, length) for k in range(each)]
    assert [got[i] for i in range(501)] == counts.tolist() and max(fill.values()) <= 500
    for parts in spans.values():
        assert [s for s, _ in sorted(parts)] == np.r_[0, np.cumsum([n for _, n in sorted(parts)])[:-1]].tolist()
    if kind in ("prose", "ones"):  # short pieces fill any gap
        assert len(fill) <= -(-lengths.sum() // 500) + 1


def test_packed_documents(spark):
    library = Tokenizer.from_file(WORD)
    got = packing.pack_documents(R.frame(spark), WORD, 256).collect()
    want = collections.Counter()
    for i, t in R.texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.r_[0, np.cumsum([n for _, n in parts])[:-1]].tolist() and sum(n for _, n in parts) <= 256
    assert packing.pack_documents(R.empty(spark), WORD).count() == 0
    whole = packing.sequences(R.frame(spark), WORD, 256).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in got)
    assert all(sum(len(p.ids) // 4 for p in r.pieces) == r.length <= 256 for r in whole)


def test_section_counts(spark):
    library = Tokenizer.from_file(BYTE)
    rows = [r for r in R.texts() if r[0] is not None and r[0] >= 8]
    got = sections.section_counts(R.frame(spark, rows), BYTE).collect()
    assert {(r.doc_id, r.section): r.n_tokens for r in got} == {
        (i, k): n for i, t in rows for k, n in enumerate(brute(library, t))}
    both = sections.section_counts(R.frame(spark), BYTE, ("lang", "text")).collect()
    total = sum(len(library.encode(f"en\n\n{t or ''}", add_special_tokens=False).ids) for _, t in R.texts())
    assert sum(r.n_tokens for r in both) == total
    assert sections.section_counts(R.empty(spark), BYTE).count() == 0


def brute(library, text):
    """Every token goes to the line that holds most of its code points, the first at a tie."""
    table = tree_bpe.byte_table(library)
    ids = library.encode(text, add_special_tokens=False).ids
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    line = np.cumsum([0] + [c == "\n" for c in text])[: max(1, len(text))]
    counts, at = [0] * (int(line[-1]) + 1), 0
    for i in ids:
        n = len(table[i])
        inside = collections.Counter(int(line[k]) for k in range(of_byte[at], of_byte[at + n - 1] + 1))
        counts[max(inside, key=lambda x: (inside[x], -x))] += 1
        at += n
    return counts


def test_a_crossing_token_goes_to_the_larger_side():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 8])
    assert sections.attribute(starts, ends, np.array([0, 3, 7])).tolist() == [1, 2, 0]  # 6..8 is a tie
    assert sections.attribute(starts, ends, np.array([0, 3])).tolist() == [1, 2]  # 2..6 has one and three
    assert sections.attribute(np.array([0]), np.array([4]), np.array([0, 2])).tolist() == [1, 0]  # a tie
