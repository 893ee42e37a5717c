"""Byte-level BPE of whole texts, long unsplit ones by tree concatenation.

Text is cut into the tokenizer's own pieces (see :mod:`pieces`). A piece that is longer than a leaf, such
as a run of letters without a space, is halved down to leaves; these are encoded one by one, and
neighbours are joined upwards: a window of tokens around the join is encoded anew, growing until its tokens meet a
token of the left side and one of the right side at the same place. A byte-pair encoding is right
exactly if every two neighbouring tokens are, and each such pair then stands in the encoding of one of
the three parts. A window that reaches both ends is the whole text, which is right by itself.

Long documents are cut into segments that are encoded in tasks of their own and joined per text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.llm.pieces import Encoder, byte_names, steps

#: Code points of a leaf, and of a segment that is encoded in a task of its own.
LEAF = 256
SEGMENT = 1 << 16
#: Tokens on each side of the first window.
WINDOW = 8

# White space as the tokenizer has it (see pieces.classes): without U+001C to U+001F, which Python counts.
_CUT = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")


def byte_table(library) -> dict[int, bytes]:
    """Bytes of every token."""
    byte = byte_names()
    size = library.get_vocab_size(with_added_tokens=True)
    return {i: bytes(byte[c] for c in library.id_to_token(i)) for i in range(size)}


Encode = Callable[[str], list[int]]


def _edges(ids: list[int], table: dict[int, bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(table[i]) for i in ids], dtype=np.int64)])


def join(left: str, a: list[int], right: str, b: list[int], encode: Encode, table: dict[int, bytes]) -> list[int]:
    """Ids of ``left + right`` from the ids of both."""
    if not left or not right:
        return a or b
    data_a, data_b = left.encode(), right.encode()
    edge_a, edge_b = _edges(a, table), _edges(b, table)
    take = WINDOW
    while True:
        i, j = max(0, len(a) - take), min(len(b), take)
        # The window has whole code points only.
        while i > 0 and (edge_a[i] < len(data_a) and data_a[edge_a[i]] & 0xC0 == 0x80):
            i -= 1
        while j < len(b) and data_b[edge_b[j]] & 0xC0 == 0x80:
            j += 1
        text = (data_a[edge_a[i] :] + data_b[: edge_b[j]]).decode()
        mid = encode(text)
        edge, seam = _edges(mid, table), int(edge_a[-1] - edge_a[i])
        at = {int(e): k for k, e in enumerate(edge[:-1])}
        end = int(edge[-1])
        # First the last token left of the seam that both have, then the first one right of it.
        low = (0, i) if i == 0 else next(
            ((at[int(e - edge_a[i])], k) for k, e in zip(range(len(a) - 1, i, -1), edge_a[len(a) - 1 : i : -1], strict=True)
             if int(e - edge_a[i]) in at and mid[at[int(e - edge_a[i])]] == a[k]
             and edge[at[int(e - edge_a[i])] + 1] <= seam), None)
        high = (len(mid), j) if j == len(b) else next(
            ((at[int(e) + seam], k) for k, e in enumerate(edge_b[:j])
             if int(e) + seam in at and mid[at[int(e) + seam]] == b[k] and edge[at[int(e) + seam] + 1] < end), None)
        if low and high:
            return a[: low[1]] + mid[low[0] : high[0]] + b[high[1] :]
        take *= 2


def encode_unsplit(text: str, encode: Encode, table: dict[int, bytes], leaf: int = LEAF) -> list[int]:
    """Ids of one text by leaves and joins."""
    size = max(1, leaf)
    parts = [(text[i : i + size]) for i in range(0, len(text), size)] or [""]
    level = [(p, encode(p)) for p in parts]
    while len(level) > 1:
        up = [
            (x + y, join(x, a, y, b, encode, table))
            for (x, a), (y, b) in zip(level[::2], level[1::2], strict=False)
        ]
        level = up + level[len(up) * 2 :]
    return level[0][1]


_tables: dict[int, dict[int, bytes]] = {}


def _table(library) -> dict[int, bytes]:
    if id(library) not in _tables:
        _tables[id(library)] = byte_table(library)
    return _tables[id(library)]


def _long(library, piece: str) -> list[int]:
    """A word, number, run of marks or of white space that is too long to merge at once."""
    return encode_unsplit(piece, lambda t: library.encode(t, add_special_tokens=False).ids, _table(library))


def _encoder(path: str) -> Encoder:
    return Encoder.shared(path, _long)


def _results(path: str):
    """Adds ids and decoded text to rows of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        table = _table(encoder.library)
        for batch in batches:
            for part, texts in steps(batch):
                ids, edges = encoder.encode(texts)
                flat = [table[i] for i in ids.tolist()]
                decoded = [b"".join(flat[i:j]).decode("utf-8", "replace") for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids)),
                     pa.array(decoded, pa.string())],
                    names=[part.schema.names[0], "ids", "decoded"],
                )

    return run


def _segments(special: list[str]):
    """Cuts long texts: at white space where there is some, else anywhere (``soft``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                begin, n, soft = 0, 0, False
                while begin < len(text):
                    end = min(len(text), begin + SEGMENT)
                    hard = end == len(text)
                    if not hard:
                        cut = max((m.start() for m in _CUT.finditer(text, begin + SEGMENT // 2, end)), default=0)
                        hard, end = bool(cut), cut or end
                        for s in special:  # a special token must not be cut
                            at = text.find(s, max(0, end - len(s) + 1), end + len(s) - 1)
                            end = at if begin < at < end else end
                    yield pa.RecordBatch.from_pydict({
                        "text_key": [key], "seq": pa.array([n], pa.int32()), "soft": [soft], "text": [text[begin:end]]})
                    begin, n, soft = end, n + 1, not hard

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every text, as the tokenizers library gives them.

    Null and empty texts have no ids and decode to the empty text. Rows that repeat are given again,
    ties do not matter, other columns are not read. Texts over ``SEGMENT`` code points are encoded
    once per distinct text, in segments that Spark spreads over its tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > SEGMENT
    short = rows.filter(~is_long).mapInArrow(_results(path), f"doc_id {kind}, ids array<int>, decoded string")

    def special() -> list[str]:
        from tokenizers import Tokenizer

        return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part, texts in steps(batch):
                ids, edges = encoder.encode(texts)
                data = [ids[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "data"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        library = _encoder(path).library
        table = _table(library)
        group = group.sort_values("seq")
        level = [(s, t, np.frombuffer(d, np.int32).tolist()) for s, t, d in zip(group.soft, group.text, group.data, strict=True)]
        while len(level) > 1:
            up = []
            for (s, x, a), (soft, y, b) in zip(level[::2], level[1::2], strict=False):
                up.append((s, x + y, join(
                    x, a, y, b, lambda t: library.encode(t, add_special_tokens=False).ids, table) if soft else a + b))
            level = up + level[len(up) * 2 :]
        ids = level[0][2]
        decoded = b"".join(table[i] for i in ids).decode("utf-8", "replace")
        return pd.DataFrame({"text_key": [group.text_key.iloc[0]], "ids": [np.array(ids, np.int32)], "decoded": [decoded]})

    long = rows.filter(is_long).withColumn("text_key", F.sha2("text", 256))
    segments = long.groupBy("text_key").agg(F.first("text").alias("text")).mapInArrow(
        _segments(special()), "text_key string, seq int, soft boolean, text string")
    encoded = segments.repartition("text_key", "seq").mapInArrow(
        encode, "text_key string, seq int, soft boolean, text string, data binary")
    done = encoded.groupBy("text_key").applyInPandas(joined, "text_key string, ids array<int>, decoded string")
    return short.unionByName(long.select("doc_id", "text_key").join(done, "text_key").select("doc_id", "ids", "decoded"))
