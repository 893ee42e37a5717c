"""Document fingerprints by content-defined chunking.

A text is lower-cased and its white space made single spaces. A gear hash over the last sixteen code
points marks a boundary where its five top bits are zero, so chunks have 32 code points on average and an
edit changes only chunks around it; a run without a boundary is cut every ``LONGEST`` code points. The
fingerprint is the set of chunk digests with the chunks' lengths. Likeness is containment: the share of
a fingerprint's length whose chunks the other one has too.

Neighbours in the order of ids are brought together by one shuffle of the texts: rows go to buckets of
consecutive ids, and the first row of every bucket is also lent to the bucket before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.llm.pieces import STEP, code_points, mixed, powers

#: Gear window in code points (bits of the hash), and the longest chunk.
WINDOW, LONGEST = 16, 256
_BOUNDARY = np.uint16(0xF800)
_POWERS = powers(0xBF58476D1CE4E5B9, LONGEST + 1)
_gear: list[np.ndarray] = []


def _gears() -> np.ndarray:
    if not _gear:
        _gear.append(mixed(np.arange(0x110000), 7).astype(np.uint16))
    return _gear[0]


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def chunk_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct chunks of every text: 48 bits of digest above 16 bits of length."""
    clean = [normalise(t) for t in texts]
    gap = "\0" * WINDOW
    cp = code_points(gap.join(clean))
    size = np.array([len(t) for t in clean], np.int64)
    first = np.cumsum(size + WINDOW) - size - WINDOW
    inside = np.zeros(len(cp) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, first + size, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    gear = np.where(inside, _gears()[cp], np.uint16(0))  # zero between texts: no text sees the one before it
    shift = 1
    while shift < WINDOW:
        more = gear.copy()
        more[shift:] += gear[:-shift] << np.uint16(shift)
        gear, shift = more, shift * 2
    cut = np.flatnonzero(((gear & _BOUNDARY) == 0) & inside) + 1
    begin = np.unique(np.r_[first[size > 0], cut])
    begin = begin[np.r_[inside, False][begin]]
    doc = np.searchsorted(first, begin, side="right") - 1
    end = np.minimum(np.r_[begin[1:], len(cp)], (first + size)[doc]) if len(begin) else begin
    pieces = -(-(end - begin) // LONGEST)
    if len(begin) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, doc = np.repeat(begin, pieces) + nth * LONGEST, np.repeat(doc, pieces)
        end = np.minimum(begin + LONGEST, np.repeat(end, pieces))
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    length = end - begin
    at = np.cumsum(length) - length
    offset = np.arange(length.sum()) - np.repeat(at, length)
    value = mixed(cp[np.repeat(begin, length) + offset], 11) * _POWERS[offset]
    digest = mixed(np.add.reduceat(value, at) + length.astype(np.uint64), 13)
    chunk = digest & ~np.uint64(0xFFFF) | length.astype(np.uint64)
    order = np.lexsort((chunk, doc))
    chunk, doc = chunk[order], doc[order]
    new = np.r_[True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])]
    chunk, doc = chunk[new], doc[new]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [chunk[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def written(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def _weight(chunks: np.ndarray) -> int:
    return int((chunks & np.uint64(0xFFFF)).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of ``a`` that is in ``b``; two empty fingerprints are alike, an empty and another are not."""
    if not len(a):
        return float(not len(b))
    return _weight(np.intersect1d(a, b, assume_unique=True)) / _weight(a)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every text; a null text is empty and has the empty fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= STEP or i + 1 == len(texts):
                    prints = [written(c) for c in chunk_sets(texts[begin : i + 1])]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(begin, i + 1 - begin), pa.array(prints, pa.string())],
                        names=["doc_id", "fingerprint"])
                    begin, size = i + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in buckets of consecutive ids, each bucket sorted and followed by the row after its last one.

    Columns ``place, lent, doc_id, text``. The order is by descending id, nulls last, then by the text's
    hash; after the last row comes the first one again. The bounds of the buckets are approximate
    quantiles, four for each shuffle partition; only they and one key per bucket come to the driver.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    bounds = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bounds = sorted(set(bounds or []), reverse=True)
    hashed = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    near = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # Ids above the first bound are in bucket 0; rows without an id are spread by their hash.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + F.shiftright("mark", 57)).otherwise(
        F.size(F.filter(near, lambda b: b >= F.col("doc_id")))).cast("int")
    keyed = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("mark", hashed).withColumn("bucket", bucket)
        .withColumn("last", F.col("doc_id").isNull()).withColumn("down", F.coalesce(F.bitwise_not("doc_id"), F.lit(0)))
    )
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct("last", "down", "mark")).alias("key")).orderBy("bucket").collect()
    lent = [
        (*first["key"], firsts[i - 1]["bucket"]) for i, first in enumerate(firsts)
    ]
    lenders = spark.createDataFrame(lent, "last boolean, down long, mark long, before int")
    whole = keyed.join(F.broadcast(lenders), ["last", "down", "mark"], "left")  # one row for each bucket
    own = F.struct(F.col("bucket").alias("place"), F.lit(False).alias("lent"))
    other = F.struct(F.col("before").alias("place"), F.lit(True).alias("lent"))
    placed = whole.withColumn("at", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, other))))
    return (
        placed.select("at.place", "at.lent", "last", "down", "mark", "doc_id", "text")
        .repartition("place").sortWithinPartitions("place", "lent", "last", "down", "mark")
        .select("place", "lent", "doc_id", "text")
    )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that of the next text.

    The edited text has its last third replaced by as many code points from the beginning of the next
    text in the order of :func:`with_next` (all of it, if it is shorter). A null text is empty. Repeated
    rows and rows without an id are kept, a single row is its own next one; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= STEP // 2:
                    yield compared(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield compared(held)

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last one, which only is the next one of its neighbour here."""
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in pairs]
        sets, other = chunk_sets(texts), chunk_sets(edited)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][2] for i in pairs], key_type),
            "n_chars": pa.array([len(texts[i]) for i in pairs], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            "fingerprint": pa.array([written(sets[i]) for i in pairs], pa.string()),
            "edited_fingerprint": pa.array([written(e) for e in other], pa.string()),
            "near_edited": pa.array([likeness(sets[i], e) for i, e in zip(pairs, other, strict=True)], pa.float64()),
            "near_next": pa.array([likeness(sets[i], sets[i + 1]) for i in pairs], pa.float64()),
        })

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return with_next(docs.select("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
