"""Token counts of fields and sections, from one encoding of the whole document.

Each document is encoded once. Its tokens, as spans of code points, are joined with its sections, also
spans, by binary search in both sorted lists. A token inside one section counts there. A token that
crosses boundaries belongs to the section that holds most of its code points, the earlier one at a tie;
so the counts of a document's sections always sum to its whole count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.llm.pieces import STEP
from pathclear.llm.tree_bpe import _encoder, _table


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens per section; ``bounds`` are the sections' sorted starts (first 0), tokens are not empty."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    for t in np.flatnonzero(first != last):  # a few: at most one for each boundary and byte of a character
        cuts = np.clip(np.r_[bounds[first[t] : last[t] + 1], ends[t]], starts[t], ends[t])
        first[t] += int(np.argmax(np.diff(cuts)))
    return np.bincount(first, minlength=len(bounds))


def line_starts(text: str) -> np.ndarray:
    """A section is a line with its line end; the empty text is one empty section."""
    at = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    return np.r_[0, at[at < len(text)]]


def section_counts(docs: DataFrame, path: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """Tokens of every line of every field, from one encoding of a document's fields together.

    The fields stand one after another, each followed by an empty line if another one follows; that
    separator belongs to the field before it. Returns ``doc_id, field, section int, start, length,
    n_tokens long``; ``start`` counts code points from the beginning of the field. Null fields are
    empty; an empty field is one section without tokens (but may get those of its separator). Repeated
    rows are counted each, other columns are not read. Token spans cover whole characters, so the
    tokens of a character cut into bytes all have its span.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    gap = "\n\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        table = _table(encoder.library)
        width = np.array([len(table[i]) for i in range(len(table))])
        for batch in batches:
            columns = [[t or "" for t in batch.column(f"f{i}").to_pylist()] for i in range(len(fields))]
            rows = list(zip(*columns, strict=True))
            begin = size = 0
            for i, row in enumerate(rows):
                size += sum(map(len, row)) + 1
                if size < STEP and i + 1 < len(rows):
                    continue
                yield counted(batch.slice(begin, i + 1 - begin).column(0), rows[begin : i + 1], encoder, width)
                begin, size = i + 1, 0

    def counted(ids_column: pa.Array, rows: list[tuple[str, ...]], encoder, width: np.ndarray) -> pa.RecordBatch:
        texts = [gap.join(r) for r in rows]
        ids, edges = encoder.encode(texts)
        out: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for d, (row, text) in enumerate(zip(rows, texts, strict=True)):
            own = ids[edges[d] : edges[d + 1]]
            last = np.cumsum(width[own])
            if text.isascii():
                first, end = last - width[own], last
            else:
                cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
                of_byte = np.repeat(np.arange(len(cp)), 1 + (cp >= 0x80).astype(int) + (cp >= 0x800) + (cp >= 0x10000))
                first, end = of_byte[last - width[own]], of_byte[last - 1] + 1
            bounds, offset, names, numbers = [], 0, [], []
            for f, part in enumerate(row):
                own_starts = line_starts(part)
                bounds.append(own_starts + offset)
                names.append(np.full(len(own_starts), f))
                numbers.append(np.arange(len(own_starts)))
                offset += len(part) + len(gap) * (f + 1 < len(row))
            starts = np.concatenate(bounds)
            # An empty section shares its start with the next one; the search gives tokens to the later.
            got = attribute(first, end, starts) if len(own) else np.zeros(len(starts), int)
            local = np.concatenate([b - b[0] for b in bounds])
            sizes = np.concatenate([np.diff(np.r_[b - b[0], len(p)]) for b, p in zip(bounds, row, strict=True)])
            for column, values in zip(out, (np.full(len(starts), d), np.concatenate(names), np.concatenate(numbers),
                                            local, sizes, got), strict=True):
                column.append(values)
        doc, field, number, start, size, got = map(np.concatenate, out)
        return pa.RecordBatch.from_arrays(
            [ids_column.take(pa.array(doc)), pa.array(np.array(fields, object)[field], pa.string()),
             pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(got, pa.int64())],
            names=["doc_id", "field", "section", "start", "length", "n_tokens"],
        )

    wanted = docs.select("doc_id", *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return wanted.mapInArrow(
        run, f"doc_id {kind}, field string, section int, start long, length long, n_tokens long")
