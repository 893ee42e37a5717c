"""Best-fit packing by exact-complement hashing.

The plan is made on the histogram of lengths, which has at most ``capacity`` rows whatever the
data's size; the pieces themselves never leave their tasks. For every length, longest first, the gap
it leaves is looked up among available single lengths, sums of pairs and sums of triples; a
combination that fills the gap exactly is used as often as the counts allow. What finds no exact
complement is packed best-fit, longest first, on the same counts. The plan is a list of runs: ``bins``
sequences from ``first_bin`` on, each with ``per_bin`` pieces of ``length`` at ``offset``, taking the
pieces of that length from number ``first_rank`` on.

Every step of either part uses up a length or a group of equally filled sequences, so the number of
runs is bounded by the capacity too (some ten thousand at 4096), and sending it to all tasks is safe.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathclear.functions.settling import settle
from pathclear.llm.pieces import Encoder, steps

#: Ranks fit below this in the search key (length, rank).
_RANKS = 1 << 44


class _Plan:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.pair: dict[int, int] = {}

    def put(self, length: int, bins: int, per_bin: int, first_bin: int, offset: int) -> None:
        self.runs.append((length, int(self.used[length]), bins, per_bin, first_bin, offset))
        self.used[length] += bins * per_bin
        self.left[length] -= bins * per_bin

    def two(self, total: int) -> tuple[int, int] | None:
        """Available lengths with this sum, the larger one as large as it can be."""
        if total < 2:
            return None
        known = self.pair.get(total)
        if known is None or not self._there(known, total - known):
            if known == 0:
                return None
            there = self.left[: total] > 0
            fits = np.flatnonzero(there & there[::-1][np.r_[-1, 0 : total - 1]])
            fits = fits[fits * 2 >= total]
            fits = [int(a) for a in fits[::-1][:2] if self._there(int(a), total - int(a))]
            # Lengths only run out, so a sum without a pair stays without one.
            known = self.pair[total] = fits[0] if fits else 0
        return (known, total - known) if known else None

    def _there(self, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.left[a] > 0 and self.left[b] > (a == b)

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        if most < 2:
            return None
        if pair := self.two(gap):
            return pair
        if most < 3:
            return None
        for c in np.flatnonzero(self.left[1 : gap // 3 + 1] > 0)[::-1] + 1:
            pair = self.two(gap - int(c))
            if pair and self._enough(Counter((*pair, int(c)))):
                return (*pair, int(c))
        return None

    def _enough(self, need: Counter) -> bool:
        return all(self.left[x] >= k for x, k in need.items())

    def exact(self, most: int) -> None:
        """Fills gaps by at most ``most`` pieces."""
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                gap = self.capacity - length
                self.left[length] -= 1  # the piece whose gap is to be filled is not its own filler
                found = self.complement(gap, most) if gap else ()
                self.left[length] += 1
                if found is None:
                    break
                need = Counter((length, *found))
                if not self._enough(need):
                    break
                bins, offset = int(min(self.left[x] // k for x, k in need.items())), 0
                for x, k in need.items():
                    self.put(x, bins, k, self.bins, offset)
                    offset += x * k
                self.bins += bins

    def best_fit(self) -> None:
        gaps: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def add(gap: int, first: int, bins: int) -> None:
            if gap and bins:
                if gap not in open_:
                    bisect.insort(gaps, gap)
                    open_[gap] = []
                open_[gap].append((first, bins))

        for length in range(self.capacity, 0, -1):
            while (left := int(self.left[length])) > 0:
                at = bisect.bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.capacity // length
                    add(self.capacity, self.bins, -(-left // each))
                    self.bins += -(-left // each)
                    continue
                gap = gaps[at]
                first, bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                each = gap // length
                full = min(bins, left // each)
                if full:
                    self.put(length, full, each, first, self.capacity - gap)
                    add(gap - each * length, first, full)
                elif left:  # fewer pieces than one sequence takes
                    self.put(length, 1, left, first, self.capacity - gap)
                    add(gap - left * length, first, 1)
                    full = 1
                add(gap, first + full, bins - full)


def plan_runs(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first_rank, bins, per_bin, first_bin, offset) ordered by length and rank.

    ``counts[n]``: pieces of length n, for 1 to ``capacity``.
    """
    plans = []
    for most in (3, 2, 1):  # many long pieces can make it dear to spend short ones in pairs and triples
        plan = _Plan(counts, capacity)
        plan.exact(most)
        plan.best_fit()
        plans.append(plan)
    plan = min(plans, key=lambda p: p.bins)
    runs = np.array(plan.runs, dtype=np.int64).reshape(-1, 6)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and the piece's number among the task's pieces of its length."""
    task, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        order = np.argsort(lengths, kind="stable")
        kinds, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths)) - np.repeat(first - [seen[int(k)] for k in kinds], count)
        seen.update(dict(zip(kinds.tolist(), count.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(rank), task, np.int64)), pa.array(rank)],
            names=[*batch.schema.names, "pack_task", "pack_rank"],
        )


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Sequences are gapless from 0 and hold at most ``capacity``. All columns of ``items`` stay, so it
    must not have ``sequence_id``, ``offset``, ``pack_task`` or ``pack_rank``. Rows that repeat are
    packed each for itself. An empty table gives an empty table.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return _packed(items.mapInArrow(_number, f"{fields}, pack_task long, pack_rank long"), capacity)


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    """Packs rows that :func:`_number` has gone over."""
    # Written once: the numbers given inside a task stay the same however often they are read.
    numbered = settle(rows)
    kept = [f for f in numbered.schema if f.name not in ("pack_task", "pack_rank")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    per_task = numbered.groupBy("pack_task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    runs = plan_runs(counts, capacity)
    before = per_task.select(
        F.col("pack_task"), F.col("length"),
        (F.sum("n").over(Window.partitionBy("length").orderBy("pack_task")) - F.col("n")).alias("before"),
    )
    key = runs[:, 0] * _RANKS + runs[:, 1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("pack_rank").to_numpy() + batch.column("before").to_numpy()
            length = batch.column("length").to_numpy().astype(np.int64)
            run = runs[np.searchsorted(key, length * _RANKS + rank, side="right") - 1]
            nth = rank - run[:, 1]
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("pack_rank", "before")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(run[:, 4] + nth // run[:, 3]),
                 pa.array(run[:, 5] + nth % run[:, 3] * length)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    joined = numbered.join(before, ["pack_task", "length"]).select(
        *[F.col(f.name) for f in kept], "pack_rank", "before"
    )
    return joined.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, numbered: bool = False) -> DataFrame:
    """Token ids of every text with ``end_id`` at the end, cut into pieces of ``capacity`` ids.

    Returns ``doc_id, piece int, start long, length long, ids binary`` (little-endian unsigned 32-bit
    ids). A null or empty text has the end id alone; rows that repeat give their pieces again; other
    columns of ``docs`` are not read. ``numbered`` adds what :func:`pack` needs in the same pass, so a task
    has one Python worker instead of two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(path)
        for batch in batches:
            for part, texts in steps(batch):
                ids, edges = encoder.encode(texts)
                ids = np.insert(ids, edges[1:], end_id).astype("<u4")
                edges = edges + np.arange(len(edges))
                size = np.diff(edges)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = edges[doc] + piece * capacity
                end = np.minimum(begin + capacity, edges[doc + 1])
                data = [ids[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                     pa.array(piece * capacity, pa.int64()),
                     pa.array(end - begin), pa.array(data, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    fields = f"doc_id {kind}, piece int, start long, length long, ids binary"
    if numbered:
        return docs.select("doc_id", "text").mapInArrow(
            lambda batches: _number(cut(batches)), f"{fields}, pack_task long, pack_rank long")
    return docs.select("doc_id", "text").mapInArrow(cut, fields)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Places of all documents' token pieces in as few sequences of ``capacity`` as can be found.

    Columns as in :func:`token_pieces`, with ``ids_crc32`` in place of the ids, then ``sequence_id``
    and ``offset``. :func:`sequences` puts the ids themselves in place.
    """
    pieces = token_pieces(docs, path, capacity, end_id, numbered=True)
    # Spark's crc32 is the common one (zlib's).
    return _packed(pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "pack_task", "pack_rank"), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The packed sequences: ``sequence_id, length, pieces`` (offset, doc_id, piece, start, ids) by offset."""
    placed = _packed(token_pieces(docs, path, capacity, end_id, numbered=True), capacity)
    item = F.struct("offset", "doc_id", "piece", "start", "ids")
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(item)).alias("pieces")
    )

