"""Merkle manifest of a dataset by checkpoint and recompute.

A row is a leaf; the leaves of a part (a language) ascend by id, every ``WIDTH`` consecutive nodes have a
parent, and the parts' roots form a tree in the same way. Only every ``KEPT``-th level is written, each as
aligned subtrees: rows of at most WIDTH ** KEPT nodes. Proofs are extracted top-down: a task regenerates the
missing levels of one subtree from its written nodes, emits every node's siblings in front of those of the
subtree's top, and discards them. A part's nodes are numbered by ranges of the sorted rows, so a part
that holds most rows spreads over tasks like any other, and no task sees more than a subtree.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathclear.functions.settling import settle

#: Children of a node; levels from one written level to the next.
WIDTH, KEPT = 8, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def combined(nodes) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Lower-case SHA-256 over the fields in order: UTF-8 byte count, colon and value; ``-`` for a null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def regenerated(nodes: list[str], count: int, kept: int) -> list[list[str]]:
    """A subtree's levels, from its written nodes up, as long as the part has several nodes (``count`` on the
    lowest). The last level is the subtree's top."""
    levels = [nodes]
    for _ in range(kept):
        if count == 1:
            break
        nodes = [combined(nodes[i : i + WIDTH]) for i in range(0, len(nodes), WIDTH)]
        count = -(-count // WIDTH)
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of a node's path in each of its runs, bottom up."""
    for level in levels[:-1]:
        run = at - at % WIDTH
        yield "".join(level[run:at]), "".join(level[at + 1 : run + WIDTH])
        at //= WIDTH


def folded(node: str, path) -> str:
    """The root that a node and its siblings make."""
    for left, right in path:
        node = combined((left, node, right))
    return node


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a row's task and its number within its part there; rows are sorted by part."""
    task, part, rank = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ranks = []
        for p in batch.column("part").to_pylist():
            rank, part = (rank + 1, part) if p == part else (0, p)
            ranks.append(rank)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(ranks, pa.int64())],
            names=[*batch.schema.names, "task", "rank"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, a row's place in its ``part`` by ``order``, and ``count``, the part's rows.

    ``order`` has to tell all rows apart. Only a count for each part and range of sorted rows is joined back.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = settle(rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order).mapInArrow(
        _counted, f"{fields}, task int, rank long"))
    held = ranged.groupBy("part", "task").agg(F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("part")
    before = held.select(
        "part", "task", (F.sum("held").over(whole.orderBy("task")) - F.col("held")).alias("before"),
        F.sum("held").over(whole).alias("count"))
    return ranged.join(before, ["part", "task"]).withColumn("at", F.col("rank") + F.col("before")).drop("task", "rank", "before")


def subtrees(nodes: DataFrame, kept: int) -> DataFrame:
    """Aligned subtrees of ``nodes`` (part, at, count, node and more): ``part, block, count, items``."""
    item = [c for c in nodes.columns if c not in ("part", "count", "at")]
    return settle(nodes.groupBy("part", F.expr(f"at div {WIDTH**kept}").alias("block")).agg(
        F.first("count").alias("count"), F.sort_array(F.collect_list(F.struct("at", F.struct(*item).alias("of")))).alias("items")))


def _tops(level: DataFrame, kept: int) -> DataFrame:
    """``part, at, count, node`` of the tops of a level's subtrees, the nodes of the next written level."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "block", "count", "nodes")), strict=True)
            out = [(part, block, -(-count // WIDTH**kept), regenerated(nodes, count, kept)[-1][0]) for part, block, count, nodes in rows]
            part, at, count, node = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array(at, pa.int64()), pa.array(count, pa.int64()), pa.array(node, pa.string())],
                names=["part", "at", "count", "node"])

    return level.select("part", "block", "count", F.col("items.of.node").alias("nodes")).mapInArrow(
        kernel, "part string, at long, count long, node string")


def written_levels(leaves: DataFrame, kept: int) -> list[DataFrame]:
    """Every ``kept``-th level of all parts' trees as aligned subtrees, leaves first; in the last one each part has
    one subtree. ``leaves``: part, at, count, node and more."""
    levels = [subtrees(leaves, kept)]
    while not levels[-1].filter("block > 0").isEmpty():
        levels.append(subtrees(_tops(levels[-1], kept), kept))
    return levels


@dataclass(frozen=True)
class Manifest:
    """``levels``: written levels of the parts' trees; ``top``: those of the tree over their roots, whose
    leaves are the parts in order; ``kept``: levels from one written level to the next."""

    levels: list[DataFrame]
    top: list[DataFrame]
    kept: int


def manifest(leaves: DataFrame, order: list[str], kept: int = KEPT) -> Manifest:
    """Manifest of ``leaves`` (part, node and more; ``order`` tells all rows apart). Parts ascend bytewise."""
    levels = written_levels(numbered(leaves, order), kept)
    roots = _tops(levels[-1], kept).select(F.lit("").alias("part"), F.col("part").alias("key"), "node")
    return Manifest(levels, written_levels(numbered(roots, ["key"]), kept), kept)


def _paths(kept: int, finish: Callable[[list[dict], list[list[tuple[str, str]]], dict], pa.RecordBatch]):
    """Kernel over subtrees: every node's siblings below the subtree's top, then those above it."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                items = [x["of"] for x in row["items"]]
                levels = regenerated([x["node"] for x in items], row["count"], kept)
                above = [(p["left"], p["right"]) for p in row["path"] or ()]
                yield finish(items, [[*siblings(levels, k), *above] for k in range(len(items))], row)

    return kernel


_PATH = "array<struct<left:string,right:string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _passed_on(items: list[dict], paths: list, row: dict) -> pa.RecordBatch:
    """Paths of a subtree's nodes, which are the tops of the subtrees below."""
    n, first = len(items), row["items"][0]["at"]
    return pa.RecordBatch.from_arrays(
        [pa.array([row["part"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
         pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATH_TYPE),
         pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string())],
        names=["part", "block", "path", "subroot", "root"])


def _top_passed(items: list[dict], paths: list, row: dict) -> pa.RecordBatch:
    """Paths of the parts in the tree over their roots."""
    return pa.RecordBatch.from_arrays(
        [pa.array([x["key"] for x in items], pa.string()), pa.array([0] * len(items), pa.int64()),
         pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATH_TYPE),
         pa.array([x["node"] for x in items], pa.string()), pa.array([folded(items[0]["node"], paths[0])] * len(items), pa.string())],
        names=["part", "block", "path", "subroot", "root"])


_BELOW = f"part string, block long, path {_PATH}, subroot string, root string"


def _above_leaves(made: Manifest) -> DataFrame:
    """Lowest subtrees with their top's siblings up to the root, ``subroot`` and ``root``."""
    path = None
    for level in reversed(made.top):
        given = level.withColumn("path", F.lit(None).cast(_PATH)) if path is None else level.join(path, ["part", "block"])
        last = level is made.top[0]
        path = settle(given.withColumn("subroot", F.lit(None).cast("string")).withColumn("root", F.lit(None).cast("string")).mapInArrow(
            _paths(made.kept, _top_passed if last else _passed_on), _BELOW))
        if not last:
            path = path.drop("subroot", "root")
    for level in reversed(made.levels[1:]):
        path = settle(level.join(path, ["part", "block"]).mapInArrow(_paths(made.kept, _passed_on), _BELOW))
    return made.levels[0].join(path, ["part", "block"])


def proofs(made: Manifest, column: str) -> DataFrame:
    """Every leaf's ``column`` column, ``leaf``, ``subroot``, ``root`` and ``path``: left and right siblings of each
    level, from the leaf's up through the part's root to the root."""
    kind = made.levels[0].schema["items"].dataType.elementType["of"].dataType[column].dataType
    of = _arrow(kind)

    def finish(items: list[dict], paths: list, row: dict) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[column] for x in items], of), pa.array([x["node"] for x in items], pa.string()),
             pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string()),
             pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATH_TYPE)],
            names=[column, "leaf", "subroot", "root", "path"])

    return _above_leaves(made).mapInArrow(
        _paths(made.kept, finish), f"`{column}` {kind.simpleString()}, leaf string, subroot string, root string, path {_PATH}")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def verified(made: Manifest, column: str, claimed: str) -> DataFrame:
    """Checks ``claimed`` leaf hashes against the proofs: ``column``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``
    (hash of all siblings), ``folded_root`` (made from the claim and the siblings), ``verified``."""
    kind = made.levels[0].schema["items"].dataType.elementType["of"].dataType[column].dataType
    of = _arrow(kind)

    def finish(items: list[dict], paths: list, row: dict) -> pa.RecordBatch:
        n = len(items)
        roots = [folded(x[claimed], p) for x, p in zip(items, paths, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[column] for x in items], of), pa.array([x["node"] for x in items], pa.string()),
             pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string()),
             pa.array([combined(itertools.chain.from_iterable(p)) for p in paths], pa.string()), pa.array(roots, pa.string()),
             pa.array([r == row["root"] for r in roots], pa.bool_())],
            names=[column, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _above_leaves(made).mapInArrow(
        _paths(made.kept, finish), f"`{column}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean")


def document_manifest(docs: DataFrame, claim: Column | None = None, kept: int = KEPT) -> Manifest:
    """Manifest of ``docs`` (doc_id, source, lang, n_chars, text): a part for each lang, null first.

    Leaves stand in the order of doc_id (null first), then of their hashes; rows that repeat are leaves again.
    ``claim`` replaces the text for the ``claimed`` leaf hash that :func:`verified` checks. Nulls are told from
    empty texts. Other columns are not read; an empty table has an empty manifest.
    """
    def hashed(text):
        return leaf_hash([text if f == "text" else F.col(f) for f in FIELDS])

    # Written once: a row's mark, which tells repeated rows apart, stays the same.
    leaves = settle(docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("part"),
        hashed(F.col("text")).alias("node"), hashed(F.col("text") if claim is None else claim).alias("claimed"),
        F.monotonically_increasing_id().alias("mark")))
    return manifest(leaves, ["doc_id", "node", "mark"], kept)


def tampered_text() -> Column:
    """The text in lower case (A-Z only) where 3 divides the crc32 of doc_id's decimal digits."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


#: The same figures in SQL; levels, siblings and folding by recursion.
SQL = """
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, text, CAST(xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 3 AS INTEGER) AS third,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN third = 0 THEN sha256(head || coalesce(octet_length(encode(text)) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY part) AS n FROM leaves
), tree AS (
  SELECT 0 AS level, part, place, n, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, part, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY level, part, place // 8, n
), subroots AS (
  SELECT part, node, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS n, level AS height FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, place, n, node FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 8, n
), sides AS (
  SELECT level, part, place, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM tree WHERE n > 1 WINDOW run AS (PARTITION BY level, part, place // 8 ORDER BY place)
), top_sides AS (
  SELECT level, place, coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM top WHERE n > 1 WINDOW run AS (PARTITION BY level, place // 8 ORDER BY place)
), steps AS (
  SELECT p.part, p.place, s.level, s.a, s.b FROM placed p JOIN sides s ON s.part = p.part AND s.place = p.place // CAST(8 ** s.level AS BIGINT)
  UNION ALL
  SELECT p.part, p.place, r.height + s.level, s.a, s.b FROM placed p JOIN subroots r ON r.part = p.part JOIN top_sides s ON s.place = r.place // CAST(8 ** s.level AS BIGINT)
), proof AS (
  SELECT part, place, sha256(string_agg(a || b, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY part, place
), fold AS (
  SELECT part, place, 0 AS level, coalesce(changed, leaf) AS node FROM placed
  UNION ALL
  SELECT f.part, f.place, f.level + 1, sha256(s.a || f.node || s.b) FROM fold f JOIN steps s ON s.part = f.part AND s.place = f.place AND s.level = f.level
), ends AS (
  SELECT part, place, arg_max(node, level) AS folded_root FROM fold GROUP BY part, place
), root AS (
  SELECT node AS root FROM top WHERE n = 1
)
SELECT p.doc_id, p.leaf, r.node AS subroot, root.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = root.root AS verified
FROM placed p JOIN subroots r ON r.part = p.part JOIN ends e ON e.part = p.part AND e.place = p.place
LEFT JOIN proof q ON q.part = p.part AND q.place = p.place CROSS JOIN root
"""
