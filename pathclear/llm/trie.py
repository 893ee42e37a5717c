"""Prefix trie of conversations by burst tries.

Turns become 128-bit ids, a conversation the array of its ids; equal conversations are one sequence with a
number of members. All sequences start in one container at the root. A container that holds more than
``CONTAINER`` turn ids bursts: its common prefix becomes a path of trie nodes, and its sequences fall into new
containers by their next turn id. Loads and prefixes of containers are sums, minima and maxima that Spark
combines before it shuffles, and a common prefix of any length takes one round. What is left are containers of
bounded size; each is sorted and swept into nodes in one task. Sums over subtrees then climb from the last
round's containers to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathclear.functions.settling import settle

#: Turn ids of a container that is not burst (a single sequence may be longer).
CONTAINER = 20_000
#: Ids that are joined to one string before a node's members are hashed.
CHUNK = 5000
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "end_key string")


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """``conv_id long, turns`` (id of role and text, UTF-8 bytes of the text) of every conversation.

    Turns stand in the order of ``turn`` (null first), ties in the order of their ids; rows that repeat are
    turns again. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are
    left out. A conversation's ids (28 bytes a turn, no texts) are one array, so they meet in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("id"),
        F.octet_length(text).alias("size"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % 5, where
    h is the crc32 of c's decimal digits modulo 9 (fewer if that one has fewer, none if it is absent)."""
    base = arrays.select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    none = F.slice("turns", 1, 0)
    return arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("lent", none), F.lit(1), h),
                            F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers; rows come container by container, sorted by their ids."""
    names = [f.split()[0] for f in _NODE.split(", ")] + ["parent_head", "round"]
    out: list[tuple] = []

    def nodes(rows: list[tuple]) -> list[tuple]:
        _, parent_head, round_, depth, parent_conv = rows[0][:5]
        made: list[list] = []  # depth, parent's place, least, n, children, leaves, saved, end, bytes
        path: list[int] = []

        def close(to: int) -> None:
            """Ends nodes deeper than ``to``."""
            while path and made[path[-1]][0] > to:
                node = made[path.pop()]
                node[5] = node[5] or 1
                node[6] += (node[3] - 1) * node[8]
                if path:
                    up = made[path[-1]]
                    up[2] = node[2] if up[2] is None else min(up[2], node[2])
                    for at, more in ((3, node[3]), (4, 1), (5, node[5]), (6, node[6])):
                        up[at] += more

        before: list[bytes] = []
        for *_, ids, sizes, n, least, key in rows:
            same = depth
            most = min(len(before), len(ids))
            while same < most and before[same] == ids[same]:
                same += 1
            close(same if made else depth - 1)
            for d in range(same + 1 if made else depth, len(ids) + 1):
                made.append([d, path[-1] if path else None, None, 0, 0, 0, 0, None, sizes[d - 1] if d else 0])
                path.append(len(made) - 1)
            end = made[path[-1]]
            end[2] = least if end[2] is None else min(end[2], least)
            end[3] += n
            end[7] = key
            before = ids
        close(-1)
        return [(x[2], x[0], parent_conv if x[1] is None else made[x[1]][2], x[3], x[4], x[5], x[6], x[7],
                 parent_head if x[1] is None else None, round_) for x in made]

    def batch() -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.int32()]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    held: list[tuple] = []
    order = ("head", "parent_head", "round", "depth", "parent_conv", "ids", "sizes", "n", "least", "key")
    for given in batches:
        for at in range(0, given.num_rows, 2000):
            part = given.slice(at, 2000)
            for row in zip(*(part.column(c).to_pylist() for c in order), strict=True):
                if held and row[0] != held[0][0]:
                    out += nodes(held)
                    held = []
                    if len(out) >= CHUNK:
                        yield batch()
                        out.clear()
                held.append(row)
    if held:
        out += nodes(held)
    yield batch()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a key's ids as strings; rows are sorted by key and id."""
    key, ids = None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "ids"])

    for given in batches:
        for k, c in zip(given.column("key").to_pylist(), given.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                yield chunk()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield chunk()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a key's chunks, joined by commas; rows are sorted by key and first id. Nothing is gathered."""
    key, digest, keys, out = None, None, [], []
    for given in batches:
        for k, text in zip(given.column("key").to_pylist(), given.column("ids").to_pylist(), strict=True):
            if k == key:
                digest.update(b",")
            else:
                if digest is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = k, hashlib.sha256()
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        keys, out = [], []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def member_digests(members: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``key, conv_id``: hash of a key's ids, ascending, joined by commas.

    Ids are sorted and joined in ranges that cut through a key however many it has; only its finished strings
    then stream through one task, as a hash has to be taken in order.
    """
    order = ["key", "conv_id"]
    chunks = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunked, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, ends_sha256 string")


def _burst(active: DataFrame, round_: int) -> tuple[DataFrame, DataFrame | None]:
    """Sequences marked where their container bursts, and the containers that do, with their common prefix."""
    load = active.groupBy("head").agg(F.sum(F.size("ids") - F.col("depth") + 1).alias("load"), F.count(F.lit(1)).alias("rows"))
    over = load.filter((F.col("load") > CONTAINER) & (F.col("rows") > 1)).select("head", F.lit(True).alias("over"))
    marked = settle(active.join(over, "head", "left").withColumn("over", F.coalesce("over", F.lit(False))))
    found = marked.filter("over").groupBy("head").agg(
        F.first("parent_head").alias("parent_head"), F.first("depth").alias("depth"), F.first("parent_conv").alias("parent_conv"),
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("ids", "sizes", "key")).alias("low"),
        F.max("ids").alias("high"))
    same = F.zip_with(F.col("low.ids"), F.col("high"), lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, False)
    heads = settle(found.withColumn("end", F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")).select(
        "head", "parent_head", "depth", "end", "parent_conv", "n", "least", F.col("low.sizes").alias("sizes"),
        F.when(F.size("low.ids") == F.col("end"), F.col("low.key")).alias("end_key"), F.lit(round_).alias("round")))
    return marked, None if heads.isEmpty() else heads


def _path_nodes(heads: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on the paths of burst containers, and what each adds to the container above it.

    ``tops``: what their own containers add (parent_head, n_leaves, saved_tokens).
    """
    below = tops.groupBy(F.col("parent_head").alias("head")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    known = heads.join(below, "head")

    def saved(first):
        # Bytes of the texts of depths first to end, of what more than one member has.
        sizes = F.slice("sizes", F.greatest(first, F.lit(1)), F.col("end") - F.greatest(first, F.lit(1)) + 1)
        return F.col("below") + (F.col("n") - 1) * F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)

    known = settle(known.withColumn("saved_tokens", saved(F.col("depth"))))
    nodes = known.withColumn("d", F.explode(F.sequence("depth", "end"))).select(
        F.col("least").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == F.col("depth"), F.col("parent_conv")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("d") == F.col("end"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves", saved(F.col("d")).alias("saved_tokens"), F.when(F.col("d") == F.col("end"), F.col("end_key")).alias("end_key"))
    return nodes, known.select("parent_head", "n_leaves", "saved_tokens")


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """All nodes of the trie of ``arrays`` (conv_id, unique; turns as in :func:`turn_arrays`).

    Returns for each node, of the root on: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs`` (members), ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, and
    ``ends_sha256`` over the ids of members that end there. Conversations without turns are members of the
    root. No conversations make no nodes.
    """
    key = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""), 256)
    convs = settle(arrays.select("conv_id", key.alias("key"), "turns"))
    active = convs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns")).select(
        F.left("key", F.lit(0)).alias("head"), F.lit(None).cast("string").alias("parent_head"), F.lit(0).alias("round"), F.lit(0).alias("depth"),
        F.lit(None).cast("long").alias("parent_conv"), F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"), "n", "least", "key")
    rest, bursts = [], []
    while True:
        marked, heads = _burst(active, len(bursts))
        rest.append(marked.filter(~F.col("over")).drop("over"))
        if heads is None:
            break
        bursts.append(heads)
        up = heads.select("head", F.col("end").alias("cut"), F.col("least").alias("up"))
        active = marked.filter("over").drop("over", "parent_head", "round", "depth", "parent_conv").join(up, "head").filter(
            F.size("ids") > F.col("cut")).select(
            F.sha2(F.concat("head", F.hex(F.get("ids", F.col("cut")))), 256).alias("head"), F.col("head").alias("parent_head"),
            F.lit(len(bursts)).alias("round"), (F.col("cut") + 1).alias("depth"), F.col("up").alias("parent_conv"),
            "ids", "sizes", "n", "least", "key")
    order = ["head", "ids"]
    swept = settle(reduce(DataFrame.unionByName, rest).repartition("head").sortWithinPartitions(*order).mapInArrow(
        _swept, f"{_NODE}, parent_head string, round int"))
    names = [f.split()[0] for f in _NODE.split(", ")]
    nodes = [swept.select(*names)]
    above = None
    for i in reversed(range(len(bursts))):
        tops = swept.filter((F.col("round") == i + 1) & F.col("parent_head").isNotNull()).select("parent_head", "n_leaves", "saved_tokens")
        made, above = _path_nodes(bursts[i], tops if above is None else tops.unionByName(above))
        nodes.append(made.select(*names))
    every = reduce(DataFrame.unionByName, nodes)
    ended = every.filter(F.col("end_key").isNotNull()).join(
        member_digests(convs.select("key", "conv_id")).withColumnRenamed("key", "end_key"), "end_key").drop("end_key")
    passed = every.filter(F.col("end_key").isNull()).drop("end_key").withColumn("ends_sha256", F.lit(NO_MEMBERS))
    return ended.unionByName(passed)


#: The same nodes in SQL: all prefixes of all conversations, grouped.
SQL = """
WITH given AS (
  SELECT conv_id, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    octet_length(encode(coalesce(text, ''))) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), arrays AS (
  SELECT conv_id, list({'id': id, 'size': size} ORDER BY turn NULLS FIRST, id) AS turns FROM given GROUP BY conv_id
), heads AS (
  SELECT *, CAST(xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9 AS INTEGER) AS h
  FROM arrays
), built AS (
  SELECT c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] AS turns
  FROM heads c LEFT JOIN arrays b ON b.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
  SELECT conv_id, d AS depth, len(turns) = d AS ends, CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size,
    sha256(array_to_string(list_transform(turns[1:d], lambda t: t.id), '')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda t: t.id), '')) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM built)
), nodes AS (
  SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node
), kids AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT a.depth, a.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM (SELECT DISTINCT p.depth, p.node, q.depth AS low_depth, q.node AS low FROM prefixes p JOIN prefixes q ON q.conv_id = p.conv_id AND q.depth >= p.depth) a
  JOIN nodes b ON b.depth = a.low_depth AND b.node = a.low
  LEFT JOIN kids k ON k.depth = b.depth AND k.node = b.node
  GROUP BY a.depth, a.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
  s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.parent
LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node
JOIN sums s ON s.depth = n.depth AND s.node = n.node
"""
