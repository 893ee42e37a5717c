"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words (lower-cased, split at white space; a text of fewer words is
one shingle). Texts with equal sets are one node with a number of copies. In each run every node samples
tokens of its set, each with probability ``SHARED`` / size by a hash of the token, so two sets of similarity
J share a sampled token with probability of at least 1 - exp(-J * SHARED). The nodes of a token are a bucket. A
bucket over ``SMALL`` nodes is split again on tokens sampled the same way under the bucket's own hash,
unless that would not lessen the work: its nodes then share nearly everything (a group of near copies).
Buckets that cannot be split are compared whole, in blocks, so none is ever cut short. Runs repeat until
a pair of just the threshold's similarity is met with probability ``RECALL``.

Within a bucket, pairs whose sizes differ too much, or whose sketches (64 bytes of one-permutation
min-hashes, for sets that are large enough) are far from the threshold, are put aside first; only nodes
with a likely partner go on with their whole sets. A bucket's pairs are compared exactly, by products of the sets' incidence matrices; a pair that meets in
several buckets counts in the one of smallest key. No pairs leave a bucket: a node's link counts are summed
there, and its links are reduced to a spanning forest, from which components are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pathclear.functions.settling import settle
from pathclear.llm.pieces import code_points, mixed, powers, steps
from pathclear.operators.graph import connected_components, merge_labels

WORDS, THRESHOLD_PARTS = 5, (4, 5)  # five words, similarity of 4/5 or more
RECALL = 0.99999
#: Tokens sampled per set and run, and per bucket that is split.
SHARED, SPLIT = 2.0, 3.0
#: Nodes of a bucket that is not split; of a larger one, nodes and bytes of a block, and nodes of a block of sketches.
SMALL, BLOCK, BLOCK_BYTES, SKETCH_BLOCK = 64, 1024, 32 << 20, 4096

#: Bins of a sketch, smallest set that has one, and share of equal bins below which a pair is put aside: a pair
#: of just the threshold's similarity has fewer about once in twenty million (one sketch serves all runs).
BINS, SKETCHED, LIKELY = 64, 200, 0.5

_BLANK = np.zeros(0x110000, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_POWERS = powers(0xBF58476D1CE4E5B9, 4096)
_U = np.uint64


def runs() -> int:
    """Runs that reach the target recall, and the chance of losing a pair at a split too."""
    similarity = THRESHOLD_PARTS[0] / THRESHOLD_PARTS[1]
    met = (1 - math.exp(-similarity * SHARED)) * (1 - math.exp(-similarity * SPLIT))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - met))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of every text, one text after another, and their edges."""
    low = [t.lower() for t in texts]
    cp = code_points("\n".join(low))
    size = np.array([len(t) for t in low], np.int64)
    first = np.cumsum(size + 1) - size - 1
    blank = _BLANK[cp]
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    if not len(begin):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    doc = np.searchsorted(first, begin, side="right") - 1
    length = end - begin
    at = np.cumsum(length) - length
    offset = np.arange(length.sum()) - np.repeat(at, length)
    value = mixed(cp[~blank], 31) * _POWERS[offset % len(_POWERS)]
    word = mixed(np.add.reduceat(value, at) + length.astype(_U), 37)
    salted = [mixed(word, 41 + k) for k in range(WORDS)]
    last = len(word) - WORDS + 1
    whole = np.flatnonzero(doc[WORDS - 1 :] == doc[: max(0, last)]) if last > 0 else np.zeros(0, np.int64)
    gram = sum((salted[k][whole + k] for k in range(WORDS)), np.zeros(len(whole), _U))
    owner = doc[whole]
    counts = np.bincount(doc, minlength=len(texts))
    brief = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(brief):
        place = np.searchsorted(doc, brief)
        with np.errstate(over="ignore"):
            short = [sum((salted[k][p + k] for k in range(n)), _U(n)) for p, n in zip(place, counts[brief], strict=True)]
        gram, owner = np.r_[gram, np.array(short, _U)], np.r_[owner, brief]
    gram = mixed(gram, 43)
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]
    gram, owner = gram[new], owner[new]
    return gram, np.searchsorted(owner, np.arange(len(texts) + 1))


def _limit(size: np.ndarray, expected: float) -> np.ndarray:
    """Hashes up to this are sampled."""
    share = np.minimum(1.0, expected / np.maximum(size, 1))
    return np.where(share >= 1, _U(2**64 - 1), (share * 2.0**63).astype(_U) * _U(2))


def chosen(gram: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every text in all runs, and those that each of them would be split into.

    Returns owners and keys of the buckets, in order of owners, then bucket numbers and keys of the splits.
    """
    size = np.diff(edges)
    owner = np.repeat(np.arange(len(size)), size)
    limit = _limit(size, SHARED)[owner]
    owners, keys = [], []
    for r in range(runs()):
        u = mixed(gram, 101 + r)
        hit = np.flatnonzero(u <= limit)
        owners.append(owner[hit])
        keys.append(mixed(u[hit], 211 + r))
    owners, keys = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((keys, owners))
    owners, keys = owners[order], keys[order]
    split = _limit(size, SPLIT)[owner]
    first = np.searchsorted(owners, np.arange(len(size) + 1))
    count = np.diff(first)
    at, split_keys = [], []
    tokens = np.arange(len(gram))
    for nth in range(int(count.max()) if len(count) else 0):
        tokens = tokens[count[owner[tokens]] > nth]
        bucket = first[owner[tokens]] + nth
        u = mixed(gram[tokens] ^ keys[bucket], 307)
        hit = u <= split[tokens]
        at.append(bucket[hit])
        split_keys.append(mixed(u[hit] ^ keys[bucket[hit]], 311))
    if not at:
        return owners, keys, np.zeros(0, np.int64), np.zeros(0, _U)
    at, split_keys = np.concatenate(at), np.concatenate(split_keys)
    order = np.argsort(at, kind="stable")
    return owners, keys, at[order], split_keys[order]


def sketches(gram: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A row of bytes for each text: what is left of the least shingle of each bin, 0 for an empty bin."""
    out = np.zeros((len(edges) - 1, BINS), np.uint8)
    if len(gram):
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        bin_ = (gram >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
        least = np.r_[True, (bin_[1:] != bin_[:-1]) | (owner[1:] != owner[:-1])]  # shingles are sorted
        out[owner[least], bin_[least]] = (mixed(gram[least], 503) % _U(255)).astype(np.uint8) + 1
    return out


def likely(size: np.ndarray, sketch: np.ndarray, a: slice) -> np.ndarray:
    """Which pairs of rows ``a`` with all rows may be similar enough."""
    least, most = np.minimum(size[a, None], size[None, :]), np.maximum(size[a, None], size[None, :])
    fits = THRESHOLD_PARTS[1] * least >= THRESHOLD_PARTS[0] * most
    rows, others = sketch[a, None, :], sketch[None, :, :]
    equal = ((rows == others) & (rows > 0)).sum(2)
    filled = ((rows > 0) | (others > 0)).sum(2)
    return fits & ((least < SKETCHED) | (equal >= LIKELY * filled))


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, node) of the nodes of a bucket, or of a pair of its blocks, that have a likely partner there."""
    def result(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[1]: r for r in rows}.values())
        own, node, size = (np.array(x) for x in list(zip(*rows, strict=True))[:3])
        sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, BINS)
        keep = np.zeros(len(rows), bool)
        step = max(1, (8 << 20) // (len(rows) * BINS))
        for i in range(0, len(rows), step):
            a = slice(i, min(i + step, len(rows)))
            fits = likely(size, sketch, a)
            fits[np.arange(a.stop - i), np.arange(i, a.stop)] = False
            if key[1] != key[2]:
                fits &= own[a, None] != own[None, :]
            keep[a] |= fits.any(1)
        return [(key[0], int(n)) for n in node[keep]]

    key, held = None, []
    for batch in batches:
        out: list[tuple[int, int]] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high", "own", "node", "size", "sketch")), strict=True):
            if row[:3] != key:
                if len(held) > 1:
                    out += result(key, held)
                key, held = row[:3], []
            held.append(row[3:])
        yield _pairs(out)
    if len(held) > 1:
        yield _pairs(result(key, held))


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    path, node = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(node, pa.int64())], names=["path", "node"])


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64))


def _offsets(edges: np.ndarray) -> pa.Array:
    return pa.array(edges.astype(np.int32))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in steps(batch):
            gram, edges = shingles(texts)
            size = np.diff(edges)
            node, check = np.zeros(len(texts), _U), np.zeros(len(texts), _U)
            some = np.flatnonzero(size)
            if len(some):
                node[some] = np.add.reduceat(mixed(gram, 401), edges[some])
                check[some] = np.bitwise_xor.reduceat(mixed(gram, 409), edges[some])
            owners, keys, at, split_keys = chosen(gram, edges)
            kids = pa.ListArray.from_arrays(_offsets(np.searchsorted(at, np.arange(len(keys) + 1))), _longs(split_keys))
            buckets = pa.StructArray.from_arrays([_longs(keys), kids], names=["path", "kids"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), _longs(mixed(node, 419)), _longs(check), _longs(size),
                 pa.array([r.tobytes() for r in sketches(gram, edges)], pa.binary()),
                 pa.ListArray.from_arrays(_offsets(np.searchsorted(owners, np.arange(len(texts) + 1))), buckets)],
                names=["doc_id", "text_key", "node", "check", "size", "sketch", "buckets"])


def _shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, and block of it, that a node is compared in."""
    for batch in batches:
        for part, texts in steps(batch):
            gram, edges = shingles(texts)
            rows = part.select(["node", "copies", "places"]).to_pylist()
            out = {k: [] for k in ("path", "low", "high", "own", "node", "copies", "grams", "paths")}
            held = 0
            for row, i, j in zip(rows, edges[:-1], edges[1:], strict=True):
                data = gram[i:j].tobytes()
                paths = np.sort(np.array([p["path"] for p in row["places"]], np.int64)).tobytes()
                for p in row["places"]:
                    own = (row["node"] >> 7) % p["blocks"]
                    for other in range(p["blocks"]):
                        for k, v in zip(out, (p["path"], min(own, other), max(own, other), own, row["node"], row["copies"], data, paths), strict=True):
                            out[k].append(v)
                        held += len(data)
                if held > BLOCK_BYTES:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"low": pa.int32(), "high": pa.int32(), "own": pa.int32(), "grams": pa.binary(), "paths": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def _incidence(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows of sets, columns of tokens that several of them have, some columns at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    several = np.bincount(token)[token] > 1 if len(token) else np.zeros(0, bool)
    token, owner = token[several], owner[several]
    token = np.unique(token, return_inverse=True)[1]
    width = max(1, (8 << 20) // len(sets))
    for low in range(0, int(token.max()) + 1 if len(token) else 0, width):
        here = slice(*np.searchsorted(token, [low, low + width]))
        grid = np.zeros((len(sets), min(width, int(token.max()) + 1 - low)), np.float32)
        grid[owner[here], token[here] - low] = 1
        yield grid


def compare(path: int, low: int, high: int, rows: list[tuple]) -> list[tuple[int, int | None, int]]:
    """Link counts (node, None, count) and forest links (node, node, 0) of one bucket or pair of its blocks.

    Rows are (own block, node, copies, shingles, sorted bucket keys).
    """
    seen = {r[1]: r for r in rows}  # a document that is repeated comes more than once
    rows = sorted(seen.values(), key=lambda r: r[0])
    size = np.array([len(r[3]) for r in rows])
    # Of two blocks only the pairs between them.
    cut = len(rows) if low == high else sum(r[0] == low for r in rows)
    left, right = slice(0, cut), slice(0 if low == high else cut, len(rows))
    both = np.zeros((left.stop, right.stop - right.start), np.float32)
    for grid in _incidence([r[3] for r in rows]):
        both += grid[left] @ grid[right].T
    a, b = THRESHOLD_PARTS
    both = both.astype(np.int64)
    alike = np.zeros((len(rows), len(rows)), bool)
    alike[left, right] = both * (a + b) >= a * (size[left, None] + size[None, right])
    if low == high:
        np.fill_diagonal(alike, False)
    else:
        alike |= alike.T
    linked = np.flatnonzero(alike.any(1))
    if not len(linked):
        return []
    alike = alike[np.ix_(linked, linked)]
    node = np.array([rows[i][1] for i in linked], np.int64)
    copies = np.array([rows[i][2] for i in linked], np.int64)
    earlier = [rows[i][4][rows[i][4] < path] for i in linked]
    met = np.zeros(alike.shape, np.float32)
    for grid in _incidence(earlier):
        met += grid @ grid.T
    counts = (alike & (met == 0)) @ copies
    x, y = np.nonzero(np.triu(alike))
    label = merge_labels(len(linked), x, y)
    out: list[tuple[int, int | None, int]] = [(int(n), None, int(c)) for n, c in zip(node, counts, strict=True) if c]
    return out + [(int(node[i]), int(node[k]), 0) for i, k in enumerate(label) if i != k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    key = None

    def result(rows: list[tuple]) -> pa.RecordBatch:
        u, v, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("path", "low", "high", "own", "node", "copies", "grams", "paths")]
        for path, low, high, own, node, copies, grams, paths in zip(*columns, strict=True):
            if (path, low, high) != key:
                if len(held) > 1:
                    out += compare(*key, held)
                held, key = [], (path, low, high)
            held.append((own, node, copies, np.frombuffer(grams, _U), np.frombuffer(paths, np.int64)))
        yield result(out)
    if len(held) > 1:
        yield result(compare(*key, held))


def _figures(groups: GroupedData) -> DataFrame:
    mark = F.xxhash64("node")
    return groups.agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.bit_xor(mark).alias("x"),
        F.sum(F.shiftrightunsigned(mark, 20)).alias("s"))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows with a hash of their text, by which a node's text is found again."""
    return docs.select(*columns, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their nodes; nodes with class id, links, own first row and the class's first row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs, "doc_id", "text")
    described = settle(keyed.mapInArrow(
        _described, f"doc_id {kind}, text_key long, node long, check long, size long, sketch binary, "
        "buckets array<struct<path:bigint,kids:array<bigint>>>"))
    nodes = described.groupBy("node", "check").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("one"),
        F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    nodes = settle(nodes)
    rows = nodes.select("node", "size", F.explode("buckets").alias("b")).select("node", "size", "b.path", "b.kids")
    figures = settle(_figures(rows.groupBy("path")).filter("n > 1"))
    met = settle(rows.join(figures.select("path", "n"), "path"))
    large = met.filter(F.col("n") > SMALL).withColumnRenamed("path", "parent").drop("n")
    # Near copies have almost the same parts: equal lists of them are counted before any is taken apart.
    alike = _figures(large.groupBy("parent", "kids"))
    split = settle(alike.select("parent", F.explode("kids").alias("path"), "n", "tokens", "x", "s").groupBy("parent", "path").agg(
        F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")).filter("n > 1"))
    # Comparing a bucket's parts must be less work than comparing the bucket.
    work = split.groupBy(F.col("parent").alias("path")).agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    judged = figures.join(work, "path", "left").withColumn(
        "whole", (F.col("n") <= SMALL) | (F.coalesce("work", F.lit(0)) >= F.col("n") * F.col("n")))
    cut = settle(judged.filter(~F.col("whole")).select(F.col("path").alias("parent")))
    parts = split.join(cut, "parent", "left_semi")
    kids = large.join(cut, "parent", "left_semi").select("node", F.explode("kids").alias("path"))
    last = judged.filter("whole").select("path", "n", "tokens", "x", "s").unionByName(
        parts.select("path", "n", "tokens", "x", "s"))
    # Buckets of the same nodes are one.
    compared = last.groupBy("n", "x", "s").agg(F.min("path").alias("path"), F.max("tokens").alias("tokens")).select(
        "path", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"),
        F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("sketch_blocks"))
    members = met.select("node", "path").unionByName(kids.select("node", "path")).distinct()
    block = F.expr("pmod(shiftright(node, 7), sketch_blocks)").cast("int")
    drawn = members.join(compared, "path").join(nodes.select("node", "size", "sketch"), "node").withColumn("own", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("sketch_blocks") - 1)))
    keys = ["path", "low", "high"]
    seen = drawn.select(
        "path", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "size", "sketch"
    ).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_partnered, "path long, node long").distinct()
    places = seen.join(compared.select("path", "blocks"), "path").groupBy("node").agg(F.collect_list(F.struct("path", "blocks")).alias("places"))
    wanted = settle(places.join(nodes.select("node", "one", "copies"), "node"))
    texts = keyed.join(
        wanted.select("node", "copies", "places", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key")),
        F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key")))
    shipped = texts.select("text", "node", "copies", "places").mapInArrow(
        _shipped, "path long, low int, high int, own int, node long, copies long, grams binary, paths binary")
    found = settle(shipped.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high").mapInArrow(
        _compared, "u long, v long, n long"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    forest = found.filter("v is not null").select("u", "v")
    ends = forest.select(F.col("u").alias("id")).union(forest.select("v")).distinct()
    groups = settle(connected_components(ends, forest, []).withColumnRenamed("id", "node").join(
        nodes.select("node", "least", "one"), "node"))
    least = groups.groupBy("component").agg(F.min("least").alias("class_least"), F.min("one").alias("class_one"))
    classes = groups.join(least, "component").select("node", "class_least", "class_one")
    result = nodes.select("node", "least", "one", "copies").join(counts, "node", "left").join(classes, "node", "left").select(
        "node", F.when(F.col("class_one").isNull(), F.col("least")).otherwise(F.col("class_least")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        "one", F.coalesce("class_one", "one").alias("first"))
    return described.select("doc_id", "node"), result


def similarity_join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``docs``.

    ``n_links`` is the number of other rows whose set is similar by 4/5 or more, ``class_id`` the smallest
    doc_id that is reachable by links (its own, without any). Null and empty texts, and those of white space
    alone, have the empty set and are similar to each other only. Rows that repeat are copies of each other.
    Rows without an id are kept; a class of such rows alone has a null id. Other columns are not read.
    """
    rows, nodes = _classes(docs)
    return rows.join(nodes, "node").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their class (by id, then by a hash of the text; no id is
    before all), with all their columns. Of equal first rows one stays."""
    _, nodes = _classes(docs)
    kept = settle(nodes.filter(F.col("one").eqNullSafe(F.col("first"))).select(
        F.col("one.doc_id").alias("kept_id"), F.col("one.text_key").alias("kept_key")))
    found = _keyed(docs, *docs.columns).join(
        kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    return found.dropDuplicates(["doc_id", "text_key"]).select(*docs.columns)
