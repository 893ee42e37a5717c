"""Close places by tiles against all pairs, with seams, rims and more than one chunk."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathclear.operators import tiles


def test_tiles_find_every_pair_once(spark):
    rng = np.random.default_rng(5)
    seam = 0.6 * tiles.SIDE
    rows = []
    for frame, middle in ((0, (0.0, 0.0)), (1, (seam, seam / 2)), (2, (-seam, -seam / 2)), (3, (0.0, 1.5 * seam))):
        at = rng.normal(0, 1.2, (250, 3)) + [*middle, 0.0]
        rows += [(frame, 1000 - i, *map(float, p), float(rng.uniform(0.15, 0.6)), int(rng.integers(1, 4))) for i, p in enumerate(at)]
    rows += [(0, 5000, 0.0, 0.0, 1e100, 0.6, 1), (1, 5001, float("nan"), 0.0, 0.0, 0.6, 1), (1, 5002, None, 0.0, 0.0, 0.6, 2),
             (None, 1, 0.0, 0.0, 0.0, 0.6, 1), (None, 2, 0.0, 0.0, 0.1, 0.6, 1)]
    nodes = spark.createDataFrame(rows, "f int, id long, x double, y double, z double, eps double, copies long")
    neighbours, component = {}, {}
    for a in rows:
        neighbours[a[:2]], component[a[:2]] = a[6] - 1, a[1]
    links = []
    for f in range(4):
        own = [r for r in rows if r[0] == f and r[2] is not None and np.isfinite(r[2])]
        for i, a in enumerate(own):
            for b in own[:i]:
                if np.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) <= max(a[5], b[5]):
                    neighbours[a[:2]] += b[6]
                    neighbours[b[:2]] += a[6]
                    links.append((a[:2], b[:2]))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    assert {(r.f, r.id): r.neighbours for r in tiles.neighbour_counts(nodes, ["f"]).collect()} == neighbours
    assert {(r.f, r.id): r.component for r in tiles.close_components(nodes, ["f"]).collect()} == component


def test_pairs_are_never_rows(spark):
    # 14 rows for every place and a row for every pair went through the shuffle before.
    rows = [(0, i, i % 100 * 0.01, i // 100 * 0.01, 0.0, 0.6, 1) for i in range(2000)]
    nodes = spark.createDataFrame(rows, "f int, id long, x double, y double, z double, eps double, copies long")
    plan = tiles.neighbour_counts(nodes, ["f"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert tiles.tiled(nodes, ["f"], 0.6).count() <= 2 * 2000
    assert tiles.neighbour_counts(nodes, ["f"]).agg(F.min("neighbours")).first()[0] > 100


def test_chunks_and_batches_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    n = 400
    table = pa.table({
        "f": np.repeat([1, 2, 3, 4], n // 4), "x": rng.uniform(0, 4, n), "y": rng.uniform(0, 4, n), "z": rng.uniform(0, 2, n),
        "eps": rng.uniform(0.15, 0.6, n), "_tx": np.zeros(n, int), "_ty": np.zeros(n, int),
        "_own_x": np.ones(n, bool), "_own_y": np.ones(n, bool),
    })

    def pairs(parts):
        found, base = set(), 0
        for part, group in tiles.whole_groups(iter(parts), ["f", "_tx", "_ty"]):
            found |= {(base + min(i, j), base + max(i, j)) for a, b in tiles.close_pairs(part, group, 0.6) for i, j in zip(a, b)}
            base += part.num_rows
        assert base == n
        return found

    whole = pairs(table.to_batches())
    assert len(whole) > n // 4
    monkeypatch.setattr(tiles, "CHUNK", 7)
    for size in (1, 30, 100, 130):
        assert pairs(table.to_batches(max_chunksize=size)) == whole


def test_history_is_asked_once_for_each_cell(spark):
    from pathclear.operators.background import history_clearance

    cells = spark.createDataFrame(
        [(0, 0, 90, 10.0, 10.0, 0.0, 0.0), (0, 1, 90, 7.0, 7.0, 0.1, 0.0), (1, 0, 90, 9.0, 9.0, 0.0, 0.0)],
        "ordinal long, az int, el int, range double, x double, y double, z double")
    links = spark.createDataFrame([(1, 0, 0.5)], "ordinal long, past long, shift double")
    zero = (F.lit(0.0),) * 3
    first = history_clearance(cells, links, cells, [], 1.0, 120.0, zero)
    names = {r.ordinal: r for r in first.collect()}
    # Which cells the point at 9.5 m meets depends on the grid's origin; where it meets any, the nearest counts.
    assert all(r.clearance == r.seen - 9.5 for r in names.values())
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_components_carry_the_facts_of_a_cell(spark):
    from pathclear.operators.graph import cell_components

    cells = spark.createDataFrame([(0, 1, 1, 5.0, 3), (0, 2, 2, 5.1, 1), (0, 9, 9, 5.0, 2)], "f int, az int, el int, range double, channels int")
    found = {r.az: (r.component, r.channels) for r in cell_components(cells, ["f"], carried=["channels"]).collect()}
    assert found[1][0] == found[2][0] != found[9][0] and [found[a][1] for a in (1, 2, 9)] == [3, 1, 2]
