"""Near-duplicate vectors by collision-counting projections.

Vectors of length one are projected on many random lines.  Two of them at distance d
differ by a normal number with deviation d on each line, so a window of a few
deviations around the query holds its near duplicates on nearly every line.  Within a
block the vectors are sorted along a line, the window of each query gives pairs, and
the lines on which a pair collides are counted; pairs that miss more lines than
near duplicates do (calibrated from the binomial distribution to the wanted recall)
are dropped, the rest is verified by cosine in double precision.

Blocks.  Vectors meet only within their label.  A label beyond BLOCK vectors is also
cut by a grid on the first lines of a group; a vector goes to each cell that its own
windows touch, and several groups keep the recall.  Blocks are cut into pairs of
tiles, so no task holds more than two tiles, whatever the size of a label or cluster.
Equal vectors are one class from the start.  A tile gives link counts and a spanning
forest of its links, never its pairs.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize, query, table
from fieldloom.llm.components import components

#: Cosine of a link, lines of a group, half window in deviations, wanted recall, vectors of a block without a grid, rows of a tile, pairs at once, seed.
COSINE, LINES, REACH, RECALL, BLOCK, TILE, PAIRS, SEED = 0.98, 16, 4.0, 0.9999, 1 << 15, 2048, 1 << 19, 11
MOST_GRID, GROUPS = 8, 3


def distance(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def least_collisions(lines: int, reach: float, recall: float) -> int:
    """The largest count that a pair at the limit reaches with the wanted probability."""
    q = math.erf(reach / math.sqrt(2))
    tail = 0.0
    for k in range(lines, -1, -1):
        tail += math.comb(lines, k) * q**k * (1 - q) ** (lines - k)
        if tail >= recall:
            return k
    return 0


def lines_of(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def grid_lines(largest: int) -> int:
    """Lines that cut a block of this many vectors down to BLOCK, at three quarters a line."""
    return 0 if largest <= BLOCK else min(MOST_GRID, math.ceil(math.log(largest / BLOCK) / math.log(4 / 3)))


def usable(vector: Column, label: Column, key: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return key.isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _cells(group: DataFrame, grid: int, groups: int, half: float, lines: int, seed: int) -> DataFrame:
    """A row for each cell that a vector belongs to; ``home``: its own cell, where it asks."""

    def place(batches):
        for batch in batches:
            vectors = batch.column("v").to_pylist()
            out = []
            for i, v in enumerate(vectors):
                x = np.asarray(v, np.float64)
                x = x / np.abs(x).max()
                p = (x / np.sqrt(x @ x)) @ lines_of_cached(len(x), lines * groups, seed)
                for g in range(groups):
                    q = p[g * lines : g * lines + grid]
                    own = np.floor(q / (4 * half)).astype(int)
                    ranges = [range(int(math.floor((a - half) / (4 * half))), int(math.floor((a + half) / (4 * half))) + 1) for a in q]
                    for cell in product(*ranges):
                        out.append((i, g, ",".join(map(str, cell)), cell == tuple(own)))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("label", "dim", "id", "w", "v")] + [pa.array([o[k] for o in out], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.bool_()))],
                names=["label", "dim", "id", "w", "v", "g", "cell", "home"],
            )

    return group.select("label", "dim", "id", "w", "v").mapInArrow(place, "label string, dim int, id bigint, w bigint, v array<double>, g int, cell string, home boolean")


_LINES: dict = {}


def lines_of_cached(dim: int, count: int, seed: int) -> np.ndarray:
    if (dim, count, seed) not in _LINES:
        _LINES[dim, count, seed] = lines_of(dim, count, seed)
    return _LINES[dim, count, seed]


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each one by links."""
    root = np.arange(nodes)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def links_within(qx: np.ndarray, dx: np.ndarray, same: np.ndarray, lines: np.ndarray, g: int, grid: int, per: int, half: float, least: int, cosine: float):
    """Pairs (query, row) of a tile by counted collisions and then cosine; ``same``: ids of queries and rows to keep apart."""
    qp, dp = qx @ lines, dx @ lines
    first = g * per
    order = np.argsort(dp[:, first], kind="stable")
    line = dp[order, first]
    lo, hi = np.searchsorted(line, qp[:, first] - half, "left"), np.searchsorted(line, qp[:, first] + half, "right")
    found = []
    ends = np.cumsum(hi - lo)
    start = 0
    while start < len(qx):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = (hi - lo)[start:stop]
        q = np.repeat(np.arange(start, stop), n)
        d = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[start:stop], n)]
        missed = np.zeros(len(q), np.int16)
        for k in range(first + 1, first + per):
            missed += np.abs(qp[q, k] - dp[d, k]) > half
            allowed = 0 if k < first + grid else per - least
            keep = missed <= allowed
            q, d, missed = q[keep], d[keep], missed[keep]
        # a pair that an earlier group finds is that group's
        for e in range(g):
            near = np.abs(qp[q, e * per : (e + 1) * per] - dp[d, e * per : (e + 1) * per]) <= half
            mine = ~(near[:, : max(grid, 1)].all(axis=1) & (near.sum(axis=1) >= least))
            q, d = q[mine], d[mine]
        good = (np.einsum("ij,ij->i", qx[q], dx[d]) >= cosine) & (same[0][q] != same[1][d])
        found.append((q[good], d[good]))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    lines: int = LINES, recall: float = RECALL, grid: int | None = None, tile: int = TILE, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link within one label (and one dimension) at a cosine of at least ``cosine``.
    Null, zero and empty vectors, null or non-finite components, a null label and a null id
    link with nothing: no links, the own id as component, kept.  Rows that repeat are
    vectors of their own, linked with their copies.  An empty table gives no rows; other
    columns are not looked at.
    """
    half = REACH * distance(cosine)
    # a null id is a row of its own
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable(F.col("v"), F.col("label"), F.col("vec_id")), F.lit(False)))
    good = rows.filter("ok")
    classes = materialize(good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("dim", F.size("v")))
    if grid is None:
        sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        grid = grid_lines(sizes)
    groups = GROUPS if grid else 1
    least = least_collisions(lines, REACH, recall)
    cells = materialize(_cells(classes, grid, groups, half, lines, seed))
    key = ["label", "dim", "g", "cell"]
    counts = cells.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_if("home").alias("asks")).filter("m > 1 AND asks > 0")
    tiled = cells.join(counts, key).withColumn("tiles", F.ceil(F.col("m") / tile).cast("int"))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    columns = [*key, "id", "w", "v"]
    asked = tiled.filter("home").select(*columns, F.col("own").alias("qt"), F.explode(every).alias("dt"), F.lit(True).alias("asks"))
    given = tiled.select(*columns, F.explode(every).alias("qt"), F.col("own").alias("dt"), F.lit(False).alias("asks"))

    def meet(part: pa.Table) -> pa.Table:
        v = np.array(part.column("v").combine_chunks().flatten()).reshape(part.num_rows, -1)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        ids, weights, asks = (part.column(c).to_numpy() for c in ("id", "w", "asks"))
        g = part.column("g")[0].as_py()
        q, d = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        a, b = links_within(v[q], v[d], (ids[q], ids[d]), lines_of_cached(v.shape[1], lines * groups, seed), g, grid, lines, half, least, cosine)
        names, inverse = np.unique(ids, return_inverse=True)
        links = np.bincount(inverse[q[a]], weights=weights[d[b]].astype(float), minlength=len(names)).astype(np.int64)
        root = names[forest(len(names), inverse[q[a]], inverse[d[b]])]
        keep = (links > 0) | (root != names)
        return pa.table({"id": names[keep], "links": links[keep], "root": root[keep]})

    met = materialize(asked.unionByName(given).groupBy(*key, "qt", "dt").applyInArrow(meet, "id bigint, links bigint, root bigint"))
    joined = components(met.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("label", "v", "id", "w").join(links, "id", "left").join(joined, "id", "left")
    named = named.select("label", "v", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    linked = good.join(named, ["label", "v"]).select("vec_id", (F.col("w") - 1 + F.col("links")).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query()
def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all ``embeddings`` at a cosine of 0.98."""
    return near_duplicates(table(spark, folder, "embeddings"))
