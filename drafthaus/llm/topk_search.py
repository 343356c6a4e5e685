"""Exact top-k search by inner product with a Voronoi join.

Pivots cut queries and data into cells.  Of each cell of queries a summary holds their number, their largest distance
u from the pivot and their largest norm; the data of a cell are cut into rings by distance, and of each ring a summary
holds its number and largest distance r.  A query of cell i and a vector of a ring of cell j score between m - s and m + s, with
m = p_i . p_j and s = u_i |p_j| + |q| r_j.  So the k-th score of a cell's queries is at least the k-th largest lower bound,
counting each ring's vectors; solving the ring with the best upper bound first raises that.  Neighbouring cells of
queries form groups, and a ring is replicated only to groups with a cell whose k-th score its upper bound reaches.
Large groups and rings are cut into parts, so a task solves a bounded number of queries against a bounded number of
vectors, by a matrix product of integers (exact in doubles).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the pivots are taken from, and how many pivots there are at most.
PIVOT_SAMPLE, PIVOTS = 4_096, 256
#: Vectors of a ring and queries of a group that meet in a task; larger ones are cut.
PART, QUERIES = 8_000, 1_000
#: A cell has a ring for each so many vectors, RINGS at most.
RING, RINGS = 2_000, 4


def quantised(column, factor: int = 256):
    """floor(factor * x) of each component as an array of longs; null unless all components are finite numbers."""
    x = column.cast("array<double>")
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * factor)))


def _packed(df: DataFrame, schema: str) -> DataFrame:
    """id, v as a binary of 32-bit integers where they fit (else 64-bit, told by its length)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("v")
                flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                kind = np.int64 if len(flat) and np.abs(flat).max() >= 1 << 26 else np.int32
                blobs = [(b"\1" if kind is np.int64 else b"\0") + flat[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at).astype(np.int32)), pa.array(blobs, pa.binary())], names=["id", "size", "x"])

    return df.mapInArrow(run, schema)


def _matrix(blobs) -> np.ndarray:
    """Doubles if all scores are exact in them, else Python integers."""
    rows = [np.frombuffer(b, np.int64 if b[0] else np.int32, offset=1) for b in blobs]
    m = np.stack(rows).astype(np.int64) if rows else np.zeros((0, 0), np.int64)
    return m


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2.0**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return q @ x.T
    raise ValueError("scores beyond 64-bit integers")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties to the smaller id; ids ascend."""
    n = score.shape[1]
    if n <= k:
        r, c = np.nonzero(np.ones_like(score, bool))
        return r, c
    kth = np.partition(score, n - k, axis=1)[:, n - k]
    r, c = np.nonzero(score >= kth[:, None])
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """For each row of queries the k rows of data with the largest inner product, but for its own id.

    Both have id_col (long) and vector_col; components count as floor(factor * x).  Returns query_id, rank (from 1),
    vec_id and score (long): all others if there are fewer than k; ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part; vectors
    meet those of their own length only.  Rows of data with one id and vector count once, as one candidate; a
    repeated query is answered once.  If an id has several vectors, each is a candidate and a query of its own, and
    a query's best k rows may then name an id twice.  Empty tables give no rows.
    """
    spark = data.sparkSession

    def prepared(df):
        clean = df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), factor).alias("v")).where("id is not null and v is not null")
        return written(_packed(clean, "id long, size int, x binary").distinct())

    asked, told = prepared(queries), prepared(data)
    sizes = sorted(r[0] for r in told.groupBy("size").count().collect())
    out = None
    for size in sizes:
        some = _top_k(spark, asked.where(F.col("size") == size), told.where(F.col("size") == size), k)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_k(spark, asked: DataFrame, told: DataFrame, k: int) -> DataFrame:
    count = told.count()
    # pivots: the first rows by a hash of the id, of a bounded sample the ones farthest from those before
    sample = _matrix([bytes(r[0]) for r in told.orderBy(F.xxhash64("id", "x"), "id").limit(PIVOT_SAMPLE).select("x").collect()]).astype(np.float64)
    n = int(min(PIVOTS, max(1, np.sqrt(count) / 4), len(sample)))
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(n - 1):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    pivots = sample[sorted(set(chosen))]

    def cells(batches):
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x").to_pylist()).astype(np.float64)
                cell = (x @ pivots.T - half).argmax(axis=1)
                r = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(r), pa.array(np.sqrt((x**2).sum(axis=1)))], names=["id", "x", "cell", "r", "norm"])

    placed, asking = (written(df.select("id", "x").mapInArrow(cells, "id long, x binary, cell int, r double, norm double")) for df in (told, asked))
    # all that comes to the driver from here on has a row per cell or ring at most, that is PIVOTS * RINGS
    steps = F.array(*(F.lit((i + 1) / RINGS) for i in range(RINGS - 1)))
    cuts = placed.groupBy("cell").agg(F.when(F.count("*") >= RING * RINGS, F.percentile_approx("r", steps, F.lit(1000))).otherwise(F.array().cast("array<double>")).alias("cuts"))
    cuts = written(cuts)
    ringed = placed.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts", "norm")
    rings = sorted(tuple(r) for r in ringed.groupBy("cell", "ring").agg(F.count("*"), F.max("r")).collect())
    about = sorted(tuple(r) for r in asking.groupBy("cell").agg(F.count("*"), F.max("r"), F.max("norm")).collect())
    if not rings or not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d_cell, d_ring, d_n, d_r = (np.array([x[i] for x in rings]) for i in range(4))
    q_cell, q_n, q_u, q_norm = (np.array([x[i] for x in about]) for i in range(4))
    norm = np.sqrt((pivots[d_cell] ** 2).sum(axis=1))
    middle, slack = pivots[q_cell] @ pivots[d_cell].T, (q_u[:, None] * norm + q_norm[:, None] * d_r) * (1 + 1e-12) + 1e-6
    low, high = middle - slack, middle + slack
    order = np.argsort(-low, axis=1)
    enough = np.cumsum(d_n[order], axis=1) >= k + 1  # the query itself may be one of them
    bound = np.where(enough.any(axis=1), np.take_along_axis(low, np.take_along_axis(order, enough.argmax(axis=1)[:, None], 1), 1)[:, 0], -np.inf)

    # groups of neighbouring cells: each next one is the nearest that is left
    chain, left = [0], set(range(1, len(q_cell)))
    while left:
        near = min(left, key=lambda c: (float(((pivots[q_cell[c]] - pivots[q_cell[chain[-1]]]) ** 2).sum()), c))
        chain.append(near)
        left.remove(near)
    group, sizes = np.zeros(len(q_cell), int), [0]
    for c in chain:
        if sizes[-1] and sizes[-1] + q_n[c] > QUERIES:
            sizes.append(0)
        group[c] = len(sizes) - 1
        sizes[-1] += int(q_n[c])
    groups = spark.createDataFrame([(int(c), int(g), -(-sizes[g] // QUERIES)) for c, g in zip(q_cell, group)], "cell int, grp int, grp_parts int")
    askers = asking.join(F.broadcast(groups), "cell").select("grp", F.pmod(F.xxhash64("id", F.lit(4)), F.col("grp_parts")).alias("grp_part"), "id", "x")

    def per_group(wanted: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), len(d_cell)), bool)
        np.logical_or.at(out, group, wanted)
        return out

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = _matrix(right.column("x").to_pylist())[order], ids[order]
            asked_ids = left.column("id").to_numpy()
            for a in range(0, len(asked_ids), QUERIES):
                own = asked_ids[a : a + QUERIES]
                score = _scores(_matrix(left.column("x").slice(a, QUERIES).to_pylist()), x)
                score[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
                r, c = _best(score, ids, k)
                real = score[r, c] != np.iinfo(np.int64).min
                out_q.append(own[r[real]]), out_v.append(ids[c[real]]), out_s.append(score[r[real], c[real]])
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(join(out_q)), "vec_id": pa.array(join(out_v)), "score": pa.array(join(out_s))})

    keys = ["grp", "grp_part", "cell", "ring", "part"]

    def solved(routes: np.ndarray) -> DataFrame:
        """Rings replicated to the groups that want them (grp, ring: True), solved task by task."""
        pairs = [(int(g), -(-sizes[g] // QUERIES), int(d_cell[j]), int(d_ring[j]), int(-(-d_n[j] // PART))) for g, j in zip(*np.nonzero(routes))]
        route = F.broadcast(spark.createDataFrame(pairs, "grp int, grp_parts int, cell int, ring int, parts int"))  # at most PIVOTS * PIVOTS * RINGS rows
        to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        queries = askers.join(route, "grp").select("id", "x", "grp", "grp_part", "cell", "ring", to("parts").alias("part"))
        data = ringed.join(route, ["cell", "ring"]).select("id", "x", "grp", to("grp_parts").alias("grp_part"), "cell", "ring", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).alias("part"))
        return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")

    order = np.argsort(-high, axis=1)
    seeds = np.zeros(high.shape, bool)
    np.put_along_axis(seeds, order, np.cumsum(d_n[order], axis=1) - d_n[order] < k + 1, axis=1)
    seeds = per_group(seeds)
    first = written(solved(seeds))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    floors = asking.select("id", "cell").join(kth, "id", "left").groupBy("cell").agg(F.min(F.coalesce("score", F.lit(-(2**63))))).collect()
    floor = dict(tuple(r) for r in floors)
    bound = np.maximum(bound, [float(floor[c]) for c in q_cell.tolist()])
    rest = per_group(high >= bound[:, None]) & ~seeds
    every = first.unionByName(solved(rest)) if rest.any() else first
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
