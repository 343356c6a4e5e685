"""Near-duplicate vectors by collision counting on one-dimensional projections.

All vectors are made unit vectors and turned by a random orthonormal basis; its axes are the projections.  Members are
sorted on projection after projection, and a query's window there is the range of ranks within w of its own value.  A pair's
collisions are the windows that the member falls into.  Two unit vectors with cosine c differ by sqrt(2 - 2c) =: d in
all, so those at the limit collide on D - floor(d^2 / w^2) axes for certain, and nearly always on more: the count that
a pair must reach is calibrated by simulation so that (1 - recall) / 2 of the pairs right at the limit stay under
it; closer pairs collide more.  Pairs that reach it are verified in double precision.

So that not all pairs are counted, rows are blocked by the signs of the first K projections, K growing with the
logarithm of the rows: a query looks into the blocks that its window crosses into, that is those whose signs differ
from its own on axes F with sum over F of x_k^2 within a budget.  The budget is calibrated by simulation, too, so that of
pairs right at the limit all but (1 - recall) / 2 are seen from one of the two sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written

#: Rows of a block that meet in one task; larger blocks are cut into parts that meet in pairs.
PART = 4_000
#: Rows on average in a block.
FILL = 256
#: Rows that are dealt to their blocks at a time.
ROWS = 500
#: Projections on which a block is sorted.
SORTED = 12


def basis(size: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _probe_budget(size: int, axes: int, cosine: float, recall: float, pairs: int = 100_000) -> float:
    """What a query may spend on axes of other sign, to find so large a part of the pairs at the limit itself.

    By simulation: of random pairs with that cosine, the smaller one of the two sides' sums; the turn of the axes
    makes any pair a random one.
    """
    rng = np.random.default_rng(9)
    sums, step = [], max(1, 2_000_000 // size)
    for first in range(0, pairs, step):
        n = min(step, pairs - first)
        x, z = rng.standard_normal((2, n, size))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (z * x).sum(axis=1)[:, None] * x
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
        a, b = x[:, :axes], (cosine * x + np.sqrt(1 - cosine**2) * z)[:, :axes]
        differ = (a >= 0) != (b >= 0)
        sums.append(np.minimum((a * a * differ).sum(axis=1), (b * b * differ).sum(axis=1)))
    return float(np.quantile(np.concatenate(sums), recall))


def _cost(x: np.ndarray) -> np.ndarray:
    """Squares as integers, so that their sums don't depend on an order."""
    return np.floor(x * x * (1 << 44)).astype(np.int64)


def _codes(x: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block) of the blocks that each query looks into, its own and those within the budget; and each one's own."""
    n, axes = x.shape
    bit = np.int64(1) << np.arange(axes, dtype=np.int64)
    own = ((x >= 0) * bit).sum(axis=1).astype(np.int64)
    cost = _cost(x)
    order = np.argsort(cost, axis=1, kind="stable")
    row, code, spent = np.arange(n), own.copy(), np.zeros(n, np.int64)
    for j in range(axes):  # with or without the axis that is j-th in cost
        more = spent + cost[row, order[row, j]]
        fits = more <= budget
        row, code, spent = np.concatenate([row, row[fits]]), np.concatenate([code, code[fits] ^ bit[order[row[fits], j]]]), np.concatenate([spent, more[fits]])
    return row, code, own


def _needed(size: int, cosine: float, w: float, recall: float, pairs: int = 100_000) -> int:
    """Collisions that all but (1 - recall) / 2 of the pairs at the limit reach; never under what is certain."""
    rng = np.random.default_rng(10)
    squared, counts, step = 2 - 2 * cosine, [], max(1, 2_000_000 // size)
    for first in range(0, pairs, step):
        z = rng.standard_normal((min(step, pairs - first), size))
        z *= np.sqrt(squared) / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
        counts.append((np.abs(z) <= w).sum(axis=1))
    certain = max(1, size - int(squared / (w * w) + 1e-9))
    return max(certain, int(np.quantile(np.concatenate(counts), (1 - recall) / 2, method="lower")) - 1)


def _collisions(p: np.ndarray, q: np.ndarray, w: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of p, row of q) that collide on at least `need` projections.

    The members q are sorted on the first SORTED projections, where a query's window is a range of ranks found by
    bisection and all pairs are counted; on the others only those that can still reach the count, by their values.
    """
    size = p.shape[1]
    dense = min(size, SORTED)
    rank = np.empty((dense, len(q)), np.uint16)  # PART is under 65536
    low, wide = np.empty((dense, len(p)), np.uint16), np.empty((dense, len(p)), np.uint16)
    for k in range(dense):
        order = np.argsort(q[:, k], kind="stable")
        rank[k, order] = np.arange(len(q), dtype=np.uint16)
        begin, end = np.searchsorted(q[order, k], p[:, k] - w, "left"), np.searchsorted(q[order, k], p[:, k] + w, "right")
        low[k], wide[k] = begin, end - begin
    found_a, found_b = [], []
    allowed = size - need
    for i0 in range(0, len(p), 64):
        i1 = min(len(p), i0 + 64)
        missed = np.zeros((i1 - i0, len(q)), np.uint8)
        for k in range(dense):
            missed += (rank[k][None, :] - low[k, i0:i1, None]) >= wide[k, i0:i1, None]  # below the window wraps round
        a, b = np.nonzero(missed <= allowed)
        left = missed[a, b].astype(np.int32)
        for first in range(dense, size, 9):
            axes = slice(first, min(size, first + 9))
            left += (np.abs(p[i0 + a, axes] - q[b, axes]) > w).sum(axis=1)
            ok = left <= allowed
            a, b, left = a[ok], b[ok], left[ok]
            if not len(a):
                break
        found_a.append(i0 + a)
        found_b.append(b)
    return np.concatenate(found_a or [np.zeros(0, int)]), np.concatenate(found_b or [np.zeros(0, int)])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links within a task, enough to join the same components: each node's smallest neighbour, then what that leaves."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]


def _unit(blobs: list[bytes], kind) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(len(blobs), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _block(w: float, need: int, cosine: float, axes: int, budget: int, kind):
    """Links of the queries of one part with the members of a part of the same block.

    A row is a member of its own block (home) and a query in all its blocks.  Two with one home are counted with the
    smaller vec as the query; two with different homes that look into each other's, too.
    """

    def run(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, home = group.column("vec").to_numpy(), group.column("home").to_numpy()
        ask = group.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        a, b = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(a) or not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unit = _unit(group.column("x").to_pylist(), kind)
        x = unit @ basis(unit.shape[1])
        i, j = _collisions(x[a], x[b], w, need)
        i, j = a[i], b[j]
        close = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[close], j[close]
        differ = (x[i, :axes] >= 0) != (x[j, :axes] >= 0)
        mutual = (_cost(x[j, :axes]) * differ).sum(axis=1) <= budget
        ok = (ids[i] != ids[j]) & ((ids[i] < ids[j]) | ~mutual)
        return ids[i[ok]], ids[j[ok]]

    return run


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns, per row of vectors: id_col (long), n_links (other rows with cosine >= the limit), component_id (smallest
    id that links lead to, its own included) and kept (id_col = component_id).

    Equal vectors are one while pairs are sought; their rows count as linked.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and only vectors of one length link.  A null id is kept: its row counts
    as a link of others, its component_id is the smallest id of its component, else null; kept is then false.
    Repeated rows are rows of their own (they link if the vector is valid).  An empty table gives no rows.
    """
    if not 0.5 < cosine < 1:
        raise ValueError("cosine: between 0.5 and 1")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # a hash of its numbers names a vector; 0.0 is added as -0.0 equals 0.0
    rows = written(base.withColumn("vec", F.when(valid, F.xxhash64(F.transform("v", lambda x: x.cast("double") + 0.0)))).select("id", "vec", F.when(valid, F.col("v")).alias("v")))
    named = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.first("v").alias("v"))
    distinct = written(named)
    sizes = distinct.groupBy(F.size("v").alias("size")).count().collect()  # a row for each length of vector
    links = None
    for size, count in sorted(tuple(r) for r in sizes):
        part = distinct if len(sizes) == 1 else distinct.where(F.size("v") == size)
        some = _links(part, size, count, cosine, recall)
        links = some if links is None else links.unionByName(some)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.coalesce(F.col("id") == F.col("id"), F.lit(False)).alias("kept"))
    links = written(links)
    degree = links.where("kind = 'degree'").groupBy(F.col("a").alias("vec")).agg(F.sum("b").alias("others"))
    parts = connected_components(links.where("kind = 'edge'").select("a", "b"))
    about = distinct.select("vec", "rows", "least").join(degree, "vec", "left").join(parts.withColumnsRenamed({"node": "vec"}), "vec", "left").withColumn("component", F.coalesce("component", "vec"))
    about = written(about)
    least = about.groupBy("component").agg(F.min("least").alias("first"))
    known = about.join(least, "component").select("vec", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("first"))
    out = rows.select("id", "vec").join(known, "vec", "left")
    component = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(distinct: DataFrame, size: int, count: int, cosine: float, recall: float) -> DataFrame:
    """kind, a, b: 'edge' (two vectors; enough of the links to join the components), 'degree' (a vector and the rows
    it is linked with)."""
    squared = 2 - 2 * cosine
    w = 3 * np.sqrt(squared / size)  # three times the deviation of a pair at the limit
    need = _needed(size, cosine, w, recall)
    axes = int(min(size, 20, max(0, np.ceil(np.log2(max(1, count) / FILL)))))
    budget = int(_probe_budget(size, axes, cosine, (1 + recall) / 2) * (1 << 44)) if axes else 0
    kind = np.float32 if dict(distinct.dtypes)["v"] == "array<float>" else np.float64

    def place(batches):
        q = basis(size)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                flat = batch.column("v").flatten().to_numpy().astype(kind).reshape(batch.num_rows, size)
                blobs = [r.tobytes() for r in flat]
                x = _unit(blobs, kind) @ q
                vec, rows = batch.column("vec").to_numpy(), batch.column("rows").to_numpy()
                at, block, own = _codes(x[:, :axes], budget)
                yield pa.RecordBatch.from_arrays([pa.array(vec[at]), pa.array(rows[at]), pa.array(own[at]), pa.array(block), pa.array([blobs[i] for i in at], pa.binary())], names=["vec", "rows", "home", "block", "x"])

    placed = written(distinct.select("vec", "rows", "v").mapInArrow(place, "vec long, rows long, home long, block long, x binary"))
    # parts: blocks with many members or queries are cut, and each part of queries meets each part of members
    load = placed.groupBy("block").agg(F.count("*").alias("asks"), F.sum(F.when(F.col("home") == F.col("block"), 1).otherwise(0)).alias("tells")).where("tells > 0")
    load = load.select("block", F.ceil(F.col("asks") / PART).alias("ask_parts"), F.ceil(F.col("tells") / PART).alias("tell_parts"))
    dealt = placed.join(load, "block")
    spread = lambda seed, n: F.pmod(F.xxhash64("vec", F.lit(seed)), F.col(n))
    asks = dealt.select("*", spread(1, "ask_parts").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tell_parts") - 1)).alias("q"), F.lit(True).alias("ask"))
    tells = dealt.where("home = block").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ask_parts") - 1)).alias("p"), spread(2, "tell_parts").alias("q"), F.lit(False).alias("ask"))
    columns = ["block", "p", "q", "vec", "rows", "home", "x", "ask"]
    pairs = _block(w, need, cosine, axes, budget, kind)

    def meet(group: pa.Table) -> pa.Table:
        a, b = pairs(group)
        weight = dict(zip(group.column("vec").to_pylist(), group.column("rows").to_pylist()))
        kinds, left, right = [], [], []
        if len(a):
            both = np.concatenate([a, b])
            of, place_ = np.unique(both, return_inverse=True)
            add = np.bincount(place_, weights=np.array([weight[x] for x in np.concatenate([b, a]).tolist()], float))
            ea, eb = _forest(a, b)
            kinds = ["degree"] * len(of) + ["edge"] * len(ea)
            left, right = np.concatenate([of, ea]), np.concatenate([add.astype(np.int64), eb])
        return pa.table({"kind": pa.array(kinds, pa.string()), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return asks.select(*columns).unionByName(tells.select(*columns)).groupBy("block", "p", "q").applyInArrow(meet, "kind string, a long, b long")
