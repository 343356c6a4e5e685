"""Joins by distance, groups along a line, greedy choices, and graphs of pages.

Every operator works within keys (a document and page), so that a page is the largest thing one task holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import boxes_overlap, distance, iou
from .lineage import cut


def range_join(a: DataFrame, b: DataFrame, radius: float, keys: Sequence[str], ax="x", ay="y", bx="x", by="y") -> DataFrame:
    """Pairs of rows of a and b with equal keys whose points are at most radius apart, with dist.

    A grid join: points of b are in one cell, those of a look into the 9 around theirs.  The columns of b other than
    the keys must not clash with those of a.  Null points have no partner.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.where(F.col(ax).isNotNull() & F.col(ay).isNotNull()).withColumn("_n", near).withColumns({"_cx": cell(ax) + F.col("_n.i"), "_cy": cell(ay) + F.col("_n.j")}).drop("_n")
    right = b.withColumns({"_cx": cell(bx), "_cy": cell(by)})
    joined = left.join(right, [*keys, "_cx", "_cy"]).withColumn("dist", distance(F.col(ax), F.col(ay), F.col(bx), F.col(by)))
    return joined.where(F.col("dist") <= radius).drop("_cx", "_cy")


def gaps_and_islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], joins: Column, previous: Sequence[str], out: str = "island") -> DataFrame:
    """Numbers the islands of each key from 0: a row whose condition `joins` holds belongs to the island of the row
    before.  previous: columns that the condition sees of that row, as prev_<name>."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in previous})
    new = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w) - 1).drop("_new", *[f"prev_{c}" for c in previous])


def _fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str], clashes) -> DataFrame:
    """Rows in order; one stays unless it clashes with one that stayed before.  Within the JVM, a page at a time."""
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in fields])
    ordered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda e: F.lit(False))
    kept = F.aggregate("items", none, lambda kept, e: F.when(F.exists(kept, lambda k: clashes(k, e)), kept).otherwise(F.array_append(kept, e)))
    out = ordered.select(*keys, F.posexplode(kept).alias("rank", "k"))
    return out.select(*keys, "rank", *[F.col(f"k.{c}").alias(c) for c in fields])


def greedy_nms(boxes: DataFrame, keys: Sequence[str], ordinal: str, threshold: float = 0.45) -> DataFrame:
    """Boxes in order of confidence (ties by ordinal), without those whose IoU with one kept is over the threshold."""
    fields = [c for c in boxes.columns if c not in keys]
    return _fold(boxes, keys, [-F.col("confidence"), F.col(ordinal)], fields, lambda k, e: iou(k, e) > threshold)


def sequential_reject(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Boxes in order, without those that overlap one taken before; touching isn't overlapping."""
    return _fold(boxes, keys, order, [c for c in boxes.columns if c not in keys], boxes_overlap)


def greedy_match(pairs: DataFrame, keys: Sequence[str], left: str, right: str, dist: str = "dist", most: int = 3) -> DataFrame:
    """Which right belongs to which left, nearest pairs first (ties by left, right).

    First pass: each left and each right once.  Second pass: rights without a left go to one with fewer than `most`.
    Returns keys, left, right, dist and place: the label's place among those of its left, by (dist, right).
    """
    item = F.struct(F.col(dist).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    ordered = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("c"))
    none = F.filter("c", lambda e: F.lit(False))
    once = F.aggregate("c", none, lambda m, e: F.when(F.exists(m, lambda k: (k["l"] == e["l"]) | (k["r"] == e["r"])), m).otherwise(F.array_append(m, e)))
    first = ordered.select(*keys, "c", once.alias("m1"))
    more = F.aggregate("c", F.col("m1"), lambda m, e: F.when(F.exists(m, lambda k: k["r"] == e["r"]) | (F.size(F.filter(m, lambda k: k["l"] == e["l"])) >= most), m).otherwise(F.array_append(m, e)))
    out = first.select(*keys, F.explode(more).alias("m")).select(*keys, F.col("m.l").alias(left), F.col("m.r").alias(right), F.col("m.d").alias(dist))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys, left).orderBy(dist, right)))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """keys, node, component: the smallest node that can be reached, whatever the edges' direction.

    Each round takes the smallest label of the neighbours and then the label of that label, so that chains halve; each
    is cut off with checkpoint().
    """
    both = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v"))
    both = cut(both.union(edges.select(*keys, F.col(dst).alias("u"), F.col(src).alias("v"))).distinct())
    labels = cut(nodes.select(*keys, F.col(node).alias("u"), F.col(node).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("u", "v"), [*keys, "v"]).groupBy(*keys, "u").agg(F.min("label").alias("near"))
        step = labels.join(around, [*keys, "u"], "left").select(*keys, "u", F.least("label", F.coalesce("near", "label")).alias("new"), "label")
        jump = step.select(*keys, F.col("u").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, [*keys, "new"], "left").select(*keys, "u", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        if not step.where("new < label").limit(1).count():
            return step.select(*keys, F.col("u").alias(node), F.col("new").alias("component"))
        labels = step.select(*keys, "u", F.col("new").alias("label"))


def _pieces(group: pa.Table) -> pa.Table:
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in zip(group.column("u").to_pylist(), group.column("v").to_pylist()):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    found = list(up)
    first = group.slice(0, 1).combine_chunks()
    keys = {c: pa.concat_arrays([first.column(c).chunk(0)] * len(found)) for c in group.column_names if c not in ("u", "v")}
    return pa.table(keys | {"u": pa.array(found, pa.int64()), "v": pa.array([root(x) for x in found], pa.int64())})


def local_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """As components, for edges that never leave a key: each key (a page) is solved by one task, in one pass."""
    pairs = nodes.select(*keys, F.col(node).cast("long").alias("u"), F.col(node).cast("long").alias("v")).union(edges.select(*keys, F.col(src).cast("long"), F.col(dst).cast("long")))
    return pairs.groupBy(*keys).applyInArrow(_pieces, pairs.schema).withColumnsRenamed({"u": node, "v": "component"})
