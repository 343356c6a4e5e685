"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, written

#: Rows of one source that one task pairs; a larger source is cut into parts of about this size.
PART = 100_000
#: Residuals that one step of the reduction combines.
FAN = 1_000


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """number: 0, 1, ... in code-point order of the column, null last, without bringing all rows to one task."""
    spread = written(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    starts, total = [], 0
    for part, rows in sorted(tuple(r) for r in spread.groupBy("_part").count().collect()):  # a row per partition
        starts += [F.lit(part), F.lit(total)]
        total += rows
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last()))
    return spread.withColumn("number", start + place - 1).drop("_part")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size (one row each).  Adds target.

    The weights repeat over the sources in code-point order, null last.  The targets share share * all sizes by
    weight; a target stops at most * its source's size, and the excess is shared again until none is above.  Each
    round is one aggregation of exact integers, so reruns agree to the last bit.
    """
    numbered = written(_numbered(sizes, "source").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    held, level = -1, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
        full, words, free = numbered.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if full == held or not free:
            break
        held, level = full, (share * total - most * (words or 0)) / free
    over = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
    return numbered.select("source", "source_size", F.when(over, F.col("source_size") * F.lit(most)).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _pivotal(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Pairs each unit with the one that is still open: words move from one to the other, at random to either side, until
    one is taken or out.  The odds keep each unit's chance on average, and the words (chance * size) stay the same in
    every pair.  Returns which were taken, and the open one with its chance."""
    taken = np.zeros(len(chance), np.int8)
    held, p, a = -1, 0.0, 1
    for i, (q, b) in enumerate(zip(chance.tolist(), np.maximum(size, 1).tolist())):
        if q <= 0.0 or q >= 1.0:
            taken[i] = q >= 1.0
            continue
        if held < 0:
            held, p, a = i, q, b
            continue
        gains, loses = min((1.0 - p) * a, q * b), min(p * a, (1.0 - q) * b)  # words that the held unit can get or give
        if draw[i] * (gains + loses) < loses:
            full, empty = gains == (1.0 - p) * a, gains == q * b
            p, q = p + gains / a, q - gains / b
        else:
            full, empty = loses == p * a, loses == (1.0 - q) * b
            p, q = p - loses / a, q + loses / b
        if full:
            taken[held] = p > 0.5
        if empty:
            taken[i] = q > 0.5
        if full:
            held, p, a = (-1, 0.0, 1) if empty else (i, q, b)
    return taken, held, p


def _duels(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # by size from above: what is left open of a large unit is settled by all smaller ones
        rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        draw = np.random.default_rng([seed, int(rows["part"].iat[0]) + 1, len(rows), int(rows["row"].iat[0]) & 0x7FFFFFFF]).random(len(rows))
        taken, held, p = _pivotal(rows["chance"].to_numpy(), rows["size"].to_numpy(), draw)
        out = rows[["source", "row", "size"]].assign(part=rows["part"], level=rows["level"] + 1, chance=taken.astype(float))
        if held >= 0:
            out.loc[held, "chance"] = p
        return out

    return run


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: copies, so that each source's words come near its target.

    Returns one row per row of docs: id_col, source, text_key (a hash of the text), size (words of the text), source_size,
    target (its source's, a double) and copies (0, 1, .. ceil(most)).  target / source_size copies are due of each document: the whole part
    is taken, the fraction is rounded by pivotal sampling: two open documents meet, words move from one to the other
    until one is taken or out, so only the last open document keeps a source from its target.  A source's documents are dealt into parts, and what is left open in each part
    (one document) goes through a reduction tree, so no task holds a source.  Draws depend on seed and ids alone.

    A null text has size 0; texts of size 0 are taken as any others (they add no words).  A null source is a source,
    the last one.  A source without words has the target 0 and no copies.  Rows with equal id, source and text count
    together: their whole part of the chances is taken, the rest rounded.  An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("key")).withColumn("row", F.xxhash64("id", "source", "key"))
    rows = written(rows)
    units = rows.groupBy("source", "row", "size").agg(F.count("*").alias("rows"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = written(source_targets(totals.select("source", "source_size"), weights, share, most))
    biggest = max(1, (totals.agg(F.max("n")).first()[0] or 0) // PART + 1)

    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(targets, units["source"].eqNullSafe(targets["source"])).select(units["source"], "row", "size", "rows", due.alias("due"))
    units = units.withColumn("all", (F.col("due") - F.floor("due")) * F.col("rows")).withColumn("sure", F.floor("all")).withColumn("chance", F.col("all") - F.col("sure"))
    units = written(units)
    schema = "source string, row long, size long, part long, level int, chance double"
    level, parts = 0, biggest
    open_ = units.where("chance > 0").select("source", "row", "size", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).alias("part"), F.lit(0).alias("level"), "chance")
    closed = []
    while True:
        done = written(open_.groupBy("source", "part").applyInPandas(_duels(seed + level), schema))
        closed.append(done.where("chance = 0 or chance = 1"))
        left = done.where("chance > 0 and chance < 1")
        if parts == 1:
            break
        parts, level = (parts + FAN - 1) // FAN, level + 1
        open_ = left.withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed + level)), F.lit(parts)))
    # the last open document of each source goes to the nearer side
    closed.append(left.withColumn("chance", F.when(F.col("chance") >= 0.5, 1.0).otherwise(0.0)))
    rounded = closed[0]
    for x in closed[1:]:
        rounded = rounded.unionByName(x)
    extra = units.join(rounded.select("row", F.col("chance").alias("won")), "row", "left").select(F.col("row"), F.floor("due").alias("whole"), (F.col("sure") + F.coalesce("won", F.lit(0.0))).cast("int").alias("extra"))
    # of rows that are alike, the first "extra" ones get one more
    nth = F.row_number().over(Window.partitionBy("row").orderBy("size"))
    out = rows.withColumn("nth", nth).join(extra, "row").join(targets, rows["source"].eqNullSafe(targets["source"]))
    return out.select(F.col("id").alias(id_col), rows["source"], F.col("key").alias("text_key"), "size", "source_size", "target", (F.col("whole") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources says, with the columns of docs, whatever their names.

    Rows alike in id, source and text are one group, which has all copies of the group, as its first row is.  Null ids,
    texts and sources are values of their own; an empty table gives none.
    """
    key, copies, rows, nth = free(docs, "key", "copies", "rows", "nth")
    take = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(F.col(id_col).alias("id"), F.col("source"), F.col("text_key").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    take = take.alias("_t")
    one = docs.withColumn(key, F.xxhash64(text_col)).alias("_d")
    same = (F.col(f"_d.{key}") == F.col("_t.key")) & F.col(f"_d.{id_col}").eqNullSafe(F.col("_t.id")) & F.col(f"_d.{source_col}").eqNullSafe(F.col("_t.source"))
    joined = one.join(take, same).select("_d.*", F.col("_t.copies").alias(copies), F.col("_t.rows").alias(rows))
    first = F.row_number().over(Window.partitionBy(id_col, key, source_col).orderBy(key))
    repeated = joined.where(F.col(rows) > 1).withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    both = joined.where(F.col(rows) == 1).unionByName(repeated)
    return both.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
