"""Curation of labelled image sets, and what surrounds a run: reports, prompts and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.columns import ISSUE, iou, is_error, lookup, strip
from ..operators.lineage import listed
from ..operators.spatial import greedy_match


def dedup_content(images: DataFrame, splits=("train", "valid", "test")) -> DataFrame:
    """images: split, name, content.  Of equal contents the first by split and name stays."""
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    w = Window.partitionBy(F.md5("content")).orderBy(rank, "name")
    return images.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("digest", F.md5("content"))


def split_sizes(n, train: float = 0.8, valid: float = 0.1):
    """(train, valid): at least one to train, one to valid from three on, and one left to test if possible."""
    t = F.greatest(F.lit(1), F.floor(n * train))
    v = F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * valid))).otherwise(F.floor(n * valid))
    t2 = F.when((n - t - v < 1) & (n >= 3), F.greatest(F.lit(1), n - v - 1)).otherwise(t)
    return t2, v


def assign_splits(images: DataFrame, key: str = "digest", seed: str = "42", buckets: int = 1024) -> DataFrame:
    """Splits of exact sizes in the order of a seeded digest, whatever the partitions.

    The order is one over all images; it is found by counting rows per range of the digest, so no task sorts them all.
    """
    d = images.withColumn("_o", F.md5(F.concat(F.col(key), F.lit(seed)).cast("binary"))).withColumn("_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy("_b").agg(F.count("*").alias("_c"))  # at most 4096 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("_c").alias("_n"))
    d = d.join(F.broadcast(before.drop("_c")), "_b").crossJoin(F.broadcast(total))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_o"))
    t, v = split_sizes(F.col("_n"))
    return d.withColumn("_p", place).withColumn("split", F.when(F.col("_p") <= t, "train").when(F.col("_p") <= t + v, "valid").otherwise("test")).drop("_o", "_b", "_before", "_n", "_p")


def leaked(images: DataFrame, key: str = "digest") -> DataFrame:
    return images.groupBy(key).agg(F.countDistinct("split").alias("splits"), F.count("*").alias("copies")).where("splits > 1")


def canonical_classes(classes: DataFrame) -> DataFrame:
    """classes: id, name.  Adds canonical and new_id, in the order in which canonical names first occur."""
    same = {m: g[0] for g in dims.SAME_CLASS for m in g}
    name = F.coalesce(lookup(same, F.col("name")), F.col("name"))
    c = classes.withColumn("canonical", F.coalesce(lookup(dims.MISSPELT, name), name))
    first = c.groupBy("canonical").agg(F.min("id").alias("_first")).withColumn("new_id", F.row_number().over(Window.orderBy("_first")) - 1)  # a list of classes
    return c.join(listed(first.drop("_first")), "canonical")


def merged_classes(base: DataFrame, extra: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Names of base, then of extra that base lacks, without those dropped, numbered anew."""
    u = base.select("name", F.lit(0).alias("o"), "id").union(extra.select("name", F.lit(1), "id")).where(~F.col("name").isin(*drop) if drop else F.lit(True))
    first = u.groupBy("name").agg(F.min(F.struct("o", "id")).alias("f"))
    return first.withColumn("new_id", F.row_number().over(Window.orderBy("f")) - 1).select("new_id", "name")  # a list of classes


def remap_labels(labels: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Class ids by name; labels whose class is gone are dropped."""
    m = old.select(F.col("id").alias("cid"), "name").join(new.select("name", "new_id"), "name").select("cid", "new_id")
    return labels.join(listed(m), "cid").drop("cid").withColumnRenamed("new_id", "cid")


def class_compatibility(model: DataFrame, data: DataFrame) -> DataFrame:
    """verdict: identical, order or vocabulary; names that only one side has."""
    names = lambda d: d.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("x")).select(F.transform("x", lambda s: s["name"]).alias("x"))
    j = names(model).select(F.col("x").alias("a")).crossJoin(names(data).select(F.col("x").alias("b")))
    only = lambda p, q: F.array_join(F.slice(F.array_sort(F.array_except(p, q)), 1, 10), ",")
    verdict = F.when(F.col("a") == F.col("b"), "identical").when(F.array_sort("a") == F.array_sort("b"), "order").otherwise("vocabulary")
    return j.select(verdict.alias("verdict"), only("a", "b").alias("only_in_model"), only("b", "a").alias("only_in_dataset"))


def class_instances(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Label rows per class; ids outside the list count under ''."""
    return labels.join(listed(classes.select(F.col("id").alias("cid"), "name")), "cid", "left").groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("instances"))


def f1(metrics: DataFrame) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return metrics.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def box_matches(truth: DataFrame, found: DataFrame, keys, threshold: float = 0.5, cell: float = 256.0) -> DataFrame:
    """keys, truth_ord, det_ord, iou: which found box is which true one; the best overlaps first (ties by truth_ord, det_ord),
    each box once.

    truth has truth_ord, found det_ord, both x1, y1, x2, y2.  From an IoU of 0.5 on, the centre of one box lies in the
    other, so a true box is given to the cells that it covers, a found one to that of its centre, and a pair meets once.
    Boxes without area or with a null match nothing; an empty table gives no rows.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold: 0.5 to 1")
    at = lambda x: F.floor(x / cell)
    box = F.struct("x1", "y1", "x2", "y2")
    whole = F.col("x1").isNotNull() & F.col("y1").isNotNull() & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    left = truth.where(whole).select(*keys, "truth_ord", box.alias("t"), F.explode(F.sequence(at(F.col("x1")), at(F.col("x2")))).alias("cx"))
    left = left.select("*", F.explode(F.sequence(at(F.col("t.y1")), at(F.col("t.y2")))).alias("cy"))
    right = found.where(whole).select(*keys, "det_ord", box.alias("d"), at((F.col("x1") + F.col("x2")) / 2).alias("cx"), at((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    pairs = left.join(right, [*keys, "cx", "cy"]).withColumn("iou", iou(F.col("t"), F.col("d"))).where(F.col("iou") >= threshold)
    return greedy_match(pairs.withColumn("dist", -F.col("iou")), keys, "truth_ord", "det_ord", most=1).select(*keys, "truth_ord", "det_ord", (-F.col("dist")).alias("iou"))


def detection_scores(truth: DataFrame, found: DataFrame, matches: DataFrame, keys) -> DataFrame:
    """keys, truths, found, matched, precision, recall; a share of nothing is 0."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    j = count(truth, "truths").join(count(found, "found"), keys, "full").join(count(matches, "matched"), keys, "left").fillna(0, ["truths", "found", "matched"])
    share = lambda n: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col(n).cast("double")), F.lit(0.0))
    return j.select(*keys, "truths", "found", "matched", share("found").alias("precision"), share("truths").alias("recall"))


def label_rows(lines: DataFrame, classes: int) -> DataFrame:
    """lines: image, value.  Rows of five tokens whose class is in the list."""
    t = lines.withColumn("t", F.split(strip(F.col("value")), r"\s+")).where(F.size("t") == 5)
    v = t.select("image", F.col("t")[0].try_cast("int").alias("cid"), *[F.col("t")[i + 1].try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return v.where((F.col("cid") >= 0) & (F.col("cid") < classes))


def report_issues(reports: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Issues of numbered reports: a numbered line begins one, other lines go on, text before the first is one."""
    lines = reports.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).withColumn("line", strip(F.col("line"))).where("line != ''")
    w = Window.partitionBy(id_col).orderBy("at")
    n = lines.withColumn("issue", F.sum(F.when(F.rlike("line", F.lit(ISSUE)) | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    out = n.groupBy(id_col, "issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("text"))
    return out.withColumn("error", is_error(F.col("text")))


def report_passed(reports: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    i = report_issues(reports, id_col, text_col).groupBy(id_col).agg((~F.bool_or("error")).alias("p"))
    return reports.select(id_col).join(i, id_col, "left").select(id_col, F.coalesce("p", F.lit(True)).alias("passed"))


def expired_jobs(jobs: DataFrame, now, hours: float = 24.0) -> DataFrame:
    return jobs.where(F.col("created_at") < F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(hours * 3600)))


def first_per_type(e: DataFrame, n: int = 10) -> DataFrame:
    """The first n entities of each type for a prompt, and how many more there are."""
    w = Window.partitionBy("doc_id", "entity_type")
    return e.withColumns({"place": F.row_number().over(w.orderBy("node_ord")), "more": F.greatest(F.lit(0), F.count("*").over(w) - n)}).where(F.col("place") <= n)


def labelled_images(images: DataFrame, lines: DataFrame, classes: int) -> DataFrame:
    """images: image (one row each).  Adds rows, its label rows as an array; an image without a label file has none."""
    rows = label_rows(lines, classes).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("cid", "cx", "cy", "w", "h"))).alias("rows"))  # of one image
    return images.join(rows, "image", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<cid:int,cx:double,cy:double,w:double,h:double>>")))


def repeated_extra(images: DataFrame, times: int) -> DataFrame:
    """images (split, name) of an extra set, each `times` times, once at least, under a new name."""
    rep = F.explode(F.sequence(F.lit(0), F.lit(max(1, times) - 1)))
    return images.withColumn("rep", rep).withColumn("name", F.concat(F.lit("target"), F.col("rep").cast("string"), F.lit("_split"), "split", F.lit("_"), "name"))


def ranked_classes(metrics: DataFrame, names: DataFrame, n: int = 15) -> DataFrame:
    """metrics: id, precision; names: id, name.  status: 'worst' and 'best' (n each, by rank), 'zero', 'never'."""
    m = metrics.join(listed(names), "id", "left")
    rank = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  a list of classes
    worst = m.withColumn("rank", rank("precision", "id")).where(F.col("rank") <= n).select(F.lit("worst").alias("status"), "rank", "id", "name")
    best = m.withColumn("rank", rank(F.desc("precision"), F.desc("id"))).where(F.col("rank") <= n).select(F.lit("best"), "rank", "id", "name")
    none = F.lit(None).cast("int")
    zero = m.where("precision = 0").select(F.lit("zero"), none, "id", "name")
    never = names.join(metrics.select("id"), "id", "left_anti").select(F.lit("never"), none, "id", "name")
    return worst.union(best).union(zero).union(never)


def prompt_summary(e: DataFrame, n: int = 10) -> DataFrame:
    """The entities of a document as text for a prompt: types in order of first occurrence, n lines each."""
    first = first_per_type(e, n).withColumn("begun", F.min("node_ord").over(Window.partitionBy("doc_id", "entity_type")))
    score = F.format_number("confidence", 2)  # half-even on the binary value
    line = F.format_string("  - %s: %s (confidence: %s)", F.coalesce("tag_id", F.lit("None")), "description", score)
    kept = first.groupBy("doc_id", "entity_type", "begun", "more").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"), F.count("*").alias("n"))
    head = F.format_string("\n### %s (%d items)\n", F.replace(F.initcap(F.replace("entity_type", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_")), F.col("n") + F.col("more"))
    tail = F.when(F.col("more") > 0, F.format_string("\n  ... and %d more", "more")).otherwise("")
    part = F.struct("begun", F.concat(head, "lines", tail).alias("t"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("text"))


def prompt_issues(found: DataFrame, n: int = 15) -> DataFrame:
    """The first n findings of a document as numbered lines."""
    w = Window.partitionBy("doc_id")
    k = found.withColumns({"k": F.row_number().over(w.orderBy("rule_id", "entity_id", "message")), "all": F.count("*").over(w)}).where(F.col("k") <= n)
    line = F.concat(F.col("k").cast("string"), F.lit(". ["), F.upper("severity"), F.lit("] "), "message")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n")
    more = F.max("all") - n
    return k.groupBy("doc_id").agg(F.concat(text, F.when(more > 0, F.concat(F.lit("\n... and "), more.cast("string"), F.lit(" more issues"))).otherwise("")).alias("text"))


# The report of a run without a language model.
FALLBACK = """# {title}

## Overall Assessment
**LLM validation did not run** — showing rule-based results only.{reason}

## Rule-Based Findings
- **Errors:** {errors}
- **Warnings:** {warnings}
- **Total issues:** {total}

## Recommendations
1. Review entities flagged with low confidence scores
2. Verify duplicate tags and orphan nodes manually
3. Check the LLM validation configuration if AI validation was expected

*This report contains deterministic rule findings only. The LLM review did not run.*
"""


def fallback_report(documents: DataFrame, found: DataFrame, reason: str = "", title: str = "Validation Report") -> DataFrame:
    """documents: doc_id.  The report of each from rule findings alone: errors, warnings, total, passed, degraded, text."""
    n = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("total"))
    j = documents.select("doc_id").distinct().join(n, "doc_id", "left").fillna(0, ["errors", "warnings", "total"])
    text = F.lit(FALLBACK.replace("{title}", title).replace("{reason}", f"\n\n**Reason:** {reason}" if reason else ""))
    for c in ("errors", "warnings", "total"):
        text = F.replace(text, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return j.select("doc_id", "errors", "warnings", "total", (F.col("errors") == 0).alias("passed"), F.lit(True).alias("degraded"), text.alias("text"))
