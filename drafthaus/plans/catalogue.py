"""The queries of the engine over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.lineage import cut
from ..operators.spatial import sequential_reject
from ..sources import sinks
from ..sources.bridge import CLASSES, views
from ..streaming import jobs
from . import curation as K
from . import drawing as D

NOW = datetime.datetime(2024, 1, 15)
OLD_CLASSES = ["Back Pressure Regulator", "BackPressure Regulator", "bolier", "Boiler", "Gate_Valve", "Gate Valve", "Level Trasmitter", "Reformer", "reformer", "Ball_valve", "Ball Valve", "Pump", "Tee", "Elbow", "Cap", "Drum", "Fan", "Motor"]


def _classes(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "id bigint, name string")


def _q(f):
    return lambda spark, sf_dir: f(views(spark, sf_dir), spark)


def _entities(v):
    return D.entities(v["symbols"], v["texts"])


def _lined(v):
    e = _entities(v)
    nodes = e.withColumn("line_number", F.lit(None).cast("string"))
    labels = D.tags(v["texts"]).where("tag.tag_type = 'line_number'").select("doc_id", "page", F.col("text_ord").alias("label_ord"), F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("tag.tag_id").alias("line"))
    return cut(D.assign_lines(nodes, labels))


def _graph(v):
    e = cut(_entities(v))
    return e, cut(D.edges(e))


def _tag_parse(v, spark):
    return D.tags(v["texts"]).select("doc_id", "page", "text_ord", *[F.col(f"tag.{f}").alias(f) for f in C.TAG_FIELDS])


def _splits(v, spark):
    kept = K.dedup_content(v["images"])
    return K.assign_splits(kept.drop("split")).groupBy("split").agg(F.count("*").alias("n"))


def _tiles(v):
    return D.tile_grid(v["sheets"])


def _merged_tiles(v, spark):
    t = _tiles(v)
    i = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")
    d = t.select("sheet", "row", "col", i).withColumn("a", F.when(F.col("i") < 4, F.col("i") * 433 - 3).otherwise(F.col("i") * 3 - 11).cast("double"))  # the last four around the tolerance
    d = d.select("sheet", "row", "col", F.col("i").alias("det_ord"), F.col("a").alias("x1"), (F.col("i") * 217.0).alias("y1"), (F.col("a") + 63).alias("x2"), (F.col("i") * 217.0 + 40).alias("y2"))
    return D.merge_tiles(d, t, ["sheet", "row", "col"])


def _crossings(v, spark):
    a = v["symbols"].select("doc_id", "page", "det_ord", "cx", "cy")
    nxt = a.select("doc_id", "page", (F.col("det_ord") - 1).alias("det_ord"), F.col("cx").alias("qx"), F.col("cy").alias("qy"))
    runs = a.join(nxt, ["doc_id", "page", "det_ord"]).select("doc_id", "page", F.col("det_ord").alias("run"), F.col("cx").alias("px"), F.col("cy").alias("py"), "qx", "qy")
    boxes = v["symbols"].select("doc_id", "page", F.col("det_ord").alias("other"), "x1", "y1", "x2", "y2")
    hit = runs.join(boxes, ["doc_id", "page"]).where((F.col("other") != F.col("run")) & (F.col("other") != F.col("run") + 1) & C.run_crosses_box(*[F.col(c) for c in ("px", "py", "qx", "qy", "x1", "y1", "x2", "y2")]))
    return runs.join(hit.select("doc_id", "page", "run"), ["doc_id", "page", "run"], "left_anti").select("doc_id", "page", "run")


def _f1(v, spark):
    m = v["boxes"].groupBy("cid").agg((F.count(F.when(F.col("ord") % 4 != 0, 1)) / F.count("*")).alias("precision"), (F.count(F.when(F.col("ord") % 5 != 0, 1)) / F.count("*")).alias("recall"))
    return K.f1(m)


def _coverage(v, spark):
    c = _classes(spark, CLASSES + OLD_CLASSES).withColumn("category", C.classify_symbol(F.col("name")))
    other = F.count(F.when(F.col("category") == "other", 1))
    g = c.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("category") == "other", F.col("name")))), ",").alias("unmapped"))
    whole = c.agg(F.count("*").alias("total"), F.bround((F.count("*") - other) / F.count("*") * 100, 1).alias("coverage"))  # one row
    return g.crossJoin(F.broadcast(whole))


TAXONOMY = [("Gate Valve", "equipment"), ("ball valve", "instruments"), ("Panel Note", "piping"), ("UNKNOWN-THING", "valves"), ("Tee", "other")]


def _class_map(v, spark):
    names = _classes(spark, CLASSES + OLD_CLASSES).select("name").distinct()
    return C.with_category(names, "name", spark.createDataFrame(TAXONOMY, "name string, category string")).withColumn("key", C.class_key(F.col("name")))


def _strengthened(v, spark):
    """In the order of resolving: the graph is built before lines are known, so a shared line halves a weight once."""
    nodes = _lined(v)
    ed = D.strengthen_lines(D.edges(_entities(v)), nodes).where("line_number is not null")
    return ed.select("doc_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight", "line_number")


def _labelled(v, spark):
    images = spark.range(60).select(F.col("id").alias("image"))
    return K.labelled_images(images, v["label_lines"], 18).select("image", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["cid"]).alias("ids"))


def _ranked(v, spark):
    m = v["boxes"].where("cid < 15").groupBy(F.col("cid").alias("id")).agg((F.count(F.when(F.col("ord") % 4 != 0, 1)) / F.count("*")).alias("precision"))
    return K.ranked_classes(m, _classes(spark, OLD_CLASSES), 3).withColumn("rank", F.col("rank").cast("long"))


def _moved(v):
    """The boxes as truth, and as found with up to 12 px between."""
    by = (F.col("det_ord") % 7) * 2
    found = v["dense"].withColumns({"x1": F.col("x1") + by, "x2": F.col("x2") + by})
    return v["dense"].withColumnRenamed("det_ord", "truth_ord"), found


def _scores(v, spark):
    truth, found = _moved(v)
    return K.detection_scores(truth, found, K.box_matches(truth, found, D.PAGE), D.PAGE)


def _nms_order(v, spark):
    d = v["dense"].withColumn("class_name", F.concat(F.lit("c"), (F.col("det_ord") % 3).cast("string")))
    return D.class_order(D.suppress(d)).select("doc_id", "page", "det_ord", F.col("place").cast("long").alias("place"))


def _table(df, *names):
    return df.select("doc_id", *names)


QUERIES = {
    "tag_parse": _q(_tag_parse),
    "tag_type_counts": _q(lambda v, s: D.tags(v["texts"]).groupBy(F.col("tag.tag_type").alias("tag_type")).agg(F.count("*").alias("n"))),
    "ocr_text_valid": _q(lambda v, s: v["texts"].select("doc_id", "page", "text_ord", C.valid_text(F.col("text")).alias("valid"))),
    "symbol_classify": _q(lambda v, s: v["symbols"].select("class_name").distinct().select("class_name", C.classify_symbol(F.col("class_name")).alias("category"), C.entity_type(C.classify_symbol(F.col("class_name"))).alias("entity_type"))),
    "class_coverage": _q(_coverage),
    "blob_filter": _q(lambda v, s: D.blobs_of_text(v["blobs"]).select("doc_id", "page", "blob_ord")),
    "word_groups": _q(lambda v, s: D.word_groups(D.blobs_of_text(v["blobs"]))),
    "fragment_merge": _q(lambda v, s: D.merge_fragments(v["words"]).select("doc_id", "page", "island", "text", "x1", "y1", "x2", "y2")),
    "ocr_dedup": _q(lambda v, s: D.clean_words(v["words"]).select("doc_id", "page", "text_ord")),
    "covered_words": _q(lambda v, s: D.covered_words(v["words"].withColumns({c: F.col(c).cast("bigint") for c in ("x1", "y1", "x2", "y2")}).where("x2 > x1 and y2 > y1"), v["blobs"].select("doc_id", "page", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")))),
    "tile_grid": _q(lambda v, s: _tiles(v).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "x", "y", "cut_left", "cut_top", "cut_right", "cut_bottom")),
    "tile_merge_clip_cut": _q(lambda v, s: _merged_tiles(v, s).select("sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("det_ord").cast("long").alias("det_ord"), "x1", "y1", "x2", "y2")),
    "nms": _q(lambda v, s: D.suppress(v["dense"]).select("doc_id", "page", "det_ord", F.col("rank").cast("long").alias("rank"))),
    "detection_summary": _q(lambda v, s: D.detection_summary(v["symbols"])),
    "label_candidates": _q(lambda v, s: D.label_pairs(v["symbols"], v["texts"]).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.max("dist").alias("far"))),
    "label_assignment": _q(lambda v, s: D.assign_labels(v["symbols"], v["texts"]).select("doc_id", "page", "det_ord", "text_ord", "dist", F.col("place").cast("long").alias("place"))),
    "unassigned_text": _q(lambda v, s: v["texts"].join(D.assign_labels(v["symbols"], v["texts"]), ["doc_id", "page", "text_ord"], "left_anti").select("doc_id", "page", "text_ord")),
    "entities": _q(lambda v, s: _entities(v).select("doc_id", "page", "entity_id", "tag_id", "entity_type", "category", "description", "size", "specification", "confidence", "needs_review")),
    "entity_table": _q(lambda v, s: D.entity_table(_entities(v))),
    "entity_json": _q(lambda v, s: D.entity_json(_entities(v))),
    "confidence_stats": _q(lambda v, s: D.confidence_stats(_entities(v))),
    "edges": _q(lambda v, s: _graph(v)[1].select("doc_id", "page", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "distance", "weight", "connection_type")),
    "degree": _q(lambda v, s: D.degrees(*_graph(v)).select("doc_id", "entity_id", "degree")),
    "neighbors": _q(lambda v, s: D.neighbours(_graph(v)[1]).groupBy("doc_id", F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"), F.min("other").cast("long").alias("first"))),
    "two_hops": _q(lambda v, s: D.two_hops(_graph(v)[1]).groupBy("doc_id", F.col("node").cast("long").alias("node")).agg(F.count("*").alias("n"))),
    "line_assignment": _q(lambda v, s: _lined(v).select("doc_id", F.col("node_ord").cast("long").alias("node_ord"), "line_number")),
    "flow_order": _q(lambda v, s: D.flow_order(_lined(v)).select("doc_id", F.col("node_ord").cast("long").alias("node_ord"), "line_number", F.col("flow_order").cast("long").alias("flow_order"))),
    "line_strengthen": _q(_strengthened),
    "instrument_loops": _q(lambda v, s: D.instrument_loops(_entities(v)).select("doc_id", "loop", F.col("node_ord").cast("long").alias("node_ord"), F.col("place").cast("long").alias("place"))),
    "loop_edges": _q(lambda v, s: D.loop_edges(*_graph(v)).select("doc_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")),
    "components": _q(lambda v, s: D.graph_components(*_graph(v)).select("doc_id", F.col("node").cast("long").alias("node"), F.col("component").cast("long").alias("component"))),
    "graph_summary": _q(lambda v, s: D.graph_summary(*_graph(v))),
    "rule_issues": _q(lambda v, s: D.issues(*_graph(v))),
    "rule_summary": _q(lambda v, s: (lambda e, g: D.rule_summary(e, D.issues(e, g)))(*_graph(v))),
    "mto_rows": _q(lambda v, s: D.mto_rows(_entities(v))),
    "mto_numbered": _q(lambda v, s: D.numbered(D.mto_rows(_entities(v))).select("doc_id", F.col("item_no").cast("long").alias("item_no"), "category", "description", "size", "specification", "quantity")),
    "mto_category_totals": _q(lambda v, s: D.category_totals(_entities(v))),
    "prompt_topk": _q(lambda v, s: K.first_per_type(_entities(v)).select("doc_id", "entity_type", "entity_id", F.col("more").cast("long").alias("more"))),
    "cell_sanitize_slug": _q(lambda v, s: v["texts"].select("text").distinct().select("text", C.cell_text(F.col("text")).alias("cell"), C.slug(F.col("text")).alias("slug"))),
    "content_dedup": _q(lambda v, s: K.dedup_content(v["images"]).select("split", "name", "digest")),
    "split_sizes": _q(_splits),
    "split_leakage": _q(lambda v, s: K.leaked(v["images"].withColumn("digest", F.md5("content")))),
    "class_canonical": _q(lambda v, s: K.canonical_classes(_classes(s, OLD_CLASSES)).select("id", "name", "canonical", F.col("new_id").cast("long").alias("new_id"))),
    "class_merge": _q(lambda v, s: K.merged_classes(_classes(s, CLASSES), _classes(s, OLD_CLASSES), ["Tee"]).select(F.col("new_id").cast("long").alias("new_id"), "name")),
    "label_remap": _q(lambda v, s: K.remap_labels(v["boxes"], _classes(s, OLD_CLASSES), K.merged_classes(_classes(s, CLASSES), _classes(s, OLD_CLASSES), ["Tee"])).select("image", "ord", F.col("cid").cast("long").alias("cid"))),
    "class_compat": _q(lambda v, s: K.class_compatibility(_classes(s, CLASSES), _classes(s, OLD_CLASSES))),
    "class_instances": _q(lambda v, s: K.class_instances(v["boxes"], _classes(s, OLD_CLASSES)).withColumn("rare", F.col("instances") < 20)),
    "eval_f1": _q(_f1),
    "shape_classify": _q(lambda v, s: v["symbols"].select("doc_id", "page", "det_ord", C.shape_class(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("shape"))),
    "annotate_reject": _q(lambda v, s: sequential_reject(v["dense"].drop("confidence"), D.PAGE, [F.col("det_ord")]).select("doc_id", "page", "det_ord")),
    "pipe_crossings": _q(_crossings),
    "issue_lines": _q(lambda v, s: K.report_issues(v["reports"]).select("id", F.col("issue").cast("long").alias("issue"), "text", "error")),
    "issue_verdict": _q(lambda v, s: K.report_passed(v["reports"])),
    "jobs_expired": _q(lambda v, s: K.expired_jobs(v["jobs"], NOW).select("id", "status")),
    "class_map": _q(_class_map),
    "sheet_scales": _q(lambda v, s: v["sheets"].select("sheet", C.ocr_scale(F.col("width"), F.col("height")).alias("ocr"), C.display_scale(F.col("width"), F.col("height")).alias("display"), C.debug_scale(F.col("width")).alias("debug"))),
    "ocr_rescale": _q(lambda v, s: D.rescaled_words(v["words"], F.lit(2.0)).select("doc_id", "page", "text_ord", "x1", "y1", "x2", "y2", "cx", "cy")),
    "entity_filters": _q(lambda v, s: D.entities_of(_entities(v), "instrument", "instruments").select("doc_id", F.col("node_ord").cast("long").alias("node_ord"))),
    "annotator_components": _q(lambda v, s: D.annotator_components(v["blobs"]).select("doc_id", "page", "blob_ord")),
    "tall_symbols": _q(lambda v, s: D.tall_symbols(v["blobs"].withColumn("h", F.col("h") * 3)).select("doc_id", "page", "blob_ord")),
    "circle_class": _q(lambda v, s: v["blobs"].select("doc_id", "page", "blob_ord", C.circle_class(F.col("w"), F.col("h"), F.col("area") / (F.col("w") * F.col("h"))).alias("class"))),
    "confident_detections": _q(lambda v, s: D.confident(v["words"]).select("doc_id", "page", "text_ord")),
    "box_properties": _q(lambda v, s: D.box_properties(v["symbols"]).select("doc_id", "page", "det_ord", "width", "height", "area")),
    "best_reading": _q(lambda v, s: D.best_reading(v["words"].select("doc_id", "page", F.floor(F.col("text_ord") / 3).alias("crop"), F.col("text_ord").alias("ord"), "text", "confidence"), ["doc_id", "page", "crop"])),
    "page_counts": _q(lambda v, s: D.page_counts(v["symbols"], v["texts"], _entities(v))),
    "run_summary": _q(lambda v, s: (lambda e, g: D.run_summary(D.page_counts(v["symbols"], v["texts"], e), e, g))(*_graph(v))),
    "mean_confidence": _q(lambda v, s: D.mean_confidence(_entities(v)).select("doc_id", "entity_id", F.round("mean_confidence", 6).alias("mean_confidence"))),
    "loop_functions": _q(lambda v, s: D.loop_functions(_entities(v))),
    "node_loops": _q(lambda v, s: D.node_loops(_entities(v)).select("doc_id", F.col("node_ord").cast("long").alias("node_ord"), "instrument_loop")),
    "highlighted_nodes": _q(lambda v, s: D.highlighted(_graph(v)[1], F.col("connection_type") == "signal").select("doc_id", F.col("node").cast("long").alias("node"))),
    "fallback_report": _q(lambda v, s: (lambda e, g: K.fallback_report(e, D.issues(e, g)))(*_graph(v)).select("doc_id", "errors", "warnings", "total", "passed")),
    "prompt_issues": _q(lambda v, s: K.prompt_issues(D.issues(*_graph(v)))),
    "prompt_summary": _q(lambda v, s: K.prompt_summary(_entities(v))),
    "ranked_classes": _q(_ranked),
    "extra_repeat": _q(lambda v, s: K.repeated_extra(v["images"], 3).select("image", F.col("rep").cast("long").alias("rep"), "name")),
    "labelled_images": _q(_labelled),
    "upload_names": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.upload_name(F.col("url")).alias("name")),
    "upload_check": _q(lambda v, s: v["uploads"].select("doc_id", C.upload_problem(F.concat(F.lit("f."), "kind"), F.col("content").cast("binary"), 4000).alias("problem"))),
    "shape_scaled": _q(lambda v, s: v["symbols"].select("doc_id", "page", "det_ord", C.shape_class(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 1300.0).alias("shape"))),
    "graph_view": _q(lambda v, s: sinks.graph_view(_entities(v))),
    "graph_json": _q(lambda v, s: sinks.graph_json(*_graph(v))),
    "nms_order": _q(_nms_order),
    "box_matches": _q(lambda v, s: K.box_matches(*_moved(v), D.PAGE).select("doc_id", "page", "truth_ord", "det_ord", F.round("iou", 9).alias("iou"))),
    "detection_scores": _q(_scores),
    "job_windows": _q(lambda v, s: jobs.job_counts(v["jobs"]).select(F.col("window.start").alias("since"), "status", "n")),
    "mto_layout": _q(lambda v, s: D.sheet_layout(D.numbered(D.mto_rows(_entities(v)))).select("doc_id", F.col("item_no").cast("long").alias("item_no"), F.col("sheet_row").cast("long").alias("sheet_row"), "fill")),
    "yolo_lines": _q(lambda v, s: sinks.yolo_lines(v["symbols"].select(F.col("page").alias("image"), F.col("det_ord").alias("ord"), F.lit(7).alias("cid"), "x1", "y1", "x2", "y2"), F.lit(2048.0), F.lit(1024.0))),
}
