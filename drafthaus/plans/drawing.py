"""From detected symbols and recognised text to entities, graph, findings and the bill of quantities.

Tables are keyed by doc_id (a set of sheets) and page.  Order is part of the data: det_ord, text_ord and node_ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..config import SETTINGS
from ..functions.columns import axis_starts, confidence, entity_type, normalised_tag, parse_normalised, pretty_type, valid_text, with_category
from ..operators.lineage import cut
from ..operators.spatial import components, gaps_and_islands, greedy_match, greedy_nms, local_components, range_join

PAGE = ["doc_id", "page"]
TAGGED = ["instrument_tag", "equipment_tag"]


# --- tiles and detections ---


def tile_grid(pages: DataFrame, tile: int = SETTINGS.tile, overlap: int = SETTINGS.overlap) -> DataFrame:
    """pages: keys, width, height.  A row per tile: row, col, x, y, size and which sides are cut inside the page."""
    t = pages.withColumns({"xs": axis_starts(F.col("width"), tile, overlap), "ys": axis_starts(F.col("height"), tile, overlap)})
    t = t.select("*", F.posexplode("ys").alias("row", "y")).select("*", F.posexplode("xs").alias("col", "x"))
    t = t.withColumns({"tile_width": F.least(F.lit(tile), F.col("width") - F.col("x")), "tile_height": F.least(F.lit(tile), F.col("height") - F.col("y"))})
    cut = {"cut_left": F.col("x") > 0, "cut_top": F.col("y") > 0, "cut_right": F.col("x") + F.col("tile_width") < F.col("width"), "cut_bottom": F.col("y") + F.col("tile_height") < F.col("height")}
    return t.withColumns(cut).drop("xs", "ys")


def merge_tiles(detections: DataFrame, tiles: DataFrame, on: list[str], drop_cut: bool = True, edge: float = SETTINGS.tile_edge) -> DataFrame:
    """Boxes moved to the page, clipped to it; empty ones go, and those that a cut inside the page slices.

    Both sides are shuffled: Spark's estimate counts pages, not the tiles they are cut into, and would broadcast these."""
    d = detections.join(tiles.hint("merge").select(*on, F.col("x").alias("tx"), F.col("y").alias("ty"), "tile_width", "tile_height", "width", "height", "cut_left", "cut_top", "cut_right", "cut_bottom"), on)
    clip = lambda c, o, most: F.greatest(F.lit(0.0), F.least(F.col(c) + F.col(o), F.col(most).cast("double")))
    d = d.withColumns({"x1": clip("x1", "tx", "width"), "y1": clip("y1", "ty", "height"), "x2": clip("x2", "tx", "width"), "y2": clip("y2", "ty", "height")}).where("x2 > x1 and y2 > y1")
    cut = (F.col("cut_left") & (F.col("x1") - F.col("tx") <= edge)) | (F.col("cut_top") & (F.col("y1") - F.col("ty") <= edge)) | (F.col("cut_right") & (F.col("tx") + F.col("tile_width") - F.col("x2") <= edge)) | (F.col("cut_bottom") & (F.col("ty") + F.col("tile_height") - F.col("y2") <= edge))
    d = d.where(~cut) if drop_cut else d
    return d.drop("tx", "ty", "tile_width", "tile_height", "width", "height", "cut_left", "cut_top", "cut_right", "cut_bottom")


def suppress(detections: DataFrame, keys=PAGE, ordinal: str = "det_ord", threshold: float = SETTINGS.iou) -> DataFrame:
    """Class-agnostic suppression.  A second pass per class could remove nothing more, as survivors are all apart."""
    return greedy_nms(detections, keys, ordinal, threshold)


def detection_summary(detections: DataFrame) -> DataFrame:
    """Per class how many and how sure, the most frequent first (rank), ties in order of first occurrence."""
    g = detections.groupBy("class_name").agg(F.count("*").alias("n"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"), F.min(F.struct(*[c for c in ("doc_id", "page", "det_ord") if c in detections.columns])).alias("first"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")  # a list of classes


def confident(detections: DataFrame, least: float = SETTINGS.detection_confidence) -> DataFrame:
    return detections.where(F.col("confidence") >= least)


def box_properties(boxes: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.withColumns({"width": w, "height": h, "area": w * h, "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def class_order(kept: DataFrame, keys=PAGE) -> DataFrame:
    """Suppressed boxes (rank) in the order of the class-aware pass: by confidence, ties by the class that comes first."""
    first = F.min("rank").over(Window.partitionBy(*keys, "class_name"))
    return kept.withColumn("_f", first).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "_f", "rank"))).drop("_f")


def annotator_components(blobs: DataFrame) -> DataFrame:
    """blobs: w, h, area.  Those that can be symbols: no runs of pipe, no text."""
    return blobs.where("w >= 8 and h >= 8 and area >= 30 and h / w between 0.12 and 9 and not (h < 12 and w > 22)")


def tall_symbols(blobs: DataFrame) -> DataFrame:
    return blobs.where("h >= 60 and w <= 60 and area >= 200 and h / greatest(1, w) >= 2")


def best_reading(readings: DataFrame, keys) -> DataFrame:
    """Of several readings of one crop (ord, text, confidence) the surest, ties to the first."""
    return readings.groupBy(*keys).agg(F.max(F.struct("confidence", -F.col("ord"), "text"))["text"].alias("text"), F.max("confidence").alias("confidence"))


def rescaled_words(words: DataFrame, scale: Column) -> DataFrame:
    """Words of an enlarged sheet in the sheet's own coordinates, with their centres."""
    w = words.withColumns({c: F.col(c) / scale for c in ("x1", "y1", "x2", "y2")})
    return w.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


# --- recognised text ---


def blobs_of_text(blobs: DataFrame) -> DataFrame:
    """blobs: x, y, w, h, area.  Those that can be letters."""
    return blobs.where("h between 12 and 130 and w between 5 and 700 and area >= 30").where("w / h between 0.15 and 12 and area / (w * h) between 0.08 and 0.90")


def word_groups(blobs: DataFrame, keys=PAGE, ordinal: str = "blob_ord", pad: int = 4) -> DataFrame:
    """Boxes of words: blobs from left to right; one joins the one before if it's near and on its line."""
    both = F.least(F.col("y") + F.col("h"), F.col("prev_y") + F.col("prev_h")) - F.greatest("y", "prev_y")
    near = F.col("x") - (F.col("prev_x") + F.col("prev_w")) <= (F.col("h") + F.col("prev_h")) / 2 * 1.8
    joins = near & (both >= F.least("h", "prev_h") * 0.4)
    g = gaps_and_islands(blobs, keys, ["x", ordinal], joins, ["x", "y", "w", "h"]).groupBy(*keys, "island")
    return g.agg(F.count("*").alias("blobs"), F.greatest(F.lit(0), F.min("x") - pad).alias("x"), F.greatest(F.lit(0), F.min("y") - pad).alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x") + 2 * pad).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y") + 2 * pad).alias("h"))


def merge_fragments(texts: DataFrame, keys=PAGE, ordinal: str = "text_ord") -> DataFrame:
    """Fragments of one label put together: from left to right while the gap is small and the line is the same."""
    t = texts.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "h": F.col("y2") - F.col("y1")})
    mean = (F.col("h") + F.col("prev_h")) / 2
    joins = (F.col("x1") - F.col("prev_x2") < mean * 2.5) & (F.abs(F.col("cy") - F.col("prev_cy")) < mean * 0.7)
    g = gaps_and_islands(t, keys, ["cx", ordinal], joins, ["x2", "cy", "h"]).groupBy(*keys, "island")
    parts = F.array_sort(F.collect_list(F.struct("cx", ordinal, "text")))
    return g.agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.avg("confidence").alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def covered_words(words: DataFrame, boxes: DataFrame, keys=PAGE, word: str = "text_ord", share: float = 25 / 255, cell: int = 64) -> DataFrame:
    """Words of which the union of the boxes covers the share: boxes cut to the word, the union summed by strips.

    Integer coordinates; words meet boxes in the cells of a grid.  Each word has the strips between the box edges that cross it; a strip's cover is the length
    of merged intervals."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    w = words.select(*keys, word, *[F.col(c).alias(f"w{c}") for c in ("x1", "y1", "x2", "y2")]).withColumn("i", cells("wx1", "wx2")).withColumn("j", cells("wy1", "wy2"))
    b = boxes.select(*keys, "x1", "y1", "x2", "y2").where("x2 > x1 and y2 > y1").withColumn("i", cells("x1", "x2")).withColumn("j", cells("y1", "y2"))
    meet = w.join(b, [*keys, "i", "j"]).where("x1 < wx2 and wx1 < x2 and y1 < wy2 and wy1 < y2")
    cut = meet.where((F.col("i") == F.floor(F.greatest("x1", "wx1") / cell)) & (F.col("j") == F.floor(F.greatest("y1", "wy1") / cell)))  # in the first cell that both are in
    cut = cut.select(*keys, word, "wx1", "wy1", "wx2", "wy2", F.greatest("x1", "wx1").alias("a"), F.least("x2", "wx2").alias("b"), F.greatest("y1", "wy1").alias("c"), F.least("y2", "wy2").alias("d"))
    # strips between the edges that cross a word; in each, the boxes that span it are merged
    edges_ = cut.select(*keys, word, F.explode(F.array("c", "d")).alias("from")).distinct()
    strips = edges_.withColumn("to", F.lead("from").over(Window.partitionBy(*keys, word).orderBy("from"))).where("to is not null")
    rows = cut.join(strips, [*keys, word]).where("c <= from and to <= d")
    per = Window.partitionBy(*keys, word, "from").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("reach", F.max("b").over(per)).withColumn("add", F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("reach", "a"))) * (F.col("to") - F.col("from")))
    cover = rows.groupBy(*keys, word, "wx1", "wy1", "wx2", "wy2").agg(F.sum("add").alias("cover"))
    return cover.where(F.col("cover") >= share * (F.col("wx2") - F.col("wx1")) * (F.col("wy2") - F.col("wy1"))).select(*keys, word, "cover")


def clean_words(words: DataFrame, keys=PAGE, ordinal: str = "text_ord", least: float = SETTINGS.ocr_confidence) -> DataFrame:
    """Words worth keeping, the first of those with one text (whatever its case) in a cell of 10 by 10."""
    good = words.where((F.col("confidence") >= least) & (F.col("x2") - F.col("x1") >= 3) & (F.col("y2") - F.col("y1") >= 3) & valid_text(F.col("text")))
    w = Window.partitionBy(*keys, F.lower("text"), ((F.col("x1") + F.col("x2")) / 20).cast("bigint"), ((F.col("y1") + F.col("y2")) / 20).cast("bigint")).orderBy(ordinal)
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tags(texts: DataFrame) -> DataFrame:
    """texts with the parsed tag; each different text is put right and parsed once."""
    once = texts.select("text").distinct().withColumn("_t", normalised_tag(F.col("text")))
    once = cut(once.withColumn("tag", parse_normalised(F.col("_t"))).drop("_t"))
    return texts.join(once.withColumnRenamed("text", "_text"), F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")


# --- entities ---


def label_pairs(symbols: DataFrame, texts: DataFrame, radius: float = SETTINGS.label_distance) -> DataFrame:
    a = symbols.select(*PAGE, "det_ord", "cx", "cy")
    b = texts.select(*PAGE, "text_ord", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    return range_join(a, b, radius, PAGE, "cx", "cy", "tx", "ty").select(*PAGE, "det_ord", "text_ord", "dist")


def assign_labels(symbols: DataFrame, texts: DataFrame, radius: float = SETTINGS.label_distance, most: int = SETTINGS.labels_per_symbol) -> DataFrame:
    return greedy_match(label_pairs(symbols, texts, radius), PAGE, "det_ord", "text_ord", "dist", most)


def entities(symbols: DataFrame, texts: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """One row per symbol and per tag text that belongs to none.

    symbols: doc_id, page, det_ord, class_name, confidence, cx, cy; texts: doc_id, page, text_ord, text, confidence,
    cx, cy.  The first instrument or equipment tag among a symbol's labels names it and decides its type; the first
    size and the first specification are its own; line numbers give neither.
    """
    parsed = tags(texts).select(*PAGE, "text_ord", F.col("confidence").alias("ocr"), "cx", "cy", "tag")
    given = cut(assign_labels(symbols, texts))
    labels = given.join(parsed.drop("cx", "cy"), [*PAGE, "text_ord"])
    first = lambda value, when: F.min(F.when(when, F.struct("place", value.alias("v"))))["v"]
    kind = F.col("tag.tag_type")
    label = F.struct("place", "text_ord", "tag")
    per = labels.groupBy(*PAGE, "det_ord").agg(
        first(F.col("tag"), kind.isin(TAGGED)).alias("named"), first(F.col("tag.pipe_size"), kind == "pipe_size").alias("size"), first(F.col("tag.pipe_spec"), kind == "specification").alias("specification"),
        F.avg("ocr").alias("ocr"), F.count("*").alias("texts"), F.array_sort(F.collect_list(label)).alias("labels"),
    )
    s = with_category(symbols, "class_name", taxonomy).join(per, [*PAGE, "det_ord"], "left")
    named = F.col("named.tag_type")
    category = F.when(named == "equipment_tag", dims.EQUIPMENT).when(named == "instrument_tag", dims.INSTRUMENTS).otherwise(F.col("category"))
    rows = s.select(
        *PAGE, F.lit(0).alias("kind"), F.col("det_ord").alias("ord"), F.col("named.tag_id").alias("tag_id"), entity_type(category).alias("entity_type"), category.alias("category"),
        F.coalesce(F.col("named.parsed_description"), F.col("class_name")).alias("description"), "size", "specification", F.col("cx").alias("x"), F.col("cy").alias("y"),
        F.col("confidence").alias("det_confidence"), F.col("ocr").alias("ocr_confidence"), F.coalesce("texts", F.lit(0)).alias("texts"), F.transform("labels", lambda x: x["tag"]).alias("tags"),
    )
    alone = parsed.where(F.col("tag.tag_type").isin(TAGGED)).join(given.select(*PAGE, "text_ord"), [*PAGE, "text_ord"], "left_anti")
    other = F.when(F.col("tag.tag_type") == "instrument_tag", dims.INSTRUMENTS).otherwise(dims.EQUIPMENT)
    texts_ = alone.select(
        *PAGE, F.lit(1).alias("kind"), F.col("text_ord").alias("ord"), F.col("tag.tag_id").alias("tag_id"), entity_type(other).alias("entity_type"), other.alias("category"), F.col("tag.parsed_description").alias("description"),
        F.col("tag.pipe_size").alias("size"), F.col("tag.pipe_spec").alias("specification"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(None).cast("double").alias("det_confidence"), F.col("ocr").alias("ocr_confidence"),
        F.lit(1).cast("long").alias("texts"), F.array("tag").alias("tags"),
    )
    every = rows.unionByName(texts_)
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "kind", "ord"))
    name = F.concat(F.lit("E"), F.when(F.length(F.col("node_ord").cast("string")) < 4, F.lpad(F.col("node_ord").cast("string"), 4, "0")).otherwise(F.col("node_ord").cast("string")))
    score = confidence(F.col("det_confidence"), F.col("ocr_confidence"), F.col("tag_id").isNotNull(), F.col("texts") > 0)
    return every.withColumn("node_ord", ordinal).withColumns({"entity_id": name, "confidence": score, "needs_review": score < SETTINGS.review})


def entity_json(e: DataFrame) -> DataFrame:
    view = F.struct("entity_id", "tag_id", "entity_type", "description", F.col("category").alias("component_category"), "size", "specification", F.bround("confidence", 4).alias("confidence"), F.col("texts").alias("text_count"))
    return e.select("doc_id", "entity_id", F.to_json(view).alias("json"))


def entity_table(e: DataFrame) -> DataFrame:
    dash = lambda c: F.coalesce(F.col(c), F.lit("—"))
    title = lambda c: F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))
    return e.select("doc_id", "entity_id", dash("tag_id").alias("tag_id"), title("entity_type").alias("type"), title("category").alias("category"), dash("description").alias("description"), F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("confidence"))


# --- graph ---


def edges(e: DataFrame, radius: float = SETTINGS.edge_distance, per_page: bool = True) -> DataFrame:
    """Proximity edges from left to right.  Aligned ones weigh less, and those whose ends share a line half."""
    keys = PAGE if per_page else ["doc_id"]
    cols = [*keys, "node_ord", "x", "y", "entity_type"] + (["line_number"] if "line_number" in e.columns else [])
    a = e.select(*cols)
    b = a.withColumnsRenamed({c: f"b_{c}" for c in cols if c not in keys})
    p = range_join(a, b, radius, keys, "x", "y", "b_x", "b_y").where("node_ord < b_node_ord")
    align = F.when(F.abs(F.col("y") - F.col("b_y")) < SETTINGS.aligned, 1.5).when(F.abs(F.col("x") - F.col("b_x")) < SETTINGS.aligned, 1.3).otherwise(1.0)
    signal = ((F.col("entity_type") == "instrument") | (F.col("b_entity_type") == "instrument")) & (F.col("dist") < SETTINGS.signal_distance)
    same = (F.col("line_number") == F.col("b_line_number")) if "line_number" in e.columns else F.lit(False)
    weight = F.col("dist") / align * F.when(F.coalesce(same, F.lit(False)), 0.5).otherwise(1.0)
    right = F.col("x") <= F.col("b_x")
    line = F.when(same, F.col("line_number")) if "line_number" in e.columns else F.lit(None).cast("string")
    return p.select(*keys, F.when(right, F.col("node_ord")).otherwise(F.col("b_node_ord")).alias("src"), F.when(right, F.col("b_node_ord")).otherwise(F.col("node_ord")).alias("dst"), F.bround("dist", 2).alias("distance"), F.bround(weight, 2).alias("weight"), F.when(signal, "signal").otherwise("piping").alias("connection_type"), line.alias("line_number"))


def degrees(e: DataFrame, ed: DataFrame) -> DataFrame:
    ends = ed.select("doc_id", F.col("src").alias("node_ord")).union(ed.select("doc_id", "dst"))
    return e.join(ends.groupBy("doc_id", "node_ord").agg(F.count("*").alias("degree")), ["doc_id", "node_ord"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def neighbours(ed: DataFrame) -> DataFrame:
    """node, other, direction: first those before a node, then those after it."""
    return ed.select("doc_id", F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("direction")).union(ed.select("doc_id", "src", "dst", F.lit("out")))


def two_hops(ed: DataFrame) -> DataFrame:
    n = neighbours(ed).select("doc_id", "node", "other").distinct()
    far = n.join(n.select("doc_id", F.col("node").alias("other"), F.col("other").alias("far")), ["doc_id", "other"]).where("far != node").select("doc_id", "node", F.col("far").alias("other"))
    return n.union(far).distinct()


def assign_lines(nodes: DataFrame, labels: DataFrame, radius: float = SETTINGS.line_distance) -> DataFrame:
    """Nodes without a line get that of the nearest label (under radius; ties to the first label).  labels: keys,
    label_ord, lx, ly, line."""
    free = nodes.where("line_number is null").select(*PAGE, "node_ord", "x", "y")
    near = range_join(free, labels, radius, PAGE, "x", "y", "lx", "ly").where(F.col("dist") < radius)
    best = near.groupBy(*PAGE, "node_ord").agg(F.min(F.struct("dist", "label_ord", "line"))["line"].alias("nearest"))
    return nodes.join(best, [*PAGE, "node_ord"], "left").withColumn("line_number", F.coalesce("line_number", "nearest")).drop("nearest")


def strengthen_lines(ed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are on one line weigh half and carry it."""
    n = nodes.select("doc_id", "node_ord", F.nullif("line_number", F.lit("")).alias("line"))
    j = ed.drop("line_number").join(n.withColumnsRenamed({"node_ord": "src", "line": "a"}), ["doc_id", "src"], "left").join(n.withColumnsRenamed({"node_ord": "dst", "line": "b"}), ["doc_id", "dst"], "left")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return j.withColumn("weight", F.when(same, F.col("weight") * 0.5).otherwise(F.col("weight"))).withColumn("line_number", F.when(same, F.col("a"))).drop("a", "b")


def flow_order(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id", "line_number").orderBy("x", "node_ord")
    return nodes.where("line_number is not null").withColumn("flow_order", F.row_number().over(w) - 1)


def loop_members(e: DataFrame) -> DataFrame:
    """doc_id, loop, node_ord, place: instruments by the loop numbers of all their tags."""
    m = e.where("entity_type = 'instrument'").select("doc_id", "node_ord", F.explode("tags").alias("t")).select("doc_id", F.col("t.loop_number").alias("loop"), "node_ord").where("loop is not null")
    return m


def instrument_loops(e: DataFrame) -> DataFrame:
    """Loops of two or more instruments; place is a member's place in its loop."""
    m = loop_members(e).distinct().withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "loop"))).where("size > 1")
    return m.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "loop").orderBy("node_ord")))


def node_loops(e: DataFrame) -> DataFrame:
    """The loop that a node ends up with: of several, the one that comes last in order of first membership, of those
    that begin at one node the largest number."""
    m = instrument_loops(e)
    begun = m.groupBy("doc_id", "loop").agg(F.min("node_ord").alias("begun"))
    last = F.max(F.struct("begun", F.col("loop").try_cast("long").alias("number"), "loop"))["loop"]
    return m.join(begun, ["doc_id", "loop"]).groupBy("doc_id", "node_ord").agg(last.alias("loop")).select("doc_id", "node_ord", F.concat(F.lit("LOOP-"), "loop").alias("instrument_loop"))


def loop_edges(e: DataFrame, ed: DataFrame) -> DataFrame:
    """Edges from each member of a loop to the next, where there is none in that direction."""
    m = instrument_loops(e)
    nxt = m.withColumn("dst", F.lead("node_ord").over(Window.partitionBy("doc_id", "loop").orderBy("node_ord"))).where("dst is not null")
    new = nxt.groupBy("doc_id", F.col("node_ord").alias("src"), "dst").agg(F.min("loop").alias("loop")).join(ed.select("doc_id", "src", "dst"), ["doc_id", "src", "dst"], "left_anti")
    return new.select("doc_id", "src", "dst", F.concat(F.lit("LOOP-"), "loop").alias("loop_id"), F.lit(50.0).alias("weight"))


def resolved(e: DataFrame, ed: DataFrame) -> DataFrame:
    """src, dst of all edges of the graph: by proximity and along loops."""
    return ed.select("doc_id", "src", "dst").union(loop_edges(e, ed).select("doc_id", "src", "dst"))


def graph_components(e: DataFrame, ed: DataFrame) -> DataFrame:
    """Weak components of the resolved graph: doc_id, node, component (its smallest node).

    Proximity edges stay on their page, so pages are solved first, each in one pass; loop edges then join the pieces."""
    if "page" not in ed.columns:
        return components(e.select("doc_id", F.col("node_ord").alias("node")), resolved(e, ed), ["doc_id"])
    pieces = cut(local_components(e.select(*PAGE, F.col("node_ord").alias("node")), ed, PAGE)).select("doc_id", "node", F.col("component").alias("piece"))
    of = lambda c: pieces.select("doc_id", F.col("node").cast("int").alias(c), F.col("piece").alias(f"{c}_piece"))
    joins = loop_edges(e, ed).select("doc_id", "src", "dst").join(of("src"), ["doc_id", "src"]).join(of("dst"), ["doc_id", "dst"]).where("src_piece != dst_piece")
    joins = joins.select("doc_id", F.col("src_piece").alias("src"), F.col("dst_piece").alias("dst")).distinct()
    ends = joins.select("doc_id", F.col("src").alias("node")).union(joins.select("doc_id", "dst")).distinct()
    whole = components(ends, joins, ["doc_id"]).withColumnRenamed("node", "piece")
    return pieces.join(whole, ["doc_id", "piece"], "left").select("doc_id", "node", F.coalesce("component", "piece").alias("component"))


def graph_summary(e: DataFrame, ed: DataFrame) -> DataFrame:
    """Of the resolved graph: nodes, edges, nodes by category, weak components."""
    c = graph_components(e, ed).groupBy("doc_id").agg(F.countDistinct("component").alias("components"))
    n = e.groupBy("doc_id").agg(F.count("*").alias("nodes"), *[F.count(F.when(F.col("category") == k, 1)).alias(k) for k in dims.CATEGORY_ORDER])
    d = resolved(e, ed).groupBy("doc_id").agg(F.count("*").alias("edges"))
    return n.join(d, "doc_id", "left").join(c, "doc_id").withColumns({"edges": F.coalesce("edges", F.lit(0)), "connected": F.col("components") == 1})


# --- scores and rules ---


def confidence_stats(e: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return e.groupBy("doc_id").agg(F.count("*").alias("total"), F.bround(F.avg(c), 3).alias("avg_confidence"), F.bround(F.min(c), 3).alias("min_confidence"), F.bround(F.max(c), 3).alias("max_confidence"), F.count_if(c < 0.6).alias("needs_review"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"))


def mean_confidence(e: DataFrame) -> DataFrame:
    """The mean of what is there of detection, text and tag (0.9)."""
    parts = F.filter(F.array("det_confidence", "ocr_confidence", F.when(F.col("tag_id").isNotNull(), 0.9)), lambda x: x.isNotNull())
    return e.withColumn("mean_confidence", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0))


def with_confidence(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """nodes with the confidence of scores (doc_id, node_ord, confidence) where there is one, as when scores are computed
    after the graph."""
    s = scores.select("doc_id", "node_ord", F.col("confidence").alias("_new"))
    return nodes.join(s, ["doc_id", "node_ord"], "left").withColumn("confidence", F.coalesce("_new", "confidence")).drop("_new")


def entities_of(e: DataFrame, entity_type: str | None = None, category: str | None = None, line: str | None = None) -> DataFrame:
    """Entities of one type, category or line, or of several of these at once."""
    for column, value in (("entity_type", entity_type), ("category", category), ("line_number", line)):
        e = e if value is None else e.where(F.col(column) == value)
    return e


def highlighted(ed: DataFrame, condition: Column) -> DataFrame:
    """doc_id, node: the ends of the edges that meet a condition."""
    kept = ed.where(condition)
    return kept.select("doc_id", F.col("src").alias("node")).union(kept.select("doc_id", "dst")).distinct()


def page_counts(symbols: DataFrame, texts: DataFrame, e: DataFrame) -> DataFrame:
    """Detections, texts and entities of each page that has any."""
    n = lambda df, name: df.groupBy(*PAGE).agg(F.count("*").alias(name))
    j = n(symbols, "detections").join(n(texts, "text_regions"), PAGE, "full").join(n(e, "entities"), PAGE, "full")
    return j.fillna(0, ["detections", "text_regions", "entities"])


def run_summary(pages: DataFrame, e: DataFrame, ed: DataFrame) -> DataFrame:
    """A row per document: what page_counts counts, the graph and the mean confidence."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("detections").alias("total_detections"), F.sum("text_regions").alias("total_text_regions"))
    c = confidence_stats(e).select("doc_id", F.col("total").alias("total_entities"), "avg_confidence")
    g = resolved(e, ed).groupBy("doc_id").agg(F.count("*").alias("total_edges"))
    return n.join(c, "doc_id", "left").join(g, "doc_id", "left").fillna(0, ["total_entities", "total_edges"])


def loop_functions(e: DataFrame) -> DataFrame:
    """The different functions of the instruments of a loop."""
    t = e.where("entity_type = 'instrument'").select("doc_id", F.explode("tags").alias("t")).where("t.loop_number is not null")
    f = t.select("doc_id", F.col("t.loop_number").alias("loop"), F.explode(F.split("t.function", "/")).alias("f"))
    return f.groupBy("doc_id", "loop").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("functions"))


def _issue(rule: str, severity: str, message: Column, who: str = "entity_id") -> list[Column]:
    return ["doc_id", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(who).alias("entity_id"), message.alias("message")]


def _place() -> Column:
    return F.concat(F.lit("("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(")"))


def issues(e: DataFrame, ed: DataFrame) -> DataFrame:
    """Findings of rules R001 to R006.  The degree counts proximity and loop edges."""
    d = degrees(e, resolved(e, ed))
    r1 = e.where("entity_type in ('instrument', 'equipment', 'valve') and tag_id is null").select(*_issue("R001", "warning", F.concat(F.initcap("entity_type"), F.lit(" at position "), _place(), F.lit(" has no tag identifier."))))
    ids = F.array_sort(F.collect_list(F.struct("node_ord", "entity_id")))
    dup = e.where("tag_id is not null").groupBy("doc_id", "tag_id").agg(ids.alias("ids")).where(F.size("ids") > 1)
    names = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("'"), i["entity_id"], F.lit("'"))), ", ")
    r2 = dup.withColumn("entity_id", F.col("ids")[0]["entity_id"]).select(*_issue("R002", "error", F.concat(F.lit("Duplicate tag '"), "tag_id", F.lit("' found on "), F.size("ids").cast("string"), F.lit(" entities: ["), names, F.lit("]"))))
    r3 = loop_members(e).groupBy("doc_id", "loop").agg(F.count("*").alias("n"), F.min("node_ord").alias("node_ord")).where("n = 1").join(e.select("doc_id", "node_ord", "entity_id"), ["doc_id", "node_ord"])
    r3 = r3.select(*_issue("R003", "info", F.concat(F.lit("Loop "), "loop", F.lit(" has only 1 instrument. Typical loops have 2-3 elements."))))
    r4 = e.where(F.col("confidence") < SETTINGS.low).select(*_issue("R004", "warning", F.concat(F.lit("Low confidence ("), F.format_number("confidence", 2), F.lit(") for entity '"), F.coalesce("tag_id", "description"), F.lit("' at "), _place(), F.lit("."))))
    r5 = d.where("degree = 0 and entity_type not in ('line', 'unknown')").select(*_issue("R005", "info", F.concat(F.lit("Orphan "), "entity_type", F.lit(" '"), F.coalesce("tag_id", F.lit("None")), F.lit("' has no connections."))))
    r6 = d.where("entity_type = 'valve' and degree < 2").select(*_issue("R006", "warning", F.concat(F.lit("Valve '"), F.coalesce("tag_id", "entity_id"), F.lit("' has only "), F.col("degree").cast("string"), F.lit(" connection(s). Valves typically have 2 (inlet + outlet)."))))
    out = r1
    for r in (r2, r3, r4, r5, r6):
        out = out.unionByName(r)
    return out


def rule_summary(e: DataFrame, found: DataFrame) -> DataFrame:
    n = e.groupBy("doc_id").agg(F.count("*").alias("entities"), F.count("tag_id").alias("tagged"))
    f = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct(F.when(F.col("severity") == "error", F.col("entity_id"))).alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    j = n.join(f, "doc_id", "left")
    return j.select("doc_id", "entities", "tagged", zero("errors").alias("errors"), zero("warnings").alias("warnings"), F.bround((F.col("entities") - zero("bad")) / F.col("entities") * 100, 1).alias("pass_rate"))


# --- bill of quantities ---


def mto_rows(e: DataFrame) -> DataFrame:
    """Items that can be bought: entities of one category, description, size and specification, with a quantity."""
    rank = F.array_position(F.array(*map(F.lit, dims.CATEGORY_ORDER)), F.col("category"))
    x = e.withColumn("category", F.when(F.coalesce(rank, F.lit(0)) > 0, F.col("category")).otherwise(dims.OTHER))
    x = x.withColumns({"description": F.coalesce("description", "entity_type", F.lit("Unknown")), "size": F.coalesce("size", F.lit("")), "specification": F.coalesce("specification", F.lit(""))})
    line = F.col("line_number") if "line_number" in e.columns else F.lit(None).cast("string")
    member = F.struct(F.coalesce("tag_id", F.lit("ZZZ")).alias("k"), "node_ord", "tag_id")
    g = x.withColumn("line", line).groupBy("doc_id", "category", "description", "size", "specification").agg(
        F.count("*").alias("quantity"), F.avg("confidence").alias("mean"), F.array_sort(F.collect_list(F.when(F.col("tag_id").isNotNull(), member))).alias("m"), F.array_join(F.array_sort(F.collect_set("line")), ", ").alias("line"))
    tags_ = F.array_join(F.transform("m", lambda t: t["tag_id"]), ", ")
    dash = lambda c: F.when(c == "", F.lit("—")).otherwise(c)
    notes = F.when(F.col("mean") < SETTINGS.review, "⚠ Low confidence — needs review").when(F.size("m") == 0, "Tag not identified").otherwise("")
    return g.select("doc_id", "category", "description", dash(F.col("size")).alias("size"), dash(F.col("specification")).alias("specification"), "quantity", dash(tags_).alias("tag_id"), dash(F.col("line")).alias("line_number"), pretty_type(F.col("category")).alias("entity_type"), F.bround("mean", 4).alias("confidence"), notes.alias("notes"))


def numbered(rows: DataFrame) -> DataFrame:
    """Item numbers in the order of the sheet, and which rows of a category are shaded."""
    rank = F.array_position(F.array(*map(F.lit, dims.CATEGORY_ORDER)), F.col("category"))
    order = ["description", "tag_id", "size", "specification"]
    whole, part = Window.partitionBy("doc_id").orderBy(rank, *order), Window.partitionBy("doc_id", "category").orderBy(*order)
    return rows.withColumns({"item_no": F.row_number().over(whole), "shaded": F.row_number().over(part) % 2 == 0})


def sheet_layout(rows: DataFrame) -> DataFrame:
    """Numbered items with the row of the sheet that each is in and its fill: categories have a band above them and an
    empty row below, items begin under the header in row 5."""
    rank = F.array_position(F.array(*map(F.lit, dims.CATEGORY_ORDER)), F.col("category"))
    before = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(rank)) - 1
    fill = F.when(F.col("confidence") < SETTINGS.review, "low").when(F.col("shaded"), "zebra").otherwise("none")
    return rows.withColumns({"sheet_row": F.col("item_no") + 6 + 2 * before, "fill": fill})


def category_totals(e: DataFrame) -> DataFrame:
    return e.rollup("doc_id", "category").agg(F.count("*").alias("n")).where("doc_id is not null").withColumn("category", F.coalesce("category", F.lit("TOTAL")))
