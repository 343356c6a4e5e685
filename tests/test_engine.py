import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from drafthaus import dims
from drafthaus.functions import columns as C
from drafthaus.operators.spatial import components, greedy_match, greedy_nms, range_join
from drafthaus.plans import catalogue, curation, drawing, oracles
from drafthaus.sources import sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

TAGS = [
    ("P-101A", "equipment_tag", "P-101A", "Pump"), ("E-201A/B", "equipment_tag", "E-201A/B", "Heat Exchanger"), ("FIC-1001", "instrument_tag", "FIC-1001", "Flow Indicator/Controller"),
    ("PSHH", "instrument_tag", "PSHH", "Pressure Switch/High/High"), ("TE101", "instrument_tag", "TE-101", "Temperature Element"), ("TT-301/302", "instrument_tag", "TT-301/302", "Temperature Transmitter"),
    ('6"-PA-1001-A1A-N', "line_number", '6"-PA-1001-A1A-N', '6" Process Air Line 1001'), ("150#", "specification", "150#", "Specification: 150#"), ('3/4"', "pipe_size", '3/4"', "3/4 inch pipe"),
    ("12", "unknown", "12", None), ("Methanol", "description", "Methanol", "Methanol"), ("A-101", "instrument_tag", "A-101", "Analyzer"), ("AIR", "instrument_tag", "AIR", "Analyzer Indicator/Recorder"),
    ("CSTR-101", "specification", "CSTR-101", "Specification: CSTR-101"), ("P-1O1", "equipment_tag", "P-101", "Pump"), ("+E-1003", "equipment_tag", "E-1003", "Heat Exchanger"), ("PUMP 101", "description", "PUMP-101", "PUMP-101"),
]


def test_tags(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TAGS] + [(None,)], "text string")
    got = {r.text: r.tag for r in drawing.tags(df).collect()}
    for text, kind, tag, description in TAGS:
        assert (got[text].tag_type, got[text].tag_id, got[text].parsed_description) == (kind, tag, description), text
    assert got[None] is None


def test_axis_starts(spark):
    want = {1217: [0], 1920: [0, 608], 2369: [0, 1057], 3000: [0, 844, 1688], 4000: [0, 896, 1792, 2688], 9933: [0, 1078, 2155, 3233, 4310, 5388, 6466, 7543, 8621]}
    df = spark.createDataFrame([(k,) for k in want], "e bigint").select("e", C.axis_starts(F.col("e")).alias("s"))
    assert {r.e: r.s for r in df.collect()} == want


def test_classes_and_cells(spark):
    df = spark.createDataFrame([("Some Brand New Widget Valve",), ("Some Brand New Widget Pump",), ("Totally Unknown Thing",), ("",)], "n string")
    assert [r[0] for r in df.select(C.classify_symbol(F.col("n"))).collect()] == ["valves", "equipment", "other", "other"]
    df = spark.createDataFrame([("=1+1", "../../evil"), ("ok", "a/b")], "a string, b string")
    assert [tuple(r) for r in df.select(C.cell_text(F.col("a")), C.slug(F.col("b"))).collect()] == [("'=1+1", "evil"), ("ok", "a_b")]


def test_nms_and_match(spark):
    boxes = spark.createDataFrame([(1, 0, 0.9, 0.0, 0.0, 60.0, 60.0), (1, 1, 0.85, 2.0, 2.0, 62.0, 62.0), (1, 2, 0.8, 100.0, 0.0, 140.0, 40.0)], "page int, o int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert [r.o for r in greedy_nms(boxes, ["page"], "o").orderBy("rank").collect()] == [0, 2]
    pairs = spark.createDataFrame([(1, 0, 0, 20.0), (1, 0, 1, 290.0), (1, 1, 0, 280.0), (1, 1, 1, 10.0)], "page int, l int, r int, dist double")
    assert {(r.l, r.r) for r in greedy_match(pairs, ["page"], "l", "r").collect()} == {(0, 0), (1, 1)}


def test_range_join_and_components(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(200)]
    a = spark.createDataFrame([(1, *p) for p in pts], "k int, i int, x double, y double")
    b = a.toDF("k", "j", "bx", "by")
    got = {(r.i, r.j) for r in range_join(a, b, 60.0, ["k"], "x", "y", "bx", "by").collect()}
    assert got == {(i, j) for i, x, y in pts for j, u, v in pts if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 60}
    nodes = spark.createDataFrame([(1, i) for i in range(12)], "k int, node int")
    chain = spark.createDataFrame([(1, i + 1, i) for i in range(9)], "k int, src int, dst int")
    assert sorted(r.component for r in components(nodes, chain, ["k"]).collect()) == [0] * 10 + [10, 11]


def test_curation(spark):
    images = spark.createDataFrame([("train", "a", "A"), ("train", "b", "A"), ("test", "c", "A"), ("valid", "d", "B"), ("test", "e", "C")], "split string, name string, content string")
    kept = curation.dedup_content(images)
    assert sorted(r.name for r in kept.collect()) == ["a", "d", "e"]
    assert curation.leaked(kept).count() == 0
    reports = spark.createDataFrame([(1, "**1. Missing**\nSeverity: error\n**2. Other**\nSeverity: info"), (2, "1. No errors detected"), (3, "")], "id int, text string")
    assert {(r.id, r.passed) for r in curation.report_passed(reports).collect()} == {(1, False), (2, True), (3, True)}
    assert curation.report_issues(reports).where("id = 1").count() == 2


def test_workbook(spark):
    import xml.etree.ElementTree as ET

    schema = "doc_id int, category string, item_no int, tag_id string, description string, size string, specification string, quantity int, confidence double, shaded boolean"
    rows = drawing.sheet_layout(spark.createDataFrame([(1, "equipment", 1, "P-1", "=evil", "", "", 2, 0.9, False), (1, "equipment", 2, "P-2", "b", "", "", 1, 0.9, True), (1, "valves", 3, "—", "c", "", "", 1, 0.2, False)], schema))
    assert [(r.sheet_row, r.fill) for r in rows.orderBy("item_no").collect()] == [(7, "none"), (8, "zebra"), (11, "low")]
    totals = spark.createDataFrame([("valves", 1), ("equipment", 3), ("TOTAL", 4)], "category string, n int")
    findings = spark.createDataFrame([("R002", "error", "E0001", "=bad")], "rule_id string, severity string, entity_id string, message string")
    book = zipfile.ZipFile(io.BytesIO(sinks.workbook(rows, "x", 4, totals, findings, {"errors": 1}, "# Title\n=x", degraded=True)))
    sheets = [book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2, 3)]
    for name in book.namelist():
        ET.fromstring(book.read(name))
    assert "'=evil" in sheets[0] and 'ref="A5:K11"' in sheets[0] and "Equipment (3 items)" in sheets[0] and sheets[0].index("EQUIPMENT") < sheets[0].index("VALVES") < sheets[0].index("TOTAL")
    assert "'=bad" in sheets[1] and "R002" in sheets[1] and "did not run" in sheets[2] and "'=x" in sheets[2]
    one = spark.createDataFrame([(1, "P-1", "=evil", 2)], "item_no int, tag_id string, description string, quantity int")
    assert 'ref="A5:K6"' in zipfile.ZipFile(io.BytesIO(sinks.workbook(one, "x", 2))).read("xl/worksheets/sheet1.xml").decode()


def test_lookup_values():
    assert oracles._VALUES["keywords"] == [[c, w] for c, ws in dims.KEYWORDS.items() for w in ws]
    for name, value in (("entity_types", dims.ENTITY_TYPES), ("variables", dims.VARIABLES), ("functions", dims.FUNCTIONS), ("equipment_letters", dims.EQUIPMENT_LETTERS), ("services", dims.SERVICES), ("misspelt", dims.MISSPELT)):
        assert oracles._VALUES[name] == value


def test_white_space(spark):
    df = spark.createDataFrame([("\tP-101\u00a0",), ("\u2003E-1001\r\n",)], "text string")
    assert [r.tag.tag_type for r in drawing.tags(df).collect()] == ["equipment_tag"] * 2
    crlf = spark.createDataFrame([(1, "1. Missing tag\r\n- Severity: error\r\n2. Other\r\n")], "id int, text string")
    assert sorted(r.text for r in curation.report_issues(crlf).collect()) == ["1. Missing tag - Severity: error", "2. Other"]


def test_small_expressions(spark):
    names = spark.createDataFrame([("C:\\x\\a b.pdf",), ("../../etc/passwd",), ("..",), (None,), ("n\nl.png",), ("x" * 200,)], "n string").select(C.upload_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["a b.pdf", "passwd", "upload", "upload", "n_l.png", "x" * 120]
    keys = spark.createDataFrame([(None, None), ("k", "k"), ("k", None), ("k", "x"), ("", "x")], "c string, g string").select(C.may_call(F.col("c"), F.col("g")).alias("x"))
    assert [r.x for r in keys.collect()] == [True, True, False, False, True]
    nodes = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.6)], "doc_id int, node_ord int, confidence double")
    scores = spark.createDataFrame([(1, 2, 0.9)], "doc_id int, node_ord int, confidence double")
    assert sorted(r.confidence for r in drawing.with_confidence(nodes, scores).collect()) == [0.5, 0.9]


def test_datasets(spark, tmp_path):
    pytest.importorskip("yaml")
    from drafthaus.sources import datasets

    for split, images in (("train", ("a.jpg", "b.png", "note.txt")), ("valid", ())):
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir()
        for name in images:
            (tmp_path / split / "images" / name).write_bytes(b"x")
    (tmp_path / "train" / "labels" / "a.txt").write_text("0 .5 .5 .1 .1\n1 .5 .5 .1\n7 .5 .5 .1 .1\nx .5 .5 .1 .1\n 1  .2 .2 .1 .1 \n")
    (tmp_path / "data.yaml").write_text("train: ../train/images\nval: /abs/valid\nnames:\n  10: Tank\n  2: Pump\nglyphs: []\n")
    folder = str(tmp_path)
    assert datasets.read_class_names(folder) == ["Pump", "Tank"] and datasets.find_split(folder, "valid").endswith("valid") and datasets.find_split(folder, "test") is None
    config, names = datasets.dataset_config(folder)
    assert config["train"] == str(tmp_path / "train" / "images") and config["val"] == "/abs/valid" and names == ["Pump", "Tank"]
    got = {r.image: [x.cid for x in r.rows] for r in datasets.load_split(spark, folder, "train").collect()}
    assert got == {"a": [0, 1], "b": []} and datasets.load_split(spark, folder, "test").count() == 0
    (tmp_path / "glyphs.yaml").write_text("glyphs:\n- {cls: Tank, tag: T-1, box: [0, 0, 4, 4]}\n- {cls: Tank, box: [3, 0, 3, 4]}\n")
    assert [r.tag for r in datasets.load_catalogue(spark, str(tmp_path / "glyphs.yaml")).collect()] == ["T-1"]


def test_review(spark):
    from drafthaus.plans import review

    found = spark.createDataFrame([(1, "R002", "error", "E0001", "Duplicate"), (2, "R005", "info", "E0002", "Orphan")], "doc_id long, rule_id string, severity string, entity_id string, message string")
    told = {"doc_id": 2, "extraction": "x", "graph": "g", "findings": "f"}
    none = review.review(spark, told | {"doc_id": 1}, found)
    assert none.degraded and not none.passed and "**Errors:** 1" in none.report and "no language model" in none.report
    calls = []
    answers = iter(["fine", "1. Odd tag | Severity: warning\n2. Other | Severity: info", "the report"])
    good = review.review(spark, told, found, lambda prompt: calls.append(prompt) or next(answers))
    assert len(calls) == 3 and not good.degraded and good.passed and len(good.issues) == 2 and good.report == "the report"

    def broken(prompt):
        raise OSError("offline")

    assert review.review(spark, told, found, broken).reason == "offline"


def test_node_loops_begun_together(spark):
    tags = lambda *loops: [(n,) for n in loops]
    rows = [(1, 1, "instrument", tags("678", "1615", "99")), (1, 2, "instrument", tags("1615", "678")), (1, 3, "instrument", tags("99")), (1, 4, "instrument", tags("5")), (1, 5, "instrument", tags("5", "1615"))]
    e = spark.createDataFrame(rows, "doc_id int, node_ord int, entity_type string, tags array<struct<loop_number string>>")
    got = {r.node_ord: r.instrument_loop for r in drawing.node_loops(e).collect()}
    assert got == {1: "LOOP-1615", 2: "LOOP-1615", 3: "LOOP-99", 4: "LOOP-5", 5: "LOOP-5"}


def test_streams(spark, tmp_path):
    from drafthaus.streaming import jobs

    rows = [(1, "queued", "2024-01-01 00:10:00"), (1, "queued", "2024-01-01 00:10:00"), (2, "done", "2024-01-01 00:50:00"), (3, "done", "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "id long, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at")).coalesce(1).write.parquet(str(tmp_path / "jobs"))

    def run(make, name, mode="append"):
        source = spark.readStream.schema("id long, status string, created_at timestamp").parquet(str(tmp_path / "jobs"))
        query = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted(r.id for r in run(jobs.once, "once")) == [1, 2, 3]
    counts = {(r.window.start.hour, r.status): r.n for r in run(jobs.job_counts, "counts", "complete")}
    assert sorted(counts.values()) == [1, 1, 2]
    spark.createDataFrame([("P-101",), ("Methanol",)], "text string").write.parquet(str(tmp_path / "texts"))
    texts = jobs.tagged_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "texts")))
    query = texts.writeStream.format("memory").queryName("tagged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.tag.tag_type for r in spark.table("tagged").collect()} == {"equipment_tag", "description"}


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(oracles.sql()[name])
    place = [rel.columns.index(c) for c in cols]
    key = lambda rows: sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in rows)
    assert key(df.select(*cols).collect()) == key([tuple(r[i] for i in place) for r in rel.fetchall()])


def test_merge_tiles_edge(spark):
    sheet = spark.createDataFrame([(1, 2000, 1000)], "sheet int, width bigint, height bigint")
    tiles = drawing.tile_grid(sheet)
    wide = tiles.where("col = 0").first().tile_width
    rows = [(1, 0, 0, gap, wide - gap - 40.0, 100.0, float(wide - gap), 140.0) for gap in (2, 6, 7)]
    d = spark.createDataFrame(rows, "sheet int, row int, col int, gap int, x1 double, y1 double, x2 double, y2 double")
    assert [r.gap for r in drawing.merge_tiles(d, tiles, ["sheet", "row", "col"]).collect()] == [7]


def test_merge_many_tiles_of_few_sheets(spark):
    sheets = spark.range(3).select(F.col("id").alias("sheet"), F.lit(20000).cast("long").alias("width"), F.lit(20000).cast("long").alias("height"))
    tiles, on = drawing.tile_grid(sheets), ["sheet", "row", "col"]
    d = tiles.select(*on, *[F.lit(v).alias(c) for c, v in (("x1", 100.0), ("y1", 100.0), ("x2", 150.0), ("y2", 150.0))])
    merged = drawing.merge_tiles(d, tiles, on)
    assert len(merged.collect()) == 3 * 17 * 17
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()  # each sheet is hundreds of tiles, and the estimate counts sheets


def test_merge_all_tiles(spark):
    from drafthaus.sources.bridge import views

    want, far = set(), 0
    for t in drawing.tile_grid(views(spark, SF)["sheets"]).collect():
        for i in range(8):
            left = i * 433.0 - 3 if i < 4 else i * 3.0 - 11
            x1, x2 = (min(max(t.x + x, 0.0), t.width) for x in (left, left + 63))
            y1, y2 = (min(max(t.y + y, 0.0), t.height) for y in (i * 217.0, i * 217.0 + 40))
            sliced = (t.cut_left and x1 - t.x <= 6.0) or (t.cut_top and y1 - t.y <= 6.0) or (t.cut_right and t.x + t.tile_width - x2 <= 6.0) or (t.cut_bottom and t.y + t.tile_height - y2 <= 6.0)
            if x2 > x1 and y2 > y1 and not sliced:
                want.add((t.sheet, t.row, t.col, i, x1, y1, x2, y2))
                far += t.row > 1 or t.col > 1
    got = [tuple(r[c] for c in ("sheet", "row", "col", "det_ord", "x1", "y1", "x2", "y2")) for r in catalogue.QUERIES["tile_merge_clip_cut"](spark, SF).collect()]
    assert far and len(got) == len(want) and set(got) == want


def test_covered_words_masks(spark):
    from collections import defaultdict

    from drafthaus.sources.bridge import views

    v = views(spark, SF)
    boxes = defaultdict(list)
    for b in v["blobs"].collect():
        boxes[b.doc_id, b.page].append((b.x, b.y, b.x + b.w, b.y + b.h))
    want = set()
    for r in v["words"].collect():
        x1, y1, x2, y2 = (int(r[c]) for c in ("x1", "y1", "x2", "y2"))
        mask = set()
        for a, b, c, d in boxes[r.doc_id, r.page]:
            mask |= {(x, y) for x in range(max(a, x1), min(c, x2)) for y in range(max(b, y1), min(d, y2))}
        if x2 > x1 and y2 > y1 and mask and len(mask) >= 25 / 255 * (x2 - x1) * (y2 - y1):
            want.add((r.doc_id, r.page, r.text_ord, len(mask)))
    got = [tuple(r[c] for c in ("doc_id", "page", "text_ord", "cover")) for r in catalogue.QUERIES["covered_words"](spark, SF).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_partitions_dont_matter(spark):
    from drafthaus.sources.bridge import views

    v = views(spark, SF)
    a = drawing.mto_rows(drawing.entities(v["symbols"], v["texts"]))
    b = drawing.mto_rows(drawing.entities(v["symbols"].repartition(5, F.rand(1)), v["texts"].repartition(3, F.rand(2))))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_box_matches(spark):
    import random

    rng = random.Random(3)
    box = lambda x, y: (float(x), float(y), float(x + rng.choice((20, 40, 300))), float(y + rng.choice((20, 40, 300))))
    truth = [(p, i, *box(rng.randrange(-300, 600), rng.randrange(600))) for p in range(6) for i in range(25)]
    moved = lambda b: (b[0] + rng.choice((0, 7, 10, 20)), b[1] + rng.choice((0, 0, 13)), b[2] + rng.choice((0, 20)), b[3])
    found = [(p, i, *moved(b)) for p, i, *b in truth] + [(p, 30 + i, *box(rng.randrange(600), rng.randrange(600))) for p in range(7) for i in range(5)]
    odd = [(0, 90, None, 1.0, 2.0, 3.0), (0, 91, 5.0, 5.0, 5.0, 9.0)]
    frame = lambda rows, o: spark.createDataFrame(rows, f"page int, {o} int, x1 double, y1 double, x2 double, y2 double")
    t, d = frame(truth + odd, "truth_ord"), frame(found + odd, "det_ord")

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = w * h if w > 0 and h > 0 else 0.0
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    pairs = sorted((-share(a, b), p, i, j) for p, i, *a in truth for q, j, *b in found if p == q and share(a, b) >= 0.5)
    assert any(v == -0.5 for v, *_ in pairs)  # right at the limit
    want, lefts, rights = set(), set(), set()
    for _, p, i, j in pairs:
        if (p, i) not in lefts and (p, j) not in rights:
            want.add((p, i, j))
            lefts.add((p, i))
            rights.add((p, j))
    matches = curation.box_matches(t, d, ["page"])
    assert {(r.page, r.truth_ord, r.det_ord) for r in matches.collect()} == want
    scores = {r.page: r for r in curation.detection_scores(t, d, matches, ["page"]).collect()}
    assert (scores[6].truths, scores[6].found, scores[6].matched, scores[6].precision, scores[6].recall) == (0, 5, 0, 0.0, 0.0)
    assert curation.box_matches(t.limit(0), d, ["page"]).count() == 0
    with pytest.raises(ValueError):
        curation.box_matches(t, d, ["page"], 0.4)
