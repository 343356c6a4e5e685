"""Engine inputs out of the test tables, in integers and halves so that results are exact.

The SQL is plain enough to run anywhere: the oracle uses the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASSES = ["Gate Valve", "Ball_valve", "Centrifugal Pump", "Heat Exchanger", "Level Trasmitter", "Flow Indicator", "Reducer", "Concentric Flange", "Storage Tank", "Unknown Thing", "Safety Relief Valve", "Temperature Controller", "Air Cooler", "Spectacle Blind", "Pneumatic - Diaphragm Angle Valve", "Panel Note"]
_CLASS = "CASE pk % 16 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
_N = "CAST(100 + o_custkey % 900 AS VARCHAR(20))"
TEXTS = [f"concat('P-', {_N}, 'A')", f"concat('FIC-', {_N})", f"concat('TT-', {_N}, '/', {_N})", f"concat('6\"-PA-1', {_N}, '-A1A-N')", "'150#'", "'3/4\"'", "'Methanol'", "'|||'", "concat('P-1O', CAST(o_custkey % 10 AS VARCHAR(20)))", f"concat('E ', {_N}, ' A/B')", "'PSHH'", "'SS304'", f"concat('pump ', {_N})", f"concat('A-', {_N})", f"concat('+V-', {_N})", _N]
_TEXT = "CASE o_custkey % 16 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEXTS)) + " END"

VIEWS = {
    "base": "SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2",
    "symbols": f"""SELECT CAST(floor(ok / 400) AS BIGINT) AS doc_id, CAST(floor(ok / 8) AS BIGINT) AS page, (ok % 8) * 8 + ln AS det_ord, {_CLASS} AS class_name, (64 + (pk * 7 + q) % 64) / CAST(128 AS DOUBLE) AS confidence,
        CAST((pk * 37 + ln * 211) % 1500 AS DOUBLE) AS x1, CAST((sk * 53 + ok * 17) % 1000 AS DOUBLE) AS y1, CAST((pk * 37 + ln * 211) % 1500 + 16 + q % 48 AS DOUBLE) AS x2, CAST((sk * 53 + ok * 17) % 1000 + 16 + pk % 48 AS DOUBLE) AS y2,
        CAST((pk * 37 + ln * 211) % 1500 * 2 + 16 + q % 48 AS DOUBLE) / 2 AS cx, CAST((sk * 53 + ok * 17) % 1000 * 2 + 16 + pk % 48 AS DOUBLE) / 2 AS cy FROM base""",
    "dense": """SELECT CAST(floor(ok / 400) AS BIGINT) AS doc_id, CAST(floor(ok / 8) AS BIGINT) AS page, (ok % 8) * 8 + ln AS det_ord, (64 + (pk * 7 + q) % 64) / CAST(128 AS DOUBLE) AS confidence,
        CAST((pk % 4) * 100 + ((ok % 8) * 8 + ln) % 11 * 8 AS DOUBLE) AS x1, CAST((pk % 3) * 100 + ((ok % 8) * 8 + ln) % 4 * 6 AS DOUBLE) AS y1,
        CAST((pk % 4) * 100 + ((ok % 8) * 8 + ln) % 11 * 8 + 44 + ((ok % 8) * 8 + ln) % 4 * 4 AS DOUBLE) AS x2, CAST((pk % 3) * 100 + ((ok % 8) * 8 + ln) % 4 * 6 + 44 + pk % 3 * 4 AS DOUBLE) AS y2 FROM base""",
    "texts": f"""SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS doc_id, CAST(floor(o_orderkey / 8) AS BIGINT) AS page, o_orderkey % 8 AS text_ord, {_TEXT} AS text, (64 + (o_custkey * 3) % 64) / CAST(128 AS DOUBLE) AS confidence,
        CAST((o_custkey * 41 + o_orderkey * 7) % 1500 AS DOUBLE) AS cx, CAST((o_custkey * 29 + o_orderkey * 13) % 1000 AS DOUBLE) AS cy FROM orders""",
    "blobs": """SELECT CAST(floor(ok / 400) AS BIGINT) AS doc_id, CAST(floor(ok / 8) AS BIGINT) AS page, (ok % 8) * 8 + ln AS blob_ord, (pk * 37 + ln * 11) % 700 AS x, 100 + (pk % 3) * 40 + sk % 9 AS y, 4 + q % 30 AS w, 8 + pk % 30 AS h, 20 + (pk * q) % 400 AS area FROM base""",
    "words": """SELECT CAST(floor(ok / 400) AS BIGINT) AS doc_id, CAST(floor(ok / 8) AS BIGINT) AS page, (ok % 8) * 8 + ln AS text_ord, CASE pk % 5 WHEN 0 THEN 'FIC' WHEN 1 THEN 'fic' WHEN 2 THEN '-101' WHEN 3 THEN '|' ELSE concat('P-', CAST(pk % 4 AS VARCHAR(9))) END AS text, (pk * 7 + q) % 64 / CAST(64 AS DOUBLE) AS confidence,
        CAST((pk * 37 + ln * 11) % 300 AS DOUBLE) AS x1, CAST(100 + (pk % 3) * 40 + sk % 9 AS DOUBLE) AS y1, CAST((pk * 37 + ln * 11) % 300 + 2 + q % 30 AS DOUBLE) AS x2, CAST(100 + (pk % 3) * 40 + sk % 9 + 2 + pk % 20 AS DOUBLE) AS y2 FROM base""",
    "sheets": "SELECT p_partkey AS sheet, 640 + CAST(p_size AS BIGINT) * 97 AS width, 480 + (p_partkey % 37) * 131 AS height FROM part",
    "images": "SELECT doc_id AS image, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, concat('img', CAST(doc_id AS VARCHAR(20)), '.png') AS name, text AS content FROM documents",
    "boxes": "SELECT p_partkey % 50 AS image, p_partkey % 20 AS cid, p_partkey AS ord, (p_partkey % 10) / CAST(16 AS DOUBLE) AS cx FROM part",
    "label_lines": "SELECT p_partkey % 50 AS image, CASE p_partkey % 7 WHEN 0 THEN 'x 0.5 0.5 0.1 0.1' WHEN 1 THEN '3 0.5 0.5 0.1' WHEN 2 THEN '  4 0.5  0.5 0.1 0.1 ' ELSE concat(CAST(p_partkey % 20 AS VARCHAR(20)), ' 0.5 0.25 0.125 0.0625') END AS value FROM part",
    "uploads": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'exe' WHEN 1 THEN 'png' WHEN 2 THEN 'bmp' ELSE 'pdf' END AS kind, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('BM', text) ELSE concat('%PDF-1.4', text) END AS content FROM documents",
    "jobs": "SELECT event_id AS id, event_type AS status, ts AS created_at FROM events",
    "reports": "SELECT conv_id * 1000 + turn AS id, concat('Before.\n', CAST(turn AS VARCHAR(9)), '. Missing tag on pump\n- Severity: ', CASE turn % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warning' END, '\n\n**2) ', role, '**\nseverity = info') AS text FROM conversations",
}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The engine's inputs by name."""
    out: dict[str, DataFrame] = {}
    for name, sql in VIEWS.items():
        source = sql.rsplit(" FROM ", 1)[1].split()[0]
        text = sql.replace(f" FROM {source}", " FROM {source}").replace("VARCHAR(20)", "STRING").replace("VARCHAR(9)", "STRING").replace("\n        ", " ").replace("\n", "\\n")
        out[name] = spark.sql(text, source=out[source] if source in out else spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    return out
