"""Where results go: JSON, Parquet and a workbook; and where label files and uploads come from."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cell_text, upload_problem

COLUMNS = [("item_no", "Item No."), ("tag_id", "Tag Number"), ("description", "Description"), ("entity_type", "Type"), ("size", "Size"), ("specification", "Rating/Spec"), ("quantity", "Quantity"), ("line_number", "Line Number"), ("sheet_ref", "Sheet Ref."), ("confidence", "Confidence"), ("notes", "Notes")]


def read_uploads(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """path, content and problem (null if taken) of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "content", upload_problem(F.col("path"), F.col("content"), most).alias("problem"))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("image"), "value")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row of JSON for each node and edge."""
    n = nodes.select("doc_id", F.lit("node").alias("kind"), F.to_json(F.struct(F.col("entity_id").alias("id"), "tag_id", "entity_type", "description", "category", "confidence", "size", "specification")).alias("json"))
    e = edges.select("doc_id", F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", "distance", "connection_type")).alias("json"))
    return n.unionByName(e)


# Colours by category.
COLOURS = {"equipment": "#FF4444", "valves": "#44AA44", "instruments": "#FF9900", "piping": "#4488FF", "other": "#888888"}


def graph_view(nodes: DataFrame) -> DataFrame:
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), "category"), F.lit("#888888"))
    return nodes.select("doc_id", "entity_id", F.coalesce("tag_id", "description").alias("label"), colour.alias("colour"))


def yolo_lines(labels: DataFrame, width, height) -> DataFrame:
    """image and its label text: class, centre and size as shares of the sheet with 6 decimals."""
    part = lambda v, whole: F.format_string("%.6f", F.bround(v / whole, 6))
    line = F.concat_ws(" ", F.col("cid").cast("string"), part((F.col("x1") + F.col("x2")) / 2, width), part((F.col("y1") + F.col("y2")) / 2, height), part(F.col("x2") - F.col("x1"), width), part(F.col("y2") - F.col("y1"), height))
    return labels.withColumn("_l", F.struct("ord", line.alias("l"))).groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["l"]), "\n").alias("text"))


# Colours of the workbook's bands, by category, and of its rows.
BANDS = {"equipment": "FF4444", "valves": "44AA44", "instruments": "FF9900", "piping": "4488FF", "other": "888888"}
FILLS = ["1A1A2E", "FFF3CD", "F5F5F5", "E3F2FD", *BANDS.values()]
PLAIN, TITLE, HEAD, LOW, ZEBRA, TOTAL, BAND = 0, 1, 2, 3, 4, 5, 6


def _reference(column: int, row: int) -> str:
    return f"{chr(65 + column)}{row}"


def _cell(column: int, row: int, value, style: int) -> str:
    ref = _reference(column, row)
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}" s="{style}"><v>{value}</v></c>'


def _sheet(rows: list[tuple[int, list, int]], freeze: str = "", filtered: str = "") -> str:
    """rows: (row number, values, style)."""
    body = "".join(f'<row r="{n}">' + "".join(_cell(i, n, v, style) for i, v in enumerate(values)) + "</row>" for n, values, style in rows)
    pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{int(freeze[1:]) - 1}" topLeftCell="{freeze}" state="frozen"/></sheetView></sheetViews>' if freeze else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{pane}<sheetData>{body}</sheetData>{f"""<autoFilter ref="{filtered}"/>""" if filtered else ""}</worksheet>'


def _styles() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS)
    cells = ["0", "1", "2", "0", "0", "1", *["2"] * len(BANDS)]  # fonts by style
    filled = [0, 0, 2, 3, 4, 5, *range(6, 6 + len(BANDS))]
    xfs = "".join(f'<xf numFmtId="0" fontId="{font}" fillId="{fill}" borderId="0" xfId="0" applyFont="1" applyFill="1"/>' for font, fill in zip(cells, filled))
    return f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="3"><font><sz val="10"/></font><font><b/><sz val="14"/></font><font><b/><sz val="10"/><color rgb="FFFFFFFF"/></font></fonts><fills count="{2 + len(FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(filled)}">{xfs}</cellXfs></styleSheet>'


def _safe(df: DataFrame) -> DataFrame:
    return df.select(*[(cell_text(F.col(c)) if t == "string" else F.col(c)).alias(c) for c, t in df.dtypes])


def workbook(rows: DataFrame, project: str, total: int, totals: DataFrame | None = None, findings: DataFrame | None = None, summary: dict | None = None, report: str | None = None, degraded: bool = False, sheet_ref: str = "") -> bytes:
    """One document's workbook as an .xlsx: the items, and if given the rule findings and a review's report.

    rows: numbered items with sheet_row (sheet_layout), category and fill; totals: category and n, with TOTAL last;
    findings: rule_id, severity, entity_id, message.  Title in row 1, header in row 5, items from row 6 in bands by
    category, then the totals; the filter ends at the last item.  These few thousand rows of one document come to the
    driver, as a workbook is one file; a document with over a million items doesn't fit a sheet and raises ValueError.
    """
    data = _safe(rows.orderBy("item_no")).collect()
    if len(data) > 1_000_000:
        raise ValueError("more rows than a sheet has")
    names = list(BANDS)
    lines = [(1, [f"Material Take-Off: {project}"], TITLE), (2, [f"Total items: {total}"], PLAIN), (5, [t for _, t in COLUMNS], HEAD)]
    band, last = None, 5
    for i, r in enumerate(data):
        known = r.asDict() | {"sheet_ref": sheet_ref}
        category, at = known.get("category"), known.get("sheet_row") or 6 + i
        if category is not None and category != band:
            band = category
            many = sum(x["quantity"] for x in data if x["category"] == band)
            lines.append((at - 1, [f"  {str(band).title()} ({many} items)"], BAND + (names.index(band) if band in names else names.index("other"))))
        lines.append((at, [known.get(c, "") for c, _ in COLUMNS], {"low": LOW, "zebra": ZEBRA}.get(known.get("fill"), PLAIN)))
        last = at
    if totals is not None:
        found = {r["category"]: r["n"] for r in totals.collect()}
        lines.append((last + 2, ["SUMMARY"], TOTAL))
        lines += [(last + 3 + k, [c.upper(), found[c]], PLAIN) for k, c in enumerate([c for c in names if c in found] + ["TOTAL"] * ("TOTAL" in found))]
    sheets = [("Material Take-Off", _sheet(lines, "A6", f"A5:{chr(64 + len(COLUMNS))}{max(last, 5)}"))]
    if findings is not None:
        table = [(1, ["Rule ID", "Severity", "Entity", "Message", "Suggestion"], HEAD), (2, ["SUMMARY"], TOTAL)]
        table += [(3 + k, [name, value], PLAIN) for k, (name, value) in enumerate((summary or {}).items())]
        begin = 4 + len(summary or {})
        issues = _safe(findings.select("rule_id", "severity", "entity_id", "message").orderBy("rule_id", "entity_id", "message")).collect()
        sheets.append(("Rule Validation", _sheet(table + [(begin + k, list(r), PLAIN) for k, r in enumerate(issues)], "A2")))
    if report is not None:
        head = [(1, ["Validation Report"], TITLE)] + [(3, ["⚠ LLM validation did not run — see the note below."], TOTAL)] * degraded
        begin = 5 if degraded else 3
        text = [(begin + k, [f"'{x}" if x[:1] in "=+-@" and x else x], TITLE if x.startswith("#") else PLAIN) for k, x in enumerate(report.split("\n"))]
        sheets.append(("LLM Report", _sheet(head + text)))
    return _package(sheets)


def _package(sheets: list[tuple[str, str]]) -> bytes:
    main, package = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    n = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, (name, _) in zip(n, sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{links}<Relationship Id="s" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles())
        for i, (_, sheet) in zip(n, sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet)
    return out.getvalue()


def write_json(df: DataFrame, path: str) -> None:
    """A report as lines of JSON."""
    df.write.mode("overwrite").json(path)
