"""Column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators.lineage import listed


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of a pattern; null if it, or the pattern, doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# --- classes ---


def classify_symbol(name: Column) -> Column:
    """Category of a class name by its first keyword in order; 'other' for none, null and ''."""
    lowered, out = F.lower(name), None
    for category, words in dims.KEYWORDS.items():
        for word in words:
            hit = F.contains(lowered, F.lit(word))
            out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(dims.OTHER)


def with_category(df: DataFrame, name: str, taxonomy: DataFrame | None = None, out: str = "category") -> DataFrame:
    """Adds the category: of the exact name in taxonomy (name, category), else of its letters and digits in lower
    case, else by keyword.  taxonomy is a list of classes, a few hundred rows."""
    if taxonomy is None:
        return df.withColumn(out, classify_symbol(F.col(name)))
    exact = listed(taxonomy.groupBy(F.col("name").alias("_name")).agg(F.min("category").alias("_exact")))
    loose = listed(taxonomy.groupBy(class_key(F.col("name")).alias("_key")).agg(F.min("category").alias("_loose")))
    joined = df.join(exact, F.col(name) == F.col("_name"), "left").join(loose, class_key(F.col(name)) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_exact", "_loose", classify_symbol(F.col(name)))).drop("_name", "_key", "_exact", "_loose")


def class_key(name: Column) -> Column:
    """Letters and digits of a class name in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def entity_type(category: Column) -> Column:
    return F.coalesce(lookup(dims.ENTITY_TYPES, category), F.lit("unknown"))


# --- tags ---

# What is put right in a tag, in order.
MISREAD = [(r"(?<=\d)O(?=\d|$)", "0"), (r"(?<=\d)I(?=\d|$)", "1"), (r"(?<=\d)l(?=\d|$)", "1"), (r"^[+\-./]+([A-Z])", "$1"), (r"([A-Z])\s+(\d)", "$1-$2")]


def normalised_tag(text: Column) -> Column:
    """Typical misreadings put right: O, I and l among digits, stray leading marks, spaces before a number."""
    t = strip(text)
    for pattern, new in MISREAD:
        t = F.regexp_replace(t, pattern, new)
    return t


# What the kinds of tags look like.
LINE = r'(?i)^(\d{1,2})["”]?\s*[-]?\s*([A-Z]{1,4})\s*[-]\s*(\d{3,5})\s*[-]?\s*([A-Z0-9]{1,4})?\s*[-]?\s*([A-Z])?$'
SPEC = r"(?i)^(\d{2,4})\s*#|^(CS|SS|A105|A106|A312|A234|ASTM)\s*\d*"
EQUIP = r"^([A-Z])([- ]?)(\d{1,5})\s*([A-Z](?:\s*/\s*[A-Z])?)?$"
INSTRUMENT = r"^([A-Z]{2,4})[- ]?(\d{1,5})([A-Z])?(?:\s*/\s*(\d{1,5}))?$"
LETTERS = r"^([A-Z]{2,4})$"
SINGLE = r"^([A-Z])([- ]?)(\d{1,5})$"
SIZE = r'^(\d{1,2}(?:/\d{1,2})?)\s*["”]$'
# The fields of a tag.
TAG_FIELDS = ["raw_text", "tag_type", "tag_id", "primary_variable", "function", "loop_number", "suffix", "equipment_type", "pipe_size", "pipe_spec", "service_code", "parsed_description"]


def parse_tag(text: Column) -> Column:
    return parse_normalised(normalised_tag(text))


def parse_normalised(t: Column) -> Column:
    """A struct of TAG_FIELDS.  Kinds are tried in order: line number, specification, equipment, instrument, pipe
    size; other text of over 3 characters is a description, the rest unknown.  Null text gives nulls."""
    upper = F.upper(t)
    null = F.lit(None).cast("string")

    def tag(kind, **fields):
        return F.struct(*[(t if f == "raw_text" else F.lit(kind) if f == "tag_type" else fields.get(f, null)).alias(f) for f in TAG_FIELDS])

    size, service, number, spec, insulation = (group(t, LINE, n) for n in range(1, 6))
    inch = F.concat(size, F.lit('"'))
    line = tag(
        "line_number", tag_id=F.concat_ws("-", inch, service, number, spec, insulation), pipe_size=inch, service_code=F.upper(service), loop_number=number, pipe_spec=spec,
        parsed_description=F.concat(inch, F.lit(" "), F.coalesce(lookup(dims.SERVICES, F.upper(service)), F.concat(F.lit("Service ("), service, F.lit(")"))), F.lit(" Line "), number),
    )
    specification = tag("specification", tag_id=t, pipe_spec=t, parsed_description=F.concat(F.lit("Specification: "), t))
    letter, e_number, e_suffix = group(upper, EQUIP, 1), group(upper, EQUIP, 3), F.replace(group(upper, EQUIP, 4), F.lit(" "), F.lit(""))
    kind = lookup(dims.EQUIPMENT_LETTERS, letter)
    equipment = tag("equipment_tag", tag_id=F.concat(letter, F.lit("-"), e_number, F.coalesce(e_suffix, F.lit(""))), equipment_type=kind, loop_number=e_number, suffix=e_suffix, parsed_description=kind)
    single = F.rlike(upper, F.lit(SINGLE))
    letters = F.coalesce(group(upper, INSTRUMENT, 1), group(upper, LETTERS, 1), group(upper, SINGLE, 1))
    i_number = F.coalesce(group(upper, INSTRUMENT, 2), group(upper, SINGLE, 3))
    i_suffix, second = group(upper, INSTRUMENT, 3), group(upper, INSTRUMENT, 4)
    variable = lookup(dims.VARIABLES, F.substring(letters, 1, 1))
    rest = F.filter(F.split(F.substring(letters, 2, 10), ""), lambda c: c != "")
    functions = F.transform(rest, lambda c: lookup(dims.FUNCTIONS, c))
    valid = variable.isNotNull() & F.forall(functions, lambda f: f.isNotNull()) & (~single | lookup(dims.EQUIPMENT_LETTERS, letters).isNull())
    function = F.nullif(F.array_join(functions, "/"), F.lit(""))
    instrument = tag(
        "instrument_tag", tag_id=F.concat(letters, F.coalesce(F.concat(F.lit("-"), i_number), F.lit("")), F.coalesce(i_suffix, F.lit("")), F.coalesce(F.concat(F.lit("/"), second), F.lit(""))),
        primary_variable=variable, function=function, loop_number=i_number, suffix=i_suffix, parsed_description=F.concat_ws(" ", variable, function),
    )
    p_size = group(t, SIZE, 1)
    return (
        F.when(F.rlike(t, F.lit(LINE)), line).when(F.rlike(t, F.lit(SPEC)), specification).when(kind.isNotNull(), equipment).when(F.coalesce(valid, F.lit(False)), instrument)
        .when(p_size.isNotNull(), tag("pipe_size", tag_id=t, pipe_size=F.concat(p_size, F.lit('"')), parsed_description=F.concat(p_size, F.lit(" inch pipe"))))
        .when(F.length(t) > 3, tag("description", tag_id=t, parsed_description=t)).when(t.isNotNull(), tag("unknown", tag_id=t))
    )


# Text that is noise.
NOISE = r"(?i)^[^a-zA-Z0-9]+$|^[oe]{1,3}$|^[ry]{1,2}$|^[&%@|><.]+$|^[\u0080-￿]+$"


def valid_text(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    useful = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\-_./() ]", ""))
    return F.when(n == 0, False).when((n <= 2) & F.rlike(t, F.lit(r"^\d+$")), True).when(n == 1, False).when(F.rlike(t, F.lit(NOISE)), False).when(~F.rlike(t, F.lit(r"[\p{L}\p{N}]")), False).otherwise(useful * 2 >= n)


# --- geometry ---


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def iou(a, b) -> Column:
    """Of two boxes with fields x1, y1, x2, y2: 0 without an intersection or area."""
    w, h = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def boxes_overlap(a, b) -> Column:
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def run_crosses_box(px, py, qx, qy, x1, y1, x2, y2, pad: float = 2.0) -> Column:
    """Whether a pipe that goes across from p, then down or up to q, meets the padded box."""
    a, b, c, d = x1 - pad, y1 - pad, x2 + pad, y2 + pad
    across = (py >= b) & (py <= d) & (F.greatest(px, qx) > a) & (F.least(px, qx) < c)
    down = F.when(py == qy, (py >= b) & (py <= d) & (qx > a) & (qx < c)).otherwise((qx >= a) & (qx <= c) & (F.greatest(py, qy) > b) & (F.least(py, qy) < d))
    return across | down


# Fixed values: (height, width, height / width) that shapes have on a sheet 650 wide, in order.
SHAPES = {"Centrifugal Pump": (14, 26, 14, 26, 0.75, 1.35), "Heat Exchanger": (30, 62, 20, 40, 0.85, 2.60), "Mixing Reactor": (52, 100, 22, 48, 1.20, 3.40), "Vertical Vessel": (95, 170, 20, 42, 2.40, 7.00), "Horizontal Vessel": (12, 42, 26, 85, 0.15, 1.10), "Gate_Valve": (12, 30, 9, 22, 0.80, 2.40), "Tank": (12, 28, 12, 28, 0.80, 1.30)}


def shape_class(w: Column, h: Column, sheet_width: float = 650.0) -> Column:
    """The first shape whose ranges (scaled to the sheet's width) hold the box; null for none."""
    k, out = sheet_width / 650.0, None
    for name, (h0, h1, w0, w1, a0, a1) in SHAPES.items():
        fits = h.between(h0 * k, h1 * k) & w.between(w0 * k, w1 * k) & (h / w).between(a0, a1)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def ocr_scale(width: Column, height: Column, scale: float = 3.0, longest: float = 6000.0) -> Column:
    """How much a sheet is enlarged for OCR: so that its longer side stays within the limit, but never shrunk."""
    side = F.greatest(width, height)
    return F.when(side <= 0, F.lit(scale)).otherwise(F.least(F.lit(scale), F.greatest(F.lit(1.0), F.lit(longest) / side)))


def display_scale(width: Column, height: Column, most: float = 1920.0) -> Column:
    """How much a sheet is shrunk to be shown."""
    return F.least(F.lit(1.0), F.lit(most) / F.greatest(width, height))


def debug_scale(width: Column, least: float = 1920.0) -> Column:
    """How much a narrow sheet is widened before its text is examined."""
    return F.greatest(F.lit(1.0), F.lit(least) / width)


def circle_class(w: Column, h: Column, ink: Column) -> Column:
    """Class of a circle by the share of ink in its box; null if the box is too small or large."""
    return F.when(w.between(11, 28) & h.between(11, 28), F.when(ink > 0.35, "Tank").otherwise("Centrifugal Pump"))


def axis_starts(extent: Column, tile: int = 1312, overlap: int = 128) -> Column:
    """Where tiles begin along an axis: as few as cover it, spaced evenly, halves rounded to even."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap: from 0 to under the tile")
    n = F.greatest(F.lit(2), F.ceil((extent - tile) / F.lit(float(tile - overlap))) + 1)
    step = (extent - tile) / (n - 1)
    many = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.rint(i * step).cast("long")))
    return F.when(extent <= tile, F.array(F.lit(0).cast("long"))).otherwise(many)


# --- scores, cells, reports ---


def confidence(det: Column, ocr: Column, has_tag: Column, has_text: Column) -> Column:
    p = F.when(has_tag, 0.9).when(has_text, 0.3).otherwise(0.0)
    return F.when(det.isNotNull() & ocr.isNotNull(), det * 0.4 + ocr * 0.35 + p * 0.25).when(det.isNotNull(), det * 0.6).when(ocr.isNotNull(), ocr * 0.5 + p * 0.2).otherwise(0.0)


def cell_text(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(r"^[=+\-@]")), F.concat(F.lit("'"), value)).otherwise(value)


def slug(value: Column, size: int = 60) -> Column:
    s = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    s = F.substring(F.regexp_replace(s, r"^[._-]+|[._-]+$", ""), 1, size)
    return F.when(s == "", "untitled").otherwise(s)


def pretty_type(category: Column) -> Column:
    return F.when(category == "valves", "Valve").when(category == "instruments", "Instrument").when(category == "piping", "Piping").otherwise(F.initcap(F.replace(category, F.lit("_"), F.lit(" "))))


def upload_name(name: Column) -> Column:
    """A client's file name for display: its last part, plain characters, 120 at most; 'upload' for nothing."""
    base = F.regexp_extract(F.regexp_replace(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/+$", ""), "[^/]*$", 0)
    base = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._ -]+", "_"), r"^[ .]+|[ .]+$", "")
    return F.when(base == "", "upload").otherwise(F.substring(base, 1, 120))


def may_call(configured: Column, given: Column) -> Column:
    """Whether a caller's key is accepted: any if none is configured, else that one."""
    return F.when(F.coalesce(configured, F.lit("")) == "", True).otherwise(F.coalesce(given == configured, F.lit(False)))


# How issues of a report begin, and where they tell their severity.
ISSUE = r"^\s*(?:[*_#>\s]*)?(\d+)[.)]\s+(.*)$"
SEVERITY = r"(?i)severity\s*[:=]\s*\**\s*(error|warning|info)\b"


def is_error(issue: Column) -> Column:
    return F.lower(F.regexp_extract(issue, SEVERITY, 1)) == "error"


# How files of a kind begin, in hexadecimal.
MAGIC = {"pdf": ["25504446"], "png": ["89504E470D0A1A0A"], "jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "tif": ["49492A00", "4D4D002A"], "tiff": ["49492A00", "4D4D002A"], "bmp": ["424D"]}


def upload_problem(name: Column, content: Column, most: int = 50 << 20) -> Column:
    """Why an upload is refused: 'suffix', 'empty', 'size' or 'content'; null if it's taken."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    right = F.lit(False)
    for kind, heads in MAGIC.items():
        for h in heads:
            right = right | ((suffix == kind) & F.startswith(head, F.lit(h)))
    return F.when(~suffix.isin(*MAGIC), "suffix").when(F.length(content) == 0, "empty").when(F.length(content) > most, "size").when(~right, "content")
