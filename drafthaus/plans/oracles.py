"""The same results in plain SQL, to hold the queries against."""

from __future__ import annotations

import json
from pathlib import Path
from types import SimpleNamespace

from ..sources.bridge import CLASSES, VIEWS

# The values are written out here and in the file, apart from those of the library, so that a wrong one shows.
_VALUES = json.loads((Path(__file__).parent / "oracle_values.json").read_text(encoding="utf-8"))
dims = SimpleNamespace(ENTITY_TYPES=_VALUES["entity_types"], CATEGORY_ORDER=_VALUES["category_order"], VARIABLES=_VALUES["variables"], FUNCTIONS=_VALUES["functions"], EQUIPMENT_LETTERS=_VALUES["equipment_letters"], SERVICES=_VALUES["services"], SAME_CLASS=_VALUES["same_class"], MISSPELT=_VALUES["misspelt"])
ISSUE = r"^\s*(?:[*_#>\s]*)?(\d+)[.)]\s+(.*)$"
SHAPES = {"Centrifugal Pump": (14, 26, 14, 26, 0.75, 1.35), "Heat Exchanger": (30, 62, 20, 40, 0.85, 2.60), "Mixing Reactor": (52, 100, 22, 48, 1.20, 3.40), "Vertical Vessel": (95, 170, 20, 42, 2.40, 7.00), "Horizontal Vessel": (12, 42, 26, 85, 0.15, 1.10), "Gate_Valve": (12, 30, 9, 22, 0.80, 2.40), "Tank": (12, 28, 12, 28, 0.80, 1.30)}


def _case(value: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _category(name: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({name}), '{w}') THEN '{c}'" for c, w in _VALUES["keywords"]) + " ELSE 'other' END"


_TYPE = lambda c: _case(c, dims.ENTITY_TYPES, "'unknown'")
_SHAPE = "CASE " + " ".join(f"WHEN h BETWEEN {a} AND {b} AND w BETWEEN {c} AND {d} AND h / w BETWEEN {e} AND {f} THEN '{n}'" for n, (a, b, c, d, e, f) in SHAPES.items()) + " END"
_R = lambda g: f"nullif(regexp_extract(t, '^(\\d{{1,2}})[\"”]?\\s*[-]?\\s*([A-Z]{{1,4}})\\s*[-]\\s*(\\d{{3,5}})\\s*[-]?\\s*([A-Z0-9]{{1,4}})?\\s*[-]?\\s*([A-Z])?$', {g}, 'i'), '')"
_E = lambda g: f"nullif(regexp_extract(upper(t), '^([A-Z])([- ]?)(\\d{{1,5}})\\s*([A-Z](?:\\s*/\\s*[A-Z])?)?$', {g}), '')"
_I = lambda g: f"nullif(regexp_extract(upper(t), '^([A-Z]{{2,4}})[- ]?(\\d{{1,5}})([A-Z])?(?:\\s*/\\s*(\\d{{1,5}}))?$', {g}), '')"
_FUNCTION = _case("c", dims.FUNCTIONS)

# No lookbehind here: a replaced letter is followed by a digit or the end, so replacing twice is the same.
CHAIN = {
    "n0": "SELECT *, trim(text) AS a FROM texts",
    "n1": r"SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '(\d)O(\d|$)', '\10\2', 'g'), '(\d)O(\d|$)', '\10\2', 'g'), '(\d)I(\d|$)', '\11\2', 'g'), '(\d)I(\d|$)', '\11\2', 'g'), '(\d)l(\d|$)', '\11\2', 'g'), '(\d)l(\d|$)', '\11\2', 'g') AS b FROM n0",
    "n2": r"SELECT *, regexp_replace(regexp_replace(b, '^[+\-./]+([A-Z])', '\1'), '([A-Z])\s+(\d)', '\1-\2', 'g') AS t FROM n1",
    "n3": f"""SELECT *, {_R(1)} AS l1, {_R(2)} AS l2, {_R(3)} AS l3, {_R(4)} AS l4, {_R(5)} AS l5, {_E(1)} AS e1, {_E(3)} AS e3, replace({_E(4)}, ' ', '') AS e4,
        coalesce({_I(1)}, nullif(regexp_extract(upper(t), '^([A-Z]{{2,4}})$', 1), ''), nullif(regexp_extract(upper(t), '^([A-Z])([- ]?)(\\d{{1,5}})$', 1), '')) AS i1,
        coalesce({_I(2)}, nullif(regexp_extract(upper(t), '^([A-Z])([- ]?)(\\d{{1,5}})$', 3), '')) AS i2, {_I(3)} AS i3, {_I(4)} AS i4,
        regexp_matches(t, '^(\\d{{2,4}})\\s*#|^(CS|SS|A105|A106|A312|A234|ASTM)\\s*\\d*', 'i') AS spec, nullif(regexp_extract(t, '^(\\d{{1,2}}(?:/\\d{{1,2}})?)\\s*["”]$', 1), '') AS sz FROM n2""",
    "n4": f"SELECT *, {_case('e1', dims.EQUIPMENT_LETTERS)} AS ek, {_case('left(i1, 1)', dims.VARIABLES)} AS iv, list_transform(string_split(substr(i1, 2), ''), lambda c: {_FUNCTION}) AS fs FROM n3",
    "n5": f"""SELECT *, CASE WHEN l1 IS NOT NULL THEN 'line_number' WHEN spec THEN 'specification' WHEN ek IS NOT NULL THEN 'equipment_tag'
        WHEN iv IS NOT NULL AND (CASE WHEN length(i1) = 1 THEN {_case('i1', dims.EQUIPMENT_LETTERS)} IS NULL ELSE len(list_filter(fs, lambda f: f IS NULL)) = 0 END) THEN 'instrument_tag'
        WHEN sz IS NOT NULL THEN 'pipe_size' WHEN length(t) > 3 THEN 'description' ELSE 'unknown' END AS tag_type, CASE WHEN length(i1) > 1 THEN list_aggregate(fs, 'string_agg', '/') END AS fn FROM n4""",
    "tags": f"""SELECT *, CASE tag_type WHEN 'line_number' THEN concat_ws('-', l1 || '"', l2, l3, l4, l5) WHEN 'equipment_tag' THEN concat(e1, '-', e3, e4) WHEN 'instrument_tag' THEN concat(i1, '-' || i2, i3, '/' || i4) ELSE t END AS tag_id,
        CASE tag_type WHEN 'line_number' THEN concat(l1, '" ', coalesce({_case('upper(l2)', dims.SERVICES)}, 'Service (' || l2 || ')'), ' Line ', l3) WHEN 'specification' THEN 'Specification: ' || t WHEN 'equipment_tag' THEN ek WHEN 'instrument_tag' THEN concat_ws(' ', iv, fn)
          WHEN 'pipe_size' THEN sz || ' inch pipe' WHEN 'description' THEN t END AS parsed_description,
        CASE tag_type WHEN 'line_number' THEN l3 WHEN 'equipment_tag' THEN e3 WHEN 'instrument_tag' THEN i2 END AS loop_number, CASE tag_type WHEN 'line_number' THEN l1 || '"' WHEN 'pipe_size' THEN sz || '"' END AS pipe_size,
        CASE tag_type WHEN 'line_number' THEN l4 WHEN 'specification' THEN t END AS pipe_spec FROM n5""",
    "cand": "SELECT s.doc_id, s.page, s.det_ord, x.text_ord, sqrt((s.cx - x.cx) * (s.cx - x.cx) + (s.cy - x.cy) * (s.cy - x.cy)) AS dist FROM symbols s JOIN texts x ON s.page = x.page WHERE sqrt((s.cx - x.cx) * (s.cx - x.cx) + (s.cy - x.cy) * (s.cy - x.cy)) <= 350",
    "m0": "SELECT doc_id, page, list({'d': dist, 'l': det_ord, 'r': text_ord} ORDER BY dist, det_ord, text_ord) AS c FROM cand GROUP BY doc_id, page",
    "m1": "SELECT doc_id, page, c, list_reduce(list_transform(c, lambda e: [e]), lambda m, e: CASE WHEN len(list_filter(m, lambda k: k.l = e[1].l OR k.r = e[1].r)) > 0 THEN m ELSE list_concat(m, e) END) AS m1 FROM m0",
    "m2": "SELECT doc_id, page, unnest(list_reduce(list_concat([m1], list_transform(c, lambda e: [e])), lambda m, e: CASE WHEN len(list_filter(m, lambda k: k.r = e[1].r)) > 0 OR len(list_filter(m, lambda k: k.l = e[1].l)) >= 3 THEN m ELSE list_concat(m, e) END)) AS k FROM m1",
    "given": "SELECT doc_id, page, k.l AS det_ord, k.r AS text_ord, k.d AS dist, row_number() OVER (PARTITION BY doc_id, page, k.l ORDER BY k.d, k.r) AS place FROM m2",
    "moved": "SELECT doc_id, page, det_ord, x1 + (det_ord % 7) * 2 AS x1, y1, x2 + (det_ord % 7) * 2 AS x2, y2 FROM dense",
    "meeting": """SELECT doc_id, page, l, r, CAST(both_ AS DOUBLE) / (whole - both_) AS v FROM (SELECT a.doc_id, a.page, a.det_ord AS l, b.det_ord AS r, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS whole,
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_ FROM dense a JOIN moved b ON a.doc_id = b.doc_id AND a.page = b.page) p WHERE both_ > 0 AND both_ >= 0.5 * (whole - both_)""",
    "matched": """SELECT doc_id, page, k.l AS l, k.r AS r, k.v AS v FROM (SELECT doc_id, page, unnest(list_reduce(list_transform(c, lambda e: [e]), lambda m, e: CASE WHEN len(list_filter(m, lambda k: k.l = e[1].l OR k.r = e[1].r)) > 0 THEN m ELSE list_concat(m, e) END)) AS k
        FROM (SELECT doc_id, page, list({'l': l, 'r': r, 'v': v} ORDER BY v DESC, l, r) AS c FROM meeting GROUP BY doc_id, page) a) b""",
    "labels": "SELECT g.*, t.confidence AS ocr, t.tag_type, t.tag_id, t.parsed_description, t.pipe_size, t.pipe_spec FROM given g JOIN tags t ON g.page = t.page AND g.text_ord = t.text_ord",
    "per": """SELECT page, det_ord, count(*) AS texts, avg(ocr) AS ocr, arg_min(tag_type, place) FILTER (WHERE tag_type IN ('instrument_tag', 'equipment_tag')) AS tag_type, arg_min(tag_id, place) FILTER (WHERE tag_type IN ('instrument_tag', 'equipment_tag')) AS tag_id,
        arg_min(parsed_description, place) FILTER (WHERE tag_type IN ('instrument_tag', 'equipment_tag')) AS description, arg_min(pipe_size, place) FILTER (WHERE tag_type = 'pipe_size') AS size, arg_min(pipe_spec, place) FILTER (WHERE tag_type = 'specification') AS specification FROM labels GROUP BY page, det_ord""",
    "every": f"""SELECT s.doc_id, s.page, 0 AS kind, s.det_ord AS ord, p.tag_id, CASE p.tag_type WHEN 'equipment_tag' THEN 'equipment' WHEN 'instrument_tag' THEN 'instruments' ELSE {_category('class_name')} END AS category, coalesce(p.description, class_name) AS description, p.size, p.specification, cx AS x, cy AS y, s.confidence AS det, p.ocr, coalesce(p.texts, 0) AS texts
        FROM symbols s LEFT JOIN per p ON s.page = p.page AND s.det_ord = p.det_ord
        UNION ALL SELECT t.doc_id, t.page, 1, t.text_ord, t.tag_id, CASE tag_type WHEN 'instrument_tag' THEN 'instruments' ELSE 'equipment' END, t.parsed_description, t.pipe_size, t.pipe_spec, t.cx, t.cy, NULL, t.confidence, 1 FROM tags t ANTI JOIN given g ON t.page = g.page AND t.text_ord = g.text_ord WHERE t.tag_type IN ('instrument_tag', 'equipment_tag')""",
    "ents": f"""SELECT *, {_TYPE('category')} AS entity_type, row_number() OVER (PARTITION BY doc_id ORDER BY page, kind, ord) AS node_ord,
        CASE WHEN det IS NOT NULL AND ocr IS NOT NULL THEN det * 0.4::DOUBLE + ocr * 0.35::DOUBLE + (CASE WHEN tag_id IS NOT NULL THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END) * 0.25::DOUBLE WHEN det IS NOT NULL THEN det * 0.6::DOUBLE ELSE ocr * 0.5::DOUBLE + (CASE WHEN tag_id IS NOT NULL THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END) * 0.2::DOUBLE END AS confidence FROM every""",
    "near": "SELECT a.doc_id, a.page, a.node_ord AS i, b.node_ord AS j, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS bty, a.entity_type AS ta, b.entity_type AS tb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM ents a JOIN ents b ON a.page = b.page AND a.node_ord < b.node_ord",
    "graph": """SELECT doc_id, page, CASE WHEN ax <= bx THEN i ELSE j END AS src, CASE WHEN ax <= bx THEN j ELSE i END AS dst, round_even(dist, 2) AS distance, round_even(dist / (CASE WHEN abs(ay - bty) < 30 THEN 1.5::DOUBLE WHEN abs(ax - bx) < 30 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END), 2) AS weight,
        CASE WHEN (ta = 'instrument' OR tb = 'instrument') AND dist < 80 THEN 'signal' ELSE 'piping' END AS connection_type FROM near WHERE dist <= 200""",
    "ends": "SELECT doc_id, src AS node, dst AS other FROM graph UNION ALL SELECT doc_id, dst, src FROM graph",
    "loop_members": "SELECT DISTINCT e.doc_id, e.node_ord, t.loop_number AS loop FROM ents e JOIN tagged t ON t.page = e.page AND t.kind = e.kind AND t.ord = e.ord WHERE e.entity_type = 'instrument' AND t.loop_number IS NOT NULL",
    "tagged": "SELECT g.page, 0 AS kind, g.det_ord AS ord, t.loop_number FROM given g JOIN tags t ON g.page = t.page AND g.text_ord = t.text_ord UNION ALL SELECT page, 1, text_ord, loop_number FROM tags",
    "loops": "SELECT *, row_number() OVER (PARTITION BY doc_id, loop ORDER BY node_ord) AS place, lead(node_ord) OVER (PARTITION BY doc_id, loop ORDER BY node_ord) AS dst FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, loop) AS size FROM loop_members) m WHERE size > 1",
}
_ID = "'E' || CASE WHEN length(node_ord::VARCHAR) < 4 THEN lpad(node_ord::VARCHAR, 4, '0') ELSE node_ord::VARCHAR END"
CHAIN |= {
    "lined": "SELECT e.doc_id, e.page, e.node_ord, e.x, n.line AS line_number FROM ents e LEFT JOIN (SELECT doc_id, node_ord, arg_min(tag_id, dist * 1000 + text_ord / 1000) AS line FROM (SELECT a.doc_id, a.node_ord, t.tag_id, t.text_ord, sqrt((a.x - t.cx) * (a.x - t.cx) + (a.y - t.cy) * (a.y - t.cy)) AS dist FROM ents a JOIN tags t ON a.page = t.page AND t.tag_type = 'line_number') d WHERE dist < 300 GROUP BY 1, 2) n ON n.doc_id = e.doc_id AND n.node_ord = e.node_ord",
    "new_edges": "SELECT DISTINCT l.doc_id, l.node_ord AS src, l.dst FROM loops l ANTI JOIN graph g ON g.doc_id = l.doc_id AND g.src = l.node_ord AND g.dst = l.dst WHERE l.dst IS NOT NULL",
    "all_ends": "SELECT doc_id, src AS node FROM graph UNION ALL SELECT doc_id, dst FROM graph UNION ALL SELECT doc_id, src FROM new_edges UNION ALL SELECT doc_id, dst FROM new_edges",
    "deg": f"SELECT e.*, {_ID} AS entity_id, coalesce(d.n, 0) AS degree FROM ents e LEFT JOIN (SELECT doc_id, node, count(*) AS n FROM all_ends GROUP BY 1, 2) d ON d.doc_id = e.doc_id AND d.node = e.node_ord",
    "memberships": "SELECT e.doc_id, e.node_ord, t.loop_number AS loop FROM ents e JOIN tagged t ON t.page = e.page AND t.kind = e.kind AND t.ord = e.ord WHERE e.entity_type = 'instrument' AND t.loop_number IS NOT NULL",
    "found": f"""SELECT doc_id, 'R001' AS rule_id, 'warning' AS severity, entity_id, upper(left(entity_type, 1)) || substr(entity_type, 2) || ' at position (' || x || ', ' || y || ') has no tag identifier.' AS message FROM deg WHERE entity_type IN ('instrument', 'equipment', 'valve') AND tag_id IS NULL
        UNION ALL SELECT doc_id, 'R002', 'error', arg_min(entity_id, node_ord), 'Duplicate tag ''' || tag_id || ''' found on ' || count(*) || ' entities: [' || string_agg('''' || entity_id || '''', ', ' ORDER BY node_ord) || ']' FROM deg WHERE tag_id IS NOT NULL GROUP BY doc_id, tag_id HAVING count(*) > 1
        UNION ALL SELECT m.doc_id, 'R003', 'info', {_ID}, 'Loop ' || loop || ' has only 1 instrument. Typical loops have 2-3 elements.' FROM (SELECT doc_id, loop, min(node_ord) AS node_ord FROM memberships GROUP BY 1, 2 HAVING count(*) = 1) m
        UNION ALL SELECT doc_id, 'R004', 'warning', entity_id, 'Low confidence (' || format('{{:.2f}}', confidence) || ') for entity ''' || coalesce(tag_id, description) || ''' at (' || x || ', ' || y || ').' FROM deg WHERE confidence < 0.5
        UNION ALL SELECT doc_id, 'R005', 'info', entity_id, 'Orphan ' || entity_type || ' ''' || coalesce(tag_id, 'None') || ''' has no connections.' FROM deg WHERE degree = 0 AND entity_type NOT IN ('line', 'unknown')
        UNION ALL SELECT doc_id, 'R006', 'warning', entity_id, 'Valve ''' || coalesce(tag_id, entity_id) || ''' has only ' || degree || ' connection(s). Valves typically have 2 (inlet + outlet).' FROM deg WHERE entity_type = 'valve' AND degree < 2""",
    "whole": "SELECT doc_id, src, dst FROM graph UNION ALL SELECT doc_id, src, dst FROM new_edges",
    "whole_ends": "SELECT doc_id, src AS node, dst AS other FROM whole UNION ALL SELECT doc_id, dst, src FROM whole",
    "pipes": "SELECT a.doc_id, a.page, a.det_ord AS run, a.cx AS px, a.cy AS py, b.cx AS qx, b.cy AS qy FROM symbols a JOIN symbols b ON a.page = b.page AND b.det_ord = a.det_ord + 1",
}
_OLD = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(["Back Pressure Regulator", "BackPressure Regulator", "bolier", "Boiler", "Gate_Valve", "Gate Valve", "Level Trasmitter", "Reformer", "reformer", "Ball_valve", "Ball Valve", "Pump", "Tee", "Elbow", "Cap", "Drum", "Fan", "Motor"])) + ") o(id, name)"
_NEW = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CLASSES)) + ") c(id, name)"
_SAME = {m: g[0] for g in dims.SAME_CLASS for m in g}
_MERGED = f"(SELECT name, row_number() OVER (ORDER BY o, id) - 1 AS new_id FROM (SELECT name, min(o) AS o, arg_min(id, o * 1000 + id) AS id FROM (SELECT name, 0 AS o, id FROM {_NEW} UNION ALL SELECT name, 1, id FROM {_OLD}) u WHERE name <> 'Tee' GROUP BY name) g)"

FINAL = {
    "tag_parse": """SELECT doc_id, page, text_ord, t AS raw_text, tag_type, tag_id, CASE tag_type WHEN 'instrument_tag' THEN iv END AS primary_variable, CASE tag_type WHEN 'instrument_tag' THEN fn END AS function, loop_number, CASE tag_type WHEN 'equipment_tag' THEN e4 WHEN 'instrument_tag' THEN i3 END AS suffix,
        CASE tag_type WHEN 'equipment_tag' THEN ek END AS equipment_type, pipe_size, pipe_spec, CASE tag_type WHEN 'line_number' THEN upper(l2) END AS service_code, parsed_description FROM tags""",
    "tag_type_counts": "SELECT tag_type, count(*) AS n FROM tags GROUP BY 1",
    "ocr_text_valid": r"""SELECT doc_id, page, text_ord, CASE WHEN length(trim(text)) = 0 THEN false WHEN length(trim(text)) <= 2 AND regexp_matches(trim(text), '^\d+$') THEN true WHEN length(trim(text)) = 1 THEN false WHEN regexp_matches(trim(text), '^[^a-zA-Z0-9]+$|^[oe]{1,3}$|^[ry]{1,2}$', 'i') THEN false
        ELSE length(regexp_replace(trim(text), '[^a-zA-Z0-9\-_./() ]', '', 'g')) * 2 >= length(trim(text)) END AS valid FROM texts""",
    "symbol_classify": f"SELECT class_name, {_category('class_name')} AS category, {_TYPE(_category('class_name'))} AS entity_type FROM (SELECT DISTINCT class_name FROM symbols) s",
    "class_coverage": f"SELECT category, count(*) AS n, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE category = 'other'), '') AS unmapped, (sum(count(*)) OVER ())::BIGINT AS total, round_even((sum(count(*)) OVER () - sum(count(*) FILTER (WHERE category = 'other')) OVER ()) / sum(count(*)) OVER () * 100, 1) AS coverage FROM (SELECT name, {_category('name')} AS category FROM (SELECT name FROM {_OLD} UNION ALL SELECT name FROM {_NEW}) n) k GROUP BY 1",
    "blob_filter": "SELECT doc_id, page, blob_ord FROM blobs WHERE h BETWEEN 12 AND 130 AND w BETWEEN 5 AND 700 AND area >= 30 AND w / h BETWEEN 0.15 AND 12 AND area / (w * h) BETWEEN 0.08 AND 0.90",
    "word_groups": """SELECT doc_id, page, isl AS island, count(*) AS blobs, greatest(0, min(x) - 4) AS x, greatest(0, min(y) - 4) AS y, max(x + w) - min(x) + 8 AS w, max(y + h) - min(y) + 8 AS h FROM (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY x, blob_ord)::BIGINT - 1 AS isl FROM (
        SELECT *, CASE WHEN x - (lag(x) OVER p + lag(w) OVER p) <= (h + lag(h) OVER p) / 2 * 1.8 AND least(y + h, lag(y) OVER p + lag(h) OVER p) - greatest(y, lag(y) OVER p) >= least(h, lag(h) OVER p) * 0.4 THEN 0 ELSE 1 END AS f
        FROM blobs WHERE h BETWEEN 12 AND 130 AND w BETWEEN 5 AND 700 AND area >= 30 AND w / h BETWEEN 0.15 AND 12 AND area / (w * h) BETWEEN 0.08 AND 0.90 WINDOW p AS (PARTITION BY page ORDER BY x, blob_ord)) a) b GROUP BY doc_id, page, isl""",
    "fragment_merge": """SELECT doc_id, page, isl AS island, string_agg(text, '' ORDER BY cx, text_ord) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY cx, text_ord)::BIGINT - 1 AS isl FROM (
        SELECT *, CASE WHEN x1 - lag(x2) OVER p < (h + lag(h) OVER p) / 2 * 2.5 AND abs(cy - lag(cy) OVER p) < (h + lag(h) OVER p) / 2 * 0.7 THEN 0 ELSE 1 END AS f FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM words) w WINDOW p AS (PARTITION BY page ORDER BY cx, text_ord)) a) b GROUP BY doc_id, page, isl""",
    "ocr_dedup": "SELECT doc_id, page, text_ord FROM (SELECT *, row_number() OVER (PARTITION BY page, lower(text), floor((x1 + x2) / 20), floor((y1 + y2) / 20) ORDER BY text_ord) AS n FROM words WHERE confidence >= 0.2 AND x2 - x1 >= 3 AND y2 - y1 >= 3 AND text <> '|') q WHERE n = 1",
    "nms": """SELECT doc_id, page, k.o AS det_ord, k.n AS rank FROM (SELECT doc_id, page, unnest(list_transform(m, lambda e, i: {'o': e.o, 'n': i - 1})) AS k FROM (SELECT doc_id, page, list_reduce(list_transform(c, lambda e: [e]), lambda m, e: CASE WHEN len(list_filter(m, lambda k: (CASE WHEN least(k.x2, e[1].x2) > greatest(k.x1, e[1].x1) AND least(k.y2, e[1].y2) > greatest(k.y1, e[1].y1)
        THEN (least(k.x2, e[1].x2) - greatest(k.x1, e[1].x1)) * (least(k.y2, e[1].y2) - greatest(k.y1, e[1].y1)) / ((k.x2 - k.x1) * (k.y2 - k.y1) + (e[1].x2 - e[1].x1) * (e[1].y2 - e[1].y1) - (least(k.x2, e[1].x2) - greatest(k.x1, e[1].x1)) * (least(k.y2, e[1].y2) - greatest(k.y1, e[1].y1))) ELSE 0 END) > 0.45)) > 0 THEN m ELSE list_concat(m, e) END) AS m
        FROM (SELECT doc_id, page, list({'o': det_ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY confidence DESC, det_ord) AS c FROM dense GROUP BY doc_id, page) a) b) d""",
    "detection_summary": "SELECT class_name, n, avg_confidence, row_number() OVER (ORDER BY n DESC, f) AS rank FROM (SELECT class_name, count(*) AS n, round_even(avg(confidence), 4) AS avg_confidence, min(doc_id * 1000000000 + page * 10000 + det_ord) AS f FROM symbols GROUP BY 1) s",
    "label_candidates": "SELECT doc_id, page, count(*) AS n, max(dist) AS far FROM cand GROUP BY 1, 2",
    "label_assignment": "SELECT doc_id, page, det_ord, text_ord, dist, place FROM given",
    "unassigned_text": "SELECT t.doc_id, t.page, t.text_ord FROM texts t ANTI JOIN given g ON t.page = g.page AND t.text_ord = g.text_ord",
    "entities": f"SELECT doc_id, page, {_ID} AS entity_id, tag_id, entity_type, category, description, size, specification, confidence, confidence < 0.6 AS needs_review FROM ents",
    "confidence_stats": "SELECT doc_id, count(*) AS total, round_even(avg(confidence), 3) AS avg_confidence, round_even(min(confidence), 3) AS min_confidence, round_even(max(confidence), 3) AS max_confidence, count(*) FILTER (WHERE confidence < 0.6) AS low, count(*) FILTER (WHERE confidence < 0.6) AS needs_review, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.8) AS medium FROM ents GROUP BY 1",
    "edges": "SELECT * FROM graph",
    "degree": f"SELECT e.doc_id, {_ID} AS entity_id, count(d.n) AS degree FROM ents e LEFT JOIN (SELECT doc_id, node, 1 AS n FROM ends) d ON e.doc_id = d.doc_id AND e.node_ord = d.node GROUP BY 1, 2",
    "neighbors": "SELECT doc_id, node, count(*) AS n, min(other) AS first FROM ends GROUP BY 1, 2",
    "two_hops": "SELECT doc_id, node, count(DISTINCT other) AS n FROM (SELECT doc_id, node, other FROM ends UNION ALL SELECT a.doc_id, a.node, b.other FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.other = b.node WHERE b.other <> a.node) h GROUP BY 1, 2",
    "components": "SELECT e.doc_id, e.node_ord AS node, min(r.y) AS component FROM ents e JOIN reach r ON r.doc_id = e.doc_id AND r.x = e.node_ord GROUP BY 1, 2",
    "instrument_loops": "SELECT doc_id, loop, node_ord, place FROM loops",
    "loop_edges": "SELECT DISTINCT l.doc_id, l.node_ord AS src, l.dst, 50.0::DOUBLE AS weight FROM loops l ANTI JOIN graph g ON g.doc_id = l.doc_id AND g.src = l.node_ord AND g.dst = l.dst WHERE l.dst IS NOT NULL",
    "entity_table": "SELECT doc_id, " + _ID + """ AS entity_id, coalesce(tag_id, '—') AS tag_id, CASE entity_type WHEN 'piping_component' THEN 'Piping Component' ELSE upper(left(entity_type, 1)) || substr(entity_type, 2) END AS type, upper(left(category, 1)) || substr(category, 2) AS category, description, round(confidence * 100)::INT::VARCHAR || '%' AS confidence FROM ents""",
    "mto_rows": """SELECT doc_id, category, description, CASE WHEN size = '' THEN '—' ELSE size END AS size, CASE WHEN specification = '' THEN '—' ELSE specification END AS specification, count(*) AS quantity, coalesce(string_agg(tag_id, ', ' ORDER BY tag_id, node_ord), '—') AS tag_id, '—' AS line_number,
        CASE category WHEN 'valves' THEN 'Valve' WHEN 'instruments' THEN 'Instrument' WHEN 'piping' THEN 'Piping' WHEN 'equipment' THEN 'Equipment' ELSE 'Other' END AS entity_type, round_even(avg(confidence), 4) AS confidence, CASE WHEN avg(confidence) < 0.6 THEN '⚠ Low confidence — needs review' WHEN count(tag_id) = 0 THEN 'Tag not identified' ELSE '' END AS notes
        FROM (SELECT doc_id, node_ord, category, description, coalesce(size, '') AS size, coalesce(specification, '') AS specification, tag_id, confidence FROM ents) e GROUP BY doc_id, category, description, e.size, e.specification""",
    "mto_category_totals": "SELECT doc_id, coalesce(category, 'TOTAL') AS category, count(*) AS n FROM ents GROUP BY GROUPING SETS ((doc_id, category), (doc_id))",
    "prompt_topk": f"SELECT doc_id, entity_type, {_ID} AS entity_id, greatest(0, c - 10) AS more FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY node_ord) AS k, count(*) OVER (PARTITION BY doc_id, entity_type) AS c FROM ents) e WHERE k <= 10",
    "cell_sanitize_slug": r"SELECT text, CASE WHEN regexp_matches(text, '^[=+\-@]') THEN '''' || text ELSE text END AS cell, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT text, left(regexp_replace(regexp_replace(trim(text), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 60) AS s FROM (SELECT DISTINCT text FROM texts) d) e",
    "content_dedup": "SELECT split, name, digest FROM (SELECT *, md5(content) AS digest, row_number() OVER (PARTITION BY md5(content) ORDER BY list_position(['train', 'valid', 'test'], split), name) AS n FROM images) i WHERE n = 1",
    "split_sizes": "SELECT split, n FROM (SELECT unnest([{'split': 'train', 'n': t}, {'split': 'valid', 'n': v}, {'split': 'test', 'n': n - t - v}], recursive := true) FROM (SELECT n, greatest(1, floor(n * 0.8))::BIGINT AS t, greatest(1, floor(n * 0.1))::BIGINT AS v FROM (SELECT count(DISTINCT md5(content)) AS n FROM images) a) b) c",
    "split_leakage": "SELECT md5(content) AS digest, count(DISTINCT split) AS splits, count(*) AS copies FROM images GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "class_canonical": f"SELECT id::BIGINT AS id, name, canonical, dense_rank() OVER (ORDER BY f) - 1 AS new_id FROM (SELECT *, min(id) OVER (PARTITION BY canonical) AS f FROM (SELECT id, name, coalesce({_case('g', dims.MISSPELT)}, g) AS canonical FROM (SELECT id, name, coalesce({_case('name', _SAME)}, name) AS g FROM {_OLD}) a) b) c",
    "class_merge": f"SELECT new_id, name FROM {_MERGED} m",
    "label_remap": f"SELECT b.image, b.ord, m.new_id AS cid FROM boxes b JOIN {_OLD} ON b.cid = o.id JOIN {_MERGED} m ON m.name = o.name",
    "class_instances": f"SELECT coalesce(o.name, '') AS name, count(*) AS instances, count(*) < 20 AS rare FROM boxes b LEFT JOIN {_OLD} ON b.cid = o.id GROUP BY 1",
    "eval_f1": "SELECT cid, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT cid, count(*) FILTER (WHERE ord % 4 <> 0) / count(*) AS precision, count(*) FILTER (WHERE ord % 5 <> 0) / count(*) AS recall FROM boxes GROUP BY 1) m",
    "shape_classify": f"SELECT doc_id, page, det_ord, {_SHAPE} AS shape FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM symbols) s",
    "annotate_reject": "SELECT doc_id, page, k.o AS det_ord FROM (SELECT doc_id, page, unnest(list_reduce(list_transform(c, lambda e: [e]), lambda m, e: CASE WHEN len(list_filter(m, lambda k: k.x1 < e[1].x2 AND e[1].x1 < k.x2 AND k.y1 < e[1].y2 AND e[1].y1 < k.y2)) > 0 THEN m ELSE list_concat(m, e) END)) AS k FROM (SELECT doc_id, page, list({'o': det_ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY det_ord) AS c FROM dense GROUP BY doc_id, page) a) b",
    "issue_lines": f"SELECT id, isl AS issue, string_agg(line, ' ' ORDER BY ln) AS text, lower(regexp_extract(string_agg(line, ' ' ORDER BY ln), 'severity\\s*[:=]\\s*\\**\\s*(error|warning|info)\\b', 1, 'i')) = 'error' AS error FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '{ISSUE}') OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ln)::BIGINT AS isl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ln) AS k FROM (SELECT id, trim(u) AS line, ln FROM (SELECT id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM reports) a) b WHERE line <> '') c) d GROUP BY id, isl",
    "issue_verdict": "SELECT id, NOT (text LIKE '%Severity: error%') AS passed FROM reports",
    "line_assignment": "SELECT doc_id, node_ord, line_number FROM lined",
    "tile_grid": "SELECT s.sheet, r.k AS row, c.k AS col, c.v AS x, r.v AS y, c.v > 0 AS cut_left, r.v > 0 AS cut_top, c.v + least(1312, s.width - c.v) < s.width AS cut_right, r.v + least(1312, s.height - r.v) < s.height AS cut_bottom FROM sheets s JOIN (SELECT sheet, i AS k, CASE WHEN height <= 1312 THEN 0 ELSE round_even(i * ((height - 1312) / (n - 1)), 0) END::BIGINT AS v FROM (SELECT sheet, height, n, unnest(range(0, n)) AS i FROM (SELECT sheet, height, CASE WHEN height <= 1312 THEN 1 ELSE greatest(2, ceil((height - 1312) / 1184.0::DOUBLE) + 1) END::BIGINT AS n FROM sheets) a) b) r ON r.sheet = s.sheet JOIN (SELECT sheet, i AS k, CASE WHEN width <= 1312 THEN 0 ELSE round_even(i * ((width - 1312) / (n - 1)), 0) END::BIGINT AS v FROM (SELECT sheet, width, n, unnest(range(0, n)) AS i FROM (SELECT sheet, width, CASE WHEN width <= 1312 THEN 1 ELSE greatest(2, ceil((width - 1312) / 1184.0::DOUBLE) + 1) END::BIGINT AS n FROM sheets) a) b) c ON c.sheet = s.sheet",
    "flow_order": "SELECT doc_id, node_ord, line_number, row_number() OVER (PARTITION BY doc_id, line_number ORDER BY x, node_ord) - 1 AS flow_order FROM lined WHERE line_number IS NOT NULL",
    "line_strengthen": "SELECT g.doc_id, g.src, g.dst, g.weight * 0.5::DOUBLE AS weight, a.line_number FROM graph g JOIN lined a ON a.doc_id = g.doc_id AND a.node_ord = g.src JOIN lined b ON b.doc_id = g.doc_id AND b.node_ord = g.dst WHERE a.line_number = b.line_number",
    "graph_summary": "SELECT n.*, coalesce(d.edges, 0) AS edges, c.components, c.components = 1 AS connected FROM (SELECT doc_id, count(*) AS nodes, " + ", ".join(f"count(*) FILTER (WHERE category = '{k}') AS {k}" for k in dims.CATEGORY_ORDER) + " FROM ents GROUP BY 1) n LEFT JOIN (SELECT doc_id, count(*) AS edges FROM whole GROUP BY 1) d ON d.doc_id = n.doc_id JOIN (SELECT doc_id, count(DISTINCT component) AS components FROM (SELECT e.doc_id, e.node_ord, min(r.y) AS component FROM ents e JOIN reach r ON r.doc_id = e.doc_id AND r.x = e.node_ord GROUP BY 1, 2) m GROUP BY 1) c ON c.doc_id = n.doc_id",
    "rule_issues": "SELECT * FROM found",
    "rule_summary": "SELECT n.*, coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings, round_even((entities - coalesce(bad, 0)) / entities * 100, 1) AS pass_rate FROM (SELECT doc_id, count(*) AS entities, count(tag_id) AS tagged FROM ents GROUP BY 1) n LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(DISTINCT entity_id) FILTER (WHERE severity = 'error') AS bad FROM found GROUP BY 1) f ON f.doc_id = n.doc_id",
    "class_compat": f"SELECT CASE WHEN a = b THEN 'identical' WHEN list_sort(a) = list_sort(b) THEN 'order' ELSE 'vocabulary' END AS verdict, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))[1:10], ',') AS only_in_model, array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x))))[1:10], ',') AS only_in_dataset FROM (SELECT (SELECT list(name ORDER BY id) FROM {_NEW}) AS a, (SELECT list(name ORDER BY id) FROM {_OLD}) AS b) n",
    "pipe_crossings": "SELECT r.doc_id, r.page, r.run FROM pipes r ANTI JOIN symbols o ON o.page = r.page AND o.det_ord <> r.run AND o.det_ord <> r.run + 1 AND ((r.py BETWEEN o.y1 - 2 AND o.y2 + 2 AND greatest(r.px, r.qx) > o.x1 - 2 AND least(r.px, r.qx) < o.x2 + 2) OR (CASE WHEN r.py = r.qy THEN r.py BETWEEN o.y1 - 2 AND o.y2 + 2 AND r.qx > o.x1 - 2 AND r.qx < o.x2 + 2 ELSE r.qx BETWEEN o.x1 - 2 AND o.x2 + 2 AND greatest(r.py, r.qy) > o.y1 - 2 AND least(r.py, r.qy) < o.y2 + 2 END))",
    "jobs_expired": "SELECT id, status FROM jobs WHERE created_at < TIMESTAMP '2024-01-14'",
}
FINAL["mto_numbered"] = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({dims.CATEGORY_ORDER}, category), description NULLS FIRST, tag_id, size, specification) AS item_no, category, description, size, specification, quantity FROM ({FINAL['mto_rows']}) r"
_REACH = "reach AS (SELECT doc_id, node_ord AS x, node_ord AS y FROM ents UNION SELECT r.doc_id, r.x, e.other FROM reach r JOIN whole_ends e ON e.doc_id = r.doc_id AND e.node = r.y)"

_TAX = [("Gate Valve", "equipment"), ("ball valve", "instruments"), ("Panel Note", "piping"), ("UNKNOWN-THING", "valves"), ("Tee", "other")]
_EXACT = "CASE name " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in _TAX) + " END"
_LOOSE = "CASE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') " + " ".join(f"WHEN '{''.join(ch for ch in n.lower() if ch.isalnum())}' THEN '{c}'" for n, c in _TAX) + " END"
_TILES = FINAL["tile_grid"]
_CLIP = lambda v, o, most: f"greatest(0.0, least({v} + t.{o}, t.{most}))::DOUBLE"
_J = lambda k, v: f"CASE WHEN {v} IS NOT NULL THEN '\"{k}\":' || to_json({v})::VARCHAR END"
_D = "confidence::VARCHAR::DECIMAL(30, 20) * 10000"
_ROUNDED = f"(CASE WHEN {_D} - floor({_D}) = 0.5 AND floor({_D})::BIGINT % 2 = 0 THEN floor({_D}) ELSE round({_D}) END / 10000)::DOUBLE"  # of the number as written, halves to even
_BASE = "regexp_extract(regexp_replace(replace(coalesce(url, ''), '\\', '/'), '/+$', ''), '[^/]*$')"
_MEET = "FROM words w JOIN blobs b ON b.page = w.page AND b.x < w.x2 AND w.x1 < b.x + b.w AND b.y < w.y2 AND w.y1 < b.y + b.h WHERE w.x2 > w.x1 AND w.y2 > w.y1"
CHAIN |= {
    "precisions": "SELECT cid AS id, count(*) FILTER (WHERE ord % 4 <> 0) / count(*) AS precision FROM boxes WHERE cid < 15 GROUP BY 1",
    "old_names": f"SELECT id, name FROM {_OLD}",
}
FINAL |= {
    "tile_merge_clip_cut": f"SELECT sheet, row, col, i AS det_ord, x1, y1, x2, y2 FROM (SELECT t.*, i, {_CLIP('a', 'x', 'width')} AS x1, {_CLIP('i * 217.0', 'y', 'height')} AS y1, {_CLIP('a + 63', 'x', 'width')} AS x2, {_CLIP('i * 217.0 + 40', 'y', 'height')} AS y2 FROM (SELECT g.*, s.width, s.height FROM ({_TILES}) g JOIN sheets s ON s.sheet = g.sheet) t, (SELECT i, CASE WHEN i < 4 THEN i * 433 - 3 ELSE i * 3 - 11 END AS a FROM (SELECT unnest(range(8)) AS i) r) d) t WHERE x2 > x1 AND y2 > y1 AND NOT (cut_left AND x1 - x <= 6) AND NOT (cut_top AND y1 - y <= 6) AND NOT (cut_right AND x + least(1312, width - x) - x2 <= 6) AND NOT (cut_bottom AND y + least(1312, height - y) - y2 <= 6)",
    "covered_words": f"SELECT doc_id, page, text_ord, count(*) AS cover FROM (SELECT DISTINCT doc_id, page, text_ord, size, px, unnest(range(c, d)) AS py FROM (SELECT w.doc_id, w.page, w.text_ord, (w.x2 - w.x1) * (w.y2 - w.y1) AS size, unnest(range(greatest(b.x, w.x1)::BIGINT, least(b.x + b.w, w.x2)::BIGINT)) AS px, greatest(b.y, w.y1)::BIGINT AS c, least(b.y + b.h, w.y2)::BIGINT AS d {_MEET}) p) q GROUP BY doc_id, page, text_ord, size HAVING count(*) >= 25 / 255.0::DOUBLE * size",
    "entity_json": f"SELECT doc_id, {_ID} AS entity_id, '{{' || concat_ws(',', {_J('entity_id', _ID)}, {_J('tag_id', 'tag_id')}, {_J('entity_type', 'entity_type')}, {_J('description', 'description')}, {_J('component_category', 'category')}, {_J('size', 'size')}, {_J('specification', 'specification')}, '\"confidence\":' || {_ROUNDED}, '\"text_count\":' || texts) || '}}' AS json FROM ents",
    "class_map": f"SELECT name, coalesce({_EXACT}, {_LOOSE}, {_category('name')}) AS category, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM (SELECT DISTINCT name FROM (SELECT name FROM {_OLD} UNION ALL SELECT name FROM {_NEW}) n) k",
    "sheet_scales": "SELECT sheet, CASE WHEN m <= 0 THEN 3.0 ELSE least(3.0, greatest(1.0, 6000 / m)) END::DOUBLE AS ocr, least(1.0, 1920 / m)::DOUBLE AS display, greatest(1.0, 1920 / width)::DOUBLE AS debug FROM (SELECT *, greatest(width, height)::DOUBLE AS m FROM sheets) s",
    "ocr_rescale": "SELECT doc_id, page, text_ord, x1 / 2 AS x1, y1 / 2 AS y1, x2 / 2 AS x2, y2 / 2 AS y2, (x1 + x2) / 4 AS cx, (y1 + y2) / 4 AS cy FROM words",
    "entity_filters": "SELECT doc_id, node_ord FROM ents WHERE entity_type = 'instrument' AND category = 'instruments'",
    "annotator_components": "SELECT doc_id, page, blob_ord FROM blobs WHERE w >= 8 AND h >= 8 AND area >= 30 AND h / w >= 0.12 AND h / w <= 9 AND NOT (h < 12 AND w > 22)",
    "tall_symbols": "SELECT doc_id, page, blob_ord FROM (SELECT doc_id, page, blob_ord, h * 3 AS h, w, area FROM blobs) b WHERE h >= 60 AND w <= 60 AND area >= 200 AND h / greatest(1, w) >= 2",
    "circle_class": "SELECT doc_id, page, blob_ord, CASE WHEN w >= 11 AND w <= 28 AND h >= 11 AND h <= 28 THEN CASE WHEN area / (w * h) > 0.35 THEN 'Tank' ELSE 'Centrifugal Pump' END END AS class FROM blobs",
    "confident_detections": "SELECT doc_id, page, text_ord FROM words WHERE confidence >= 0.5",
    "box_properties": "SELECT doc_id, page, det_ord, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM symbols",
    "best_reading": "SELECT doc_id, page, crop, arg_min(text, rank) AS text, max(confidence) AS confidence FROM (SELECT doc_id, page, text_ord // 3 AS crop, text, confidence, row_number() OVER (PARTITION BY page, text_ord // 3 ORDER BY confidence DESC, text_ord) AS rank FROM words) w GROUP BY 1, 2, 3",
    "page_counts": "SELECT doc_id, page, sum(d)::BIGINT AS detections, sum(t)::BIGINT AS text_regions, sum(e)::BIGINT AS entities FROM (SELECT doc_id, page, 1 AS d, 0 AS t, 0 AS e FROM symbols UNION ALL SELECT doc_id, page, 0, 1, 0 FROM texts UNION ALL SELECT doc_id, page, 0, 0, 1 FROM ents) u GROUP BY 1, 2",
    "run_summary": "SELECT p.doc_id, pages, total_detections, total_text_regions, coalesce(c.n, 0) AS total_entities, c.a AS avg_confidence, coalesce(g.n, 0) AS total_edges FROM (SELECT doc_id, count(DISTINCT page) AS pages, sum(d)::BIGINT AS total_detections, sum(t)::BIGINT AS total_text_regions FROM (SELECT doc_id, page, 1 AS d, 0 AS t FROM symbols UNION ALL SELECT doc_id, page, 0, 1 FROM texts) u GROUP BY 1) p LEFT JOIN (SELECT doc_id, count(*) AS n, round_even(avg(confidence), 3) AS a FROM ents GROUP BY 1) c ON c.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM whole GROUP BY 1) g ON g.doc_id = p.doc_id",
    "mean_confidence": f"SELECT doc_id, {_ID} AS entity_id, round((coalesce(det, 0) + coalesce(ocr, 0) + CASE WHEN tag_id IS NOT NULL THEN 0.9::DOUBLE ELSE 0 END) / ((det IS NOT NULL)::INT + (ocr IS NOT NULL)::INT + (tag_id IS NOT NULL)::INT), 6) AS mean_confidence FROM ents",
    "loop_functions": "SELECT doc_id, loop, string_agg(DISTINCT f, ',' ORDER BY f) AS functions FROM (SELECT e.doc_id, t.loop_number AS loop, unnest(string_split(t.fn, '/')) AS f FROM ents e JOIN (SELECT g.page, 0 AS kind, g.det_ord AS ord, t.loop_number, CASE WHEN t.tag_type = 'instrument_tag' THEN t.fn END AS fn FROM given g JOIN tags t ON g.page = t.page AND g.text_ord = t.text_ord UNION ALL SELECT page, 1, text_ord, loop_number, CASE WHEN tag_type = 'instrument_tag' THEN fn END FROM tags) t ON t.page = e.page AND t.kind = e.kind AND t.ord = e.ord WHERE e.entity_type = 'instrument' AND t.loop_number IS NOT NULL) f GROUP BY 1, 2",
    "node_loops": "SELECT doc_id, node_ord, 'LOOP-' || arg_max(loop, begun * 1000000 + loop::BIGINT) AS instrument_loop FROM (SELECT *, min(node_ord) OVER (PARTITION BY doc_id, loop) AS begun FROM loops) l GROUP BY 1, 2",
    "highlighted_nodes": "SELECT DISTINCT doc_id, node FROM (SELECT doc_id, src AS node FROM graph WHERE connection_type = 'signal' UNION ALL SELECT doc_id, dst FROM graph WHERE connection_type = 'signal') g",
    "fallback_report": "SELECT d.doc_id, coalesce(f.errors, 0) AS errors, coalesce(f.warnings, 0) AS warnings, coalesce(f.total, 0) AS total, coalesce(f.errors, 0) = 0 AS passed FROM (SELECT DISTINCT doc_id FROM ents) d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) AS total FROM found GROUP BY 1) f ON f.doc_id = d.doc_id",
    "prompt_summary": """SELECT doc_id, string_agg(part, chr(10) ORDER BY begun) AS text FROM (SELECT doc_id, min(node_ord) AS begun, chr(10) || '### ' || array_to_string(list_transform(string_split(entity_type, '_'), lambda w: upper(w[1]) || w[2:]), '_') || ' (' || max(c) || ' items)' || chr(10)
        || string_agg('  - ' || coalesce(tag_id, 'None') || ': ' || coalesce(description, 'null') || ' (confidence: ' || printf('%.2f', confidence) || ')', chr(10) ORDER BY k) || CASE WHEN max(c) > 10 THEN chr(10) || '  ... and ' || (max(c) - 10) || ' more' ELSE '' END AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY node_ord) AS k, count(*) OVER (PARTITION BY doc_id, entity_type) AS c FROM ents) e WHERE k <= 10 GROUP BY doc_id, entity_type) t GROUP BY doc_id""",
    "prompt_issues": "SELECT doc_id, string_agg(k || '. [' || upper(severity) || '] ' || message, chr(10) ORDER BY k) || CASE WHEN max(c) > 15 THEN chr(10) || '... and ' || (max(c) - 15) || ' more issues' ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_id, entity_id, message) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM found) f WHERE k <= 15 GROUP BY doc_id",
    "ranked_classes": f"SELECT 'worst' AS status, k AS rank, id, name FROM (SELECT m.id, n.name, row_number() OVER (ORDER BY precision, m.id) AS k FROM precisions m LEFT JOIN old_names n ON n.id = m.id) w WHERE k <= 3 UNION ALL SELECT 'best', k, id, name FROM (SELECT m.id, n.name, row_number() OVER (ORDER BY precision DESC, m.id DESC) AS k FROM precisions m LEFT JOIN old_names n ON n.id = m.id) b WHERE k <= 3 UNION ALL SELECT 'zero', NULL, m.id, n.name FROM precisions m LEFT JOIN old_names n ON n.id = m.id WHERE precision = 0 UNION ALL SELECT 'never', NULL, n.id, n.name FROM old_names n ANTI JOIN precisions m ON m.id = n.id",
    "extra_repeat": "SELECT image, rep, 'target' || rep || '_split' || split || '_' || name AS name FROM images, (SELECT unnest(range(3)) AS rep) r",
    "labelled_images": "SELECT i.image, count(v.cid) AS n, coalesce(sum(v.cid), 0)::BIGINT AS ids FROM (SELECT unnest(range(60)) AS image) i LEFT JOIN (SELECT image, try_cast(t[1] AS INT) AS cid FROM (SELECT image, string_split_regex(trim(value), '\\s+') AS t FROM label_lines) l WHERE len(t) = 5 AND try_cast(t[1] AS INT) BETWEEN 0 AND 17) v ON v.image = i.image GROUP BY 1",
    "upload_names": f"SELECT page_id, CASE WHEN b = '' THEN 'upload' ELSE left(b, 120) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace({_BASE}, '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS b FROM pages) p",
    "upload_check": "SELECT doc_id, CASE WHEN kind NOT IN ('pdf', 'png', 'jpg', 'bmp') THEN 'suffix' WHEN content = '' THEN 'empty' WHEN octet_length(encode(content)) > 4000 THEN 'size' WHEN NOT ((kind = 'pdf' AND starts_with(content, '%PDF')) OR (kind = 'bmp' AND starts_with(content, 'BM'))) THEN 'content' END AS problem FROM uploads",
    "shape_scaled": "SELECT doc_id, page, det_ord, " + _SHAPE + " AS shape FROM (SELECT *, (x2 - x1) / 2 AS w, (y2 - y1) / 2 AS h FROM symbols) s",
    "graph_view": f"SELECT doc_id, {_ID} AS entity_id, coalesce(tag_id, description) AS label, CASE category WHEN 'equipment' THEN '#FF4444' WHEN 'valves' THEN '#44AA44' WHEN 'instruments' THEN '#FF9900' WHEN 'piping' THEN '#4488FF' ELSE '#888888' END AS colour FROM ents",
    "mto_layout": f"SELECT doc_id, item_no, item_no + 6 + 2 * (dense_rank() OVER (PARTITION BY doc_id ORDER BY c) - 1) AS sheet_row, CASE WHEN confidence < 0.6 THEN 'low' WHEN k % 2 = 0 THEN 'zebra' ELSE 'none' END AS fill FROM (SELECT *, list_position({dims.CATEGORY_ORDER}, category) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({dims.CATEGORY_ORDER}, category), description NULLS FIRST, tag_id, size, specification) AS item_no, row_number() OVER (PARTITION BY doc_id, category ORDER BY description NULLS FIRST, tag_id, size, specification) AS k FROM ({FINAL['mto_rows']}) r) x",
    "yolo_lines": "SELECT page AS image, string_agg(format('7 {:.6f} {:.6f} {:.6f} {:.6f}', (x1 + x2) / 4096, (y1 + y2) / 2048, (x2 - x1) / 2048, (y2 - y1) / 1024), chr(10) ORDER BY det_ord) AS text FROM symbols GROUP BY 1",
    "box_matches": "SELECT doc_id, page, l AS truth_ord, r AS det_ord, round(v, 9) AS iou FROM matched",
    "detection_scores": "SELECT d.doc_id, d.page, d.n AS truths, d.n AS found, coalesce(m.n, 0) AS matched, coalesce(m.n, 0) / d.n AS precision, coalesce(m.n, 0) / d.n AS recall FROM (SELECT doc_id, page, count(*) AS n FROM dense GROUP BY doc_id, page) d LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM matched GROUP BY doc_id, page) m ON d.doc_id = m.doc_id AND d.page = m.page",
    "job_windows": "SELECT date_trunc('hour', created_at) AS since, status, count(*) AS n FROM jobs WHERE created_at IS NOT NULL GROUP BY ALL",
    "nms_order": "SELECT doc_id, page, det_ord, row_number() OVER (PARTITION BY doc_id, page ORDER BY confidence DESC, f, rank) AS place FROM (SELECT *, min(rank) OVER (PARTITION BY doc_id, page, class_name) AS f FROM (SELECT n.*, d.confidence, 'c' || (d.det_ord % 3) AS class_name FROM (" + FINAL["nms"] + ") n JOIN dense d ON d.page = n.page AND d.det_ord = n.det_ord) x) y",
}


def _needed(text: str, known: dict[str, str]) -> list[str]:
    import re

    out: list[str] = []

    def visit(sql):
        for name in known:
            if name not in out and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
                visit(known[name])
                out.append(name)

    visit(text)
    return out


def sql() -> dict[str, str]:
    known = VIEWS | CHAIN
    result = {}
    for name, final in FINAL.items():
        reach = " reach " in f" {final} ".replace("\n", " ")
        parts = [f"{n} AS MATERIALIZED ({known[n]})" for n in _needed(final + (" FROM ents FROM whole_ends" if reach else ""), known)]
        if reach:
            parts.append(_REACH)
        result[name] = f"WITH {'RECURSIVE ' if reach else ''}{', '.join(parts)} {final}" if parts else final
    return result
