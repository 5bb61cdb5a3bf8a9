"""DuckDB SQL that states the same results independently of the engine."""

from __future__ import annotations

from boxloom.functions import dialog
from boxloom.functions.text import ATTRIBUTE_TERMS, CONDITIONAL_TERMS, HUMAN_TERMS
from boxloom.queries import CORPUS_TERMS

THR = "CASE detector WHEN 'yw' THEN 0.145::DOUBLE WHEN 'ow' THEN 0.175::DOUBLE WHEN 'gd' THEN 0.195::DOUBLE WHEN 'od' THEN 0.285::DOUBLE END"
DET = """det AS (SELECT *, x0 + bw AS x1, y0 + bh AS y1 FROM (
  SELECT l_suppkey AS image_id, CASE l_orderkey % 4 WHEN 0 THEN 'gd' WHEN 1 THEN 'yw' WHEN 2 THEN 'ow' ELSE 'od' END AS detector,
    row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos,
    CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE p_name END AS label, round(l_discount * 5 + l_tax, 4) AS score,
    (l_partkey * 37 + l_orderkey * 11) % 1400 - 60 AS x0, (l_orderkey * 53 + l_partkey * 7) % 1400 - 60 AS y0,
    CAST(floor(20 + l_quantity * l_quantity / 2) AS BIGINT) AS bw, 20 + (l_orderkey * 13 + l_partkey * 29) % 1100 AS bh,
    1024 + l_suppkey * 97 % 1025 AS width, 1024 + l_suppkey * 61 % 1025 AS height
  FROM lineitem JOIN part ON l_partkey = p_partkey))"""
TEST = f"""tested AS (SELECT *, CASE WHEN x0 > width OR y0 > height OR x1 < 0 OR y1 < 0 THEN 'outside' WHEN area_px < 0.35::DOUBLE * ((x1 - x0) * (y1 - y0)) THEN 'edge_cut'
    WHEN cx1 - cx0 < 0.05::DOUBLE * width OR cy1 - cy0 < 0.05::DOUBLE * height THEN 'thin' WHEN area_px > 0.6::DOUBLE * width * height THEN 'over_max' END AS reject
  FROM (SELECT *, (cx1 - cx0) * (cy1 - cy0) AS area_px FROM (SELECT *, least(greatest(x0, 0), width) AS cx0, least(greatest(y0, 0), height) AS cy0, least(greatest(x1, 0), width) AS cx1, least(greatest(y1, 0), height) AS cy1 FROM det)))"""
SCORED = f"scored AS (SELECT * FROM tested WHERE trim(label) <> '' AND score >= {THR})"
STYLED = """styled AS (SELECT image_id, detector, pos, label, score, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1, width, height FROM scored s WHERE reject IS NULL
  AND NOT (EXISTS (SELECT 1 FROM scored o WHERE o.reject = 'over_max' AND o.image_id = s.image_id AND o.label = s.label) AND area_px > 0.35::DOUBLE * width * height))"""
FULL = f"WITH {DET}, {TEST}, {SCORED}, {STYLED}"
ROW = "image_id, detector, pos, label, round(score, 6) AS score, x0, y0, x1, y1"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _inter(a: str, b: str) -> str:
    return f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"


def _union(a: str, b: str) -> str:
    return f"({_area(a)} + {_area(b)} - {_inter(a, b)})"


def _div(x: str, y: str) -> str:
    return f"(CASE WHEN {y} > 0 THEN {x}::DOUBLE / {y} ELSE 0 END)"


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _id(a: str = "") -> str:
    return f"{a}detector || ':' || lpad({a}pos::VARCHAR, 6, '0')"


PAIRS = f"{FULL}, p AS (SELECT *, {_id()} AS id FROM styled)"
JOIN = "FROM p a JOIN p b ON a.image_id = b.image_id AND a.id < b.id"
BOX = "{'s': -score, 'pos': pos, 'detector': detector, 'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"


def _inside(a: str, b: str) -> str:
    return f"({a}.x0 >= {b}.x0 AND {a}.y0 >= {b}.y0 AND {a}.x1 <= {b}.x1 AND {a}.y1 <= {b}.y1 AND ({b}.score >= 0.25 OR {b}.score >= 0.5::DOUBLE * {a}.score))"


_FIRST = f"coalesce(list_min(list_filter(range(i[1] + 1, len(a) + 1), lambda j: NOT list_contains(gone, j) AND {_inside('a[i[1]]', 'a[j]')})), 1000000)"
CONTAIN = f"""cg AS (SELECT image_id, detector, label, list({BOX} ORDER BY pos) AS a FROM styled GROUP BY ALL),
  cf AS (SELECT *, list_reduce(list_concat([[]::BIGINT[]], list_transform(range(1, len(a) + 1), lambda i: [i])), lambda gone, i: CASE WHEN list_contains(gone, i[1]) THEN gone
    ELSE list_concat(gone, list_filter(range(i[1] + 1, least({_FIRST}, len(a) + 1)), lambda k: NOT list_contains(gone, k) AND {_inside('a[k]', 'a[i[1]]')}), CASE WHEN {_FIRST} < 1000000 THEN i ELSE []::BIGINT[] END) END) AS gone FROM cg),
  cr AS (SELECT image_id, label, unnest(list_filter(a, lambda b, i: NOT list_contains(gone, i))) AS b FROM cf),
  kept AS (SELECT image_id, b.detector AS detector, b.pos AS pos, label, b.score AS score, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM cr)"""


def _nms(source: str, group: str, threshold: str, order: str = "pos") -> str:
    box = BOX.replace("'pos': pos", f"'pos': {order}")
    return f"""ng AS (SELECT {group}, list({box} ORDER BY score DESC, {order}) AS a FROM {source} GROUP BY {group}),
  nr AS (SELECT {group}, unnest(list_reduce(list_transform(a, lambda x: [x]), lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {_inter('k', 'b[1]')} > {threshold}::DOUBLE * {_union('k', 'b[1]')})) > 0 THEN acc ELSE list_concat(acc, b) END)) AS b FROM ng)"""


_AREA = "((x1 / width::DOUBLE - x0 / width::DOUBLE) * (y1 / height::DOUBLE - y0 / height::DOUBLE))"
_DX, _DY = "((x0 / width::DOUBLE + x1 / width::DOUBLE) / 2 - 0.5)", "((y0 / height::DOUBLE + y1 / height::DOUBLE) / 2 - 0.5)"
_NEAR = f"(sqrt(2::DOUBLE) / 2 - sqrt({_DX} * {_DX} + {_DY} * {_DY}))"
COUNTS = "SELECT image_id, count(*) FILTER (detector = 'yw') AS n_yw, count(*) FILTER (detector = 'ow') AS n_ow, count(*) FILTER (detector = 'gd') AS n_gd, count(*) FILTER (detector = 'od') AS n_od"
CAPS = f"""nc AS ({COUNTS} FROM styled GROUP BY image_id), lh AS (SELECT image_id, greatest(n_yw, n_ow, n_gd, n_od) AS hi, least(n_yw, n_ow, n_gd, n_od) AS lo FROM nc),
  l2 AS (SELECT image_id, hi, CASE WHEN hi >= 18 THEN greatest(lo, 18) ELSE hi END AS lo FROM lh),
  caps AS (SELECT image_id, lo + floor({_u("'0'", "'cap'", 'image_id::VARCHAR')} * (hi - lo + 1))::BIGINT AS cap FROM l2)"""

CAP = "cap AS (SELECT doc_id AS image_id, split_part(text, chr(10), 1) AS web, 'This is ' || text AS vlm FROM documents)"
_ANSWER = "ans AS (SELECT conv_id, turn, 'Here is the list:' || chr(10) || list_aggregate(list_transform(string_split(text, '. '), lambda s, i: i::VARCHAR || '. ' || s), 'string_agg', chr(10)) AS answer FROM conversations WHERE role = 'assistant')"
_STRIP = lambda s: f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
PARSED = f"""{_ANSWER}, raw AS (SELECT conv_id, turn, answer, list_transform(string_split(regexp_replace({_STRIP("replace(answer, 'Here is the list:', '')")}, '[.,\\n ]+$', ''), chr(10)), lambda l: {_STRIP('l')}) AS ls FROM ans),
  items AS (SELECT conv_id, turn, answer, list_filter(list_transform(ls, lambda l: CASE WHEN contains(l, ' ') THEN substr(l, instr(l, ' ') + 1) ELSE l END), lambda x: x <> '') AS xs FROM raw),
  un AS (SELECT conv_id, turn, answer, unnest(xs) AS item, generate_subscripts(xs, 1) AS k FROM items),
  ord AS (SELECT conv_id, turn, answer, item, min(k) AS k FROM un GROUP BY ALL)"""


def _has(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


_DROP = "CASE WHEN starts_with({c}, 'T') THEN {c} WHEN instr({c}, 'this is ') > 0 THEN substr({c}, 1, instr({c}, 'this is ') - 1) || substr({c}, instr({c}, 'this is ') + 8) ELSE {c} END"


def _words(x: str) -> str:
    return f"list_distinct(string_split(replace({x}, '-', ' '), ' '))"


def _similar(a: str, b: str) -> str:
    n = f"len(list_intersect({_words(a)}, {_words(b)}))"
    return f"({n} >= 3 OR ({n} >= 0.65::DOUBLE * len({_words(a)}) AND {n} >= 0.65::DOUBLE * len({_words(b)})))"


def _merge() -> str:
    human = "CASE image_id % 5 WHEN 0 THEN ['men'] WHEN 1 THEN ['woman'] WHEN 2 THEN ['old people'] WHEN 3 THEN ['a man walking'] ELSE ['children', 'young child'] END"
    out = f"""WITH {DET}, nm AS (SELECT image_id, list_sort(list(DISTINCT label)) AS l FROM det WHERE trim(label) <> '' GROUP BY image_id),
  att AS (SELECT image_id, list_concat(l, list_transform(l, lambda x: 'small ' || x), list_transform(l, lambda x: replace(x, ' ', '-')), list_transform(l, lambda x: 'a very old big ' || x), {human}) AS p1,
    list_transform(l, lambda x, i: split_part(x, ' ', -1) || CASE WHEN (i - 1) % 3 = 0 THEN 's' ELSE '' END) AS p2 FROM nm),
  e1 AS (SELECT DISTINCT image_id, unnest(p1) AS a FROM att),
  o1 AS (SELECT image_id, list(a ORDER BY {_u("'0'", 'image_id::VARCHAR', 'a')}, a) AS s FROM e1 WHERE len(string_split(replace(a, '-', ' '), ' ')) <= 4 GROUP BY image_id),
  d1 AS (SELECT image_id, list_filter(s, lambda a, i: len(list_filter(s[i + 1:], lambda b: {_similar('a', 'b')})) = 0) AS s FROM o1),
  un AS (SELECT image_id, a, min(k) AS k FROM (SELECT image_id, unnest(s) AS a, generate_subscripts(s, 1) AS k FROM d1 UNION ALL SELECT image_id, unnest(p2), 100000 + generate_subscripts(p2, 1) FROM att) GROUP BY ALL),
  b1 AS (SELECT image_id, list(a ORDER BY k) AS b FROM un GROUP BY image_id),
  pl AS (SELECT image_id, list_filter(list_reduce(list_concat([b], list_transform(range(1, len(b) + 1), lambda i: [i::VARCHAR])), lambda acc, i: CASE WHEN ends_with(acc[i[1]::INT], 's') AND list_contains(acc, substr(acc[i[1]::INT], 1, length(acc[i[1]::INT]) - 1)) THEN list_transform(acc, lambda x, k: CASE WHEN k = i[1]::INT THEN '' ELSE x END) ELSE acc END), lambda x: x <> '') AS b FROM b1),
  h0 AS (SELECT image_id, list_distinct(list_transform(b, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in HUMAN_TERMS.items())} ELSE x END)) AS b FROM pl)"""
    inside = lambda w: f"starts_with(p, '{w} ') OR ends_with(p, ' {w}') OR contains(p, ' {w} ')"
    for i, (many, w) in enumerate(HUMAN_TERMS.items()):
        out += f""",
  h{i + 1} AS (SELECT image_id, CASE WHEN NOT list_contains(b, '{w}') AND len(list_filter(b, lambda p: {inside(many)} OR {inside(w)})) > 0 THEN list_append(b, '{w}') ELSE b END AS b FROM h{i})"""
    return out + " SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY length(item), item) - 1 AS pos, item FROM (SELECT image_id, unnest(b) AS item FROM h4)"


_LOGITS = "lg AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 20) AS l FROM embeddings), ex AS (SELECT vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM lg), pr AS (SELECT vec_id, (e[1] + e[2] + e[3]) / list_sum(e) AS yes, (e[4] + e[5] + e[6]) / list_sum(e) AS no, list_position(l, list_max(l)) AS top FROM ex)"
_VERDICT = f"""{_LOGITS}, vd AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'err' END AS original, round(yes, 6) AS yes, round(no, 6) AS no FROM pr),
  vm AS (SELECT vec_id, original, CASE WHEN original = 'err' THEN CASE WHEN yes < 0.3 THEN 'no' WHEN yes >= no + 0.2::DOUBLE THEN 'yes' ELSE 'no' END WHEN original = 'yes' AND NOT yes >= no + 0.2::DOUBLE THEN 'no' ELSE original END AS modified FROM vd)"""
_CROP = f"""{FULL}, c1 AS (SELECT *, floor((x1 - x0) * (392.0::DOUBLE / greatest(x1 - x0, y1 - y0))) AS a, floor((y1 - y0) * (392.0::DOUBLE / greatest(x1 - x0, y1 - y0))) AS b FROM styled),
  c2 AS (SELECT *, CASE WHEN least(a, b) < 28 THEN 28 WHEN least(a, b) > 224 THEN 224 END AS t FROM c1),
  c3 AS (SELECT image_id, detector, pos, CASE WHEN t IS NULL THEN a ELSE greatest(floor(a * (t::DOUBLE / least(a, b))), t) END::BIGINT AS crop_w, CASE WHEN t IS NULL THEN b ELSE greatest(floor(b * (t::DOUBLE / least(a, b))), t) END::BIGINT AS crop_h FROM c2)"""
_IMAGES = "im AS (SELECT DISTINCT l_suppkey AS image_id, 1024 + l_suppkey * 97 % 1025 AS width, 1024 + l_suppkey * 61 % 1025 AS height FROM lineitem)"
# The last grid of the least distance whose tie rule holds, or else the first of them.
_GRID = f"""{_IMAGES}, gr AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS k FROM range(1, 10) a(i), range(1, 10) b(j) WHERE i * j <= 9),
  ds AS (SELECT image_id, width, height, i, j, k, abs(width::DOUBLE / height - i::DOUBLE / j) AS dist FROM im, gr),
  mn AS (SELECT *, min(dist) OVER (PARTITION BY image_id) AS m FROM ds), cd AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) AS r FROM mn WHERE dist = m),
  ch AS (SELECT image_id, arg_max(i, k) AS i, arg_max(j, k) AS j FROM cd WHERE r = 1 OR width * height > 0.5::DOUBLE * 448 * 448 * i * j GROUP BY image_id)"""

_PICTURES = """cosines AS (SELECT list(cos(pi() * (2 * (n % 8) + 1) * (n // 8) / 16) ORDER BY n) AS c FROM range(0, 64) t(n)),
  pv AS (SELECT vec_id * 4 + k AS pic_id, list_transform(embedding, lambda x, i: CASE k WHEN 0 THEN x::DOUBLE WHEN 1 THEN x::DOUBLE * 1.5::DOUBLE + 0.25::DOUBLE ELSE x::DOUBLE + (2 * k - 3) * (((vec_id * 31 + (i - 1) * 17) % 101 - 50) / 2500::DOUBLE) END) AS v FROM embeddings, range(0, 4) t(k)),
  pr AS (SELECT pic_id, c, list_transform(range(0, 64), lambda n: list_sum(list_transform(range(0, 8), lambda i: v[n // 8 * 8 + i + 1] * c[n % 8 * 8 + i + 1]))) AS r FROM pv, cosines),
  pc AS (SELECT pic_id, list_transform(range(0, 64), lambda n: round(list_sum(list_transform(range(0, 8), lambda i: r[n % 8 + i * 8 + 1] * c[n // 8 * 8 + i + 1])), 6)) AS x FROM pr),
  pb AS (SELECT pic_id, list_transform(x, lambda y: CASE WHEN y > list_sort(x[2:])[32] THEN 1 ELSE 0 END) AS b FROM pc),
  ph AS (SELECT pic_id, array_to_string(b, '') AS bits, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', (1 + 8 * b[4 * i + 1] + 4 * b[4 * i + 2] + 2 * b[4 * i + 3] + b[4 * i + 4])::INT, 1)), '') AS phash FROM pb)"""
# All pairs of pictures, and what steps within a radius reach.
_NEAR_CLASSES = f"""WITH RECURSIVE {_PICTURES}, near AS (SELECT radius, a.pic_id AS a, b.pic_id AS b FROM ph a, ph b, (VALUES (0), (4), (8)) t(radius) WHERE a.pic_id <> b.pic_id AND hamming(a.bits, b.bits) <= radius),
  reach AS (SELECT radius, pic_id AS a, pic_id AS b FROM ph, (VALUES (0), (4), (8)) t(radius) UNION SELECT r.radius, r.a, n.b FROM reach r JOIN near n ON r.radius = n.radius AND r.b = n.a)
  SELECT radius::BIGINT AS radius, a AS pic_id, min(b) AS class_id, min(b) = a AS stays FROM reach GROUP BY radius, a"""


def oracle_sql() -> dict[str, str]:
    return {
        "blank_label_filter": f"WITH {DET} SELECT {ROW} FROM det WHERE trim(label) <> ''",
        "score_threshold": f"WITH {DET} SELECT {ROW} FROM det WHERE trim(label) <> '' AND score >= {THR}",
        "score_threshold_strict": f"WITH {DET} SELECT {ROW} FROM det WHERE score > 0.3",
        "box_validity": f"{FULL} SELECT image_id, detector, pos, label, round(score, 6) AS score, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1, area_px FROM scored WHERE reject IS NULL",
        "box_reject_reasons": f"{FULL} SELECT image_id, coalesce(reject, 'valid') AS reason, count(*) AS n FROM scored GROUP BY ALL",
        "over_max_labels": f"{FULL} SELECT DISTINCT image_id, label FROM scored WHERE reject = 'over_max'",
        "style_removal": f"{FULL} SELECT {ROW} FROM styled",
        "stage_funnel_counts": f"WITH {DET}, {TEST}, f AS (SELECT *, trim(label) <> '' AS nm, trim(label) <> '' AND score >= {THR} AS sc FROM tested) SELECT image_id, detector, count(*) AS n_all, count(*) FILTER (nm) AS n_named, count(*) FILTER (sc) AS n_scored, "
        + ", ".join(f"count(*) FILTER (sc AND reject = '{r}') AS n_{r}" for r in ("outside", "edge_cut", "thin", "over_max"))
        + ", count(*) FILTER (sc AND reject IS NULL) AS n_valid FROM f GROUP BY ALL",
        "vocab_union": f"{FULL} SELECT DISTINCT image_id, label FROM styled",
        "label_reindex": f"{FULL} SELECT image_id, detector, pos, dense_rank() OVER (PARTITION BY image_id ORDER BY label) - 1 AS label_id FROM styled",
        "pairwise_iou": f"{PAIRS} SELECT a.image_id, a.id AS a, b.id AS b, round({_div(_inter('a', 'b'), _union('a', 'b'))}, 6) AS iou {JOIN} WHERE 2 * {_inter('a', 'b')} > {_union('a', 'b')}",
        "pairwise_ioa": f"{PAIRS} SELECT a.image_id, a.id AS a, b.id AS b, round({_div(_inter('a', 'b'), _area('a'))}, 6) AS ioa_a, round({_div(_inter('a', 'b'), _area('b'))}, 6) AS ioa_b {JOIN} AND a.label = b.label",
        "cross_detector_votes": f"{PAIRS} SELECT a.image_id, a.id, round(sum({_div(_inter('a', 'b'), _union('a', 'b'))}), 6) AS votes FROM p a JOIN p b ON a.image_id = b.image_id AND a.label = b.label AND a.detector <> b.detector GROUP BY ALL",
        "first_weights": f"""{PAIRS}, v AS (SELECT a.image_id, a.id, sum({_div(_inter('a', 'b'), _union('a', 'b'))}) AS votes FROM p a JOIN p b ON a.image_id = b.image_id AND a.label = b.label AND a.detector <> b.detector GROUP BY ALL),
            w AS (SELECT p.*, coalesce(votes, 0)::DOUBLE AS votes FROM p LEFT JOIN v USING (image_id, id))
            SELECT image_id, id, round(0.1::DOUBLE + 1.2::DOUBLE * votes / (votes + 1) + 2 * 4, 6) AS stage4, round(0.01::DOUBLE + 99 / (0.8::DOUBLE + votes) + 1.5::DOUBLE * 2 / (votes + 0.5::DOUBLE), 6) AS stage5, x0::DOUBLE AS x0, y1::DOUBLE AS y1 FROM w""",
        "overlap_min_area_pairs": f"{PAIRS} SELECT a.image_id, a.id AS a, b.id AS b, round({_div(_inter('a', 'b'), f'least({_area('a')}, {_area('b')})')}, 6) AS overlap {JOIN} AND a.label = b.label WHERE {_inter('a', 'b')} > 0",
        "box_union_hull": f"{PAIRS} SELECT a.image_id, a.id AS a, b.id AS b, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 {JOIN} AND a.label = b.label",
        "containment_removal": f"{FULL}, {CONTAIN} SELECT {ROW} FROM kept",
        "nms_per_label": f"{FULL}, {CONTAIN}, {_nms('kept', 'image_id, detector, label', '0.4').replace('SELECT image_id, detector, label, unnest', 'SELECT image_id, label, unnest')} SELECT image_id, b.detector AS detector, b.pos AS pos, label, round(b.score, 6) AS score, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM nr",
        "topk_score": f"WITH {DET} SELECT {ROW} FROM det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, detector, pos) <= 80",
        "max_dets": f"{FULL} SELECT {ROW} FROM styled QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY styled.score DESC, detector, pos) <= 60",
        "center_closeness": f"{FULL} SELECT image_id, detector, pos, round({_AREA}, 6) AS area, round({_NEAR}, 6) AS closeness FROM styled",
        "equal_contribution_sample": f"{FULL}, {CAPS} SELECT {ROW} FROM styled JOIN caps USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id, detector ORDER BY ln(greatest({_u(chr(39) + '0' + chr(39), chr(39) + 's3' + chr(39), 'image_id::VARCHAR', 'detector', 'pos::VARCHAR')}, 1e-300)) / (0.05::DOUBLE + 2 * sqrt(2::DOUBLE) * {_AREA} + {_NEAR}) DESC, pos) <= cap",
        "contribution_caps": f"{FULL}, {CAPS} SELECT image_id, cap FROM caps",
        "detector_contribution": f"{FULL} {COUNTS}, count(*) AS n_boxes, count(DISTINCT label) AS n_labels FROM styled GROUP BY image_id",
        "detector_label_rollup": f"{FULL} SELECT coalesce(detector, '(all)') AS detector, coalesce(label, '(all)') AS label, count(*) AS n_boxes, sum(round(score * 10000)::BIGINT)::BIGINT AS score_sum, grouping(detector, label) AS level FROM styled GROUP BY ROLLUP (detector, label)",
        "caption_preprocess": f"""WITH {CAP}, c1 AS (SELECT image_id, lower(vlm) AS c FROM cap), c2 AS (SELECT image_id, {_DROP.format(c='c')} AS c FROM c1), c3 AS (SELECT image_id, CASE WHEN ends_with(c, '.') THEN substr(c, 1, length(c) - 1) ELSE c END AS c FROM c2)
            SELECT image_id, coalesce(list_aggregate(list_filter(list_transform(string_split(c, '. '), lambda s: {_STRIP('s')}), lambda s: s <> '' AND NOT {_has('s', CORPUS_TERMS)}), 'string_agg', '. ') || '.', '') AS caption FROM c3""",
        "attribute_parse": f"WITH {PARSED} SELECT conv_id, turn::BIGINT AS turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS pos, item FROM ord",
        "attribute_postprocess": f"""WITH {PARSED}, nr AS (SELECT conv_id, turn, answer, k, replace(replace(lower({_STRIP('item')}), '_', ' '), ',', '') AS item FROM ord),
            al AS (SELECT conv_id, turn, k, {_STRIP("regexp_replace(item, '\\([^()]*\\)', '', 'g')")} AS item FROM nr WHERE NOT {_has('item', ATTRIBUTE_TERMS)} """
        + " ".join(f"AND NOT (NOT contains(answer, '{t}') AND contains(item, '{t}'))" for t in CONDITIONAL_TERMS)
        + ") SELECT conv_id, turn::BIGINT AS turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS pos, item FROM al WHERE item <> ''",
        "attribute_merge": _merge(),
        "dialog_build": f"WITH {CAP} SELECT image_id, 0::BIGINT AS turn, 'system' AS role, $p${dialog.PHASE1_SYSTEM}$p$ AS content FROM cap UNION ALL SELECT image_id, 1, 'user', 'Noisy caption: ' || lower(web) || chr(10) || 'Detailed caption: ' || lower(vlm) || chr(10) || 'List every object with its attributes.' FROM cap",
        "yes_no_question": f"{FULL} SELECT DISTINCT image_id, label, 'Does this picture show ' || label || '? Answer yes or no.' AS question FROM styled",
        "softmax_yes_no": f"WITH {_LOGITS} SELECT vec_id, round(yes, 6) AS yes, round(no, 6) AS no, top::BIGINT AS top FROM pr",
        "verdict_correction": f"WITH {_VERDICT} SELECT vec_id, original, modified FROM vm",
        "verdict_group": f"WITH {_VERDICT} SELECT (vec_id % 40)::VARCHAR AS new_key, (vec_id % 3)::BIGINT AS sub_sample, count(*) AS n, string_agg(modified, ',' ORDER BY vec_id) AS modified, string_agg(original, ',' ORDER BY vec_id) AS original FROM vm GROUP BY 1, 2",
        "crop_plan": f"{_CROP} SELECT * FROM c3",
        "crop_order": f"{_CROP} SELECT image_id, detector, pos, row_number() OVER (PARTITION BY image_id ORDER BY crop_w * crop_h DESC, detector, pos) AS crop_rank FROM c3",
        "tile_choice": f"WITH {_GRID} SELECT image_id, i, j FROM ch",
        "tile_boxes": f"WITH {_GRID} SELECT image_id, n, n % i * 448 AS x0, n // i * 448 AS y0, (n % i + 1) * 448 AS x1, (n // i + 1) * 448 AS y1 FROM (SELECT image_id, i, j, unnest(range(0, i * j)) AS n FROM ch) UNION ALL SELECT image_id, i * j, 0, 0, 0, 0 FROM ch WHERE i * j > 1",
        "resume_anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
        "contiguous_slices": "SELECT c_custkey, least((row_number() OVER (ORDER BY c_custkey) - 1) // greatest((SELECT count(*) FROM customer) // 7, 1), 6) AS slice_id FROM customer",
        "mode_label": f"{FULL}, ct AS (SELECT image_id, label, count(*) AS n FROM styled GROUP BY ALL) SELECT image_id, label AS mode_label, n FROM ct QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, md5('0|' || image_id || '|' || label) DESC) = 1",
        "final_annotations": f"{FULL} SELECT image_id::VARCHAR AS new_key, count(*) AS box_num, count(DISTINCT label) AS category_num, string_agg(label, ',' ORDER BY {_id()}) AS labels, string_agg(detector, ',' ORDER BY {_id()}) AS detectors FROM styled GROUP BY image_id",
        "train_val_split": f"WITH {_IMAGES} SELECT CASE WHEN image_id < 8 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM im GROUP BY 1",
        "final_nms": f"{FULL}, {_nms('styled', 'image_id, label', '0.5', _id())} SELECT image_id, label, b.pos AS pos, round(b.score, 6) AS score, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM nr",
        "resolution_filter": f"WITH {_IMAGES} SELECT * FROM im WHERE width >= 1024 AND height >= 1024 AND width <= 4096 AND height <= 6144 AND greatest(width, height) <= 1.5::DOUBLE * least(width, height)",
        "aesthetic_class": "SELECT p_partkey, CASE WHEN (p_partkey % 13) / 2.0 >= 6 THEN 'main' WHEN (p_partkey % 13) / 2.0 >= 5.75 THEN 'add_on' ELSE 'reject' END AS class FROM part",
        "phash_dedup": f"WITH {_IMAGES} SELECT *, md5((image_id % 7)::VARCHAR) AS phash FROM im QUALIFY row_number() OVER (PARTITION BY image_id % 7 ORDER BY image_id) = 1",
        "phash_values": f"WITH {_PICTURES} SELECT pic_id, phash FROM ph",
        "phash_near_pairs": f"WITH {_PICTURES}, h AS (SELECT DISTINCT phash, bits FROM ph) SELECT a.phash AS a, b.phash AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM h a JOIN h b ON a.phash < b.phash WHERE hamming(a.bits, b.bits) <= 8",
        "phash_near_dedup": _NEAR_CLASSES,
        "last_sentence": f"""WITH {CAP}, ps AS (SELECT image_id, regexp_extract_all(vlm, '\\s*\\S+') AS w FROM cap), un AS (SELECT image_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM ps),
            pl AS (SELECT *, sum(length(x)) OVER (PARTITION BY image_id ORDER BY k) AS e FROM un)
            SELECT image_id, coalesce(max(e) FILTER (k <= 77 AND (k = n OR right(x, 1) IN ('.', '!', '?'))), 0)::BIGINT AS n FROM cap LEFT JOIN pl USING (image_id) GROUP BY image_id""",
        "display_strings": f"{FULL}, ix AS (SELECT image_id, detector, pos, label, row_number() OVER (PARTITION BY image_id ORDER BY detector, pos) AS display_idx FROM styled) SELECT image_id, detector, pos, display_idx, display_idx::VARCHAR || ' | ' || label AS display FROM ix",
        "detector_records": f"WITH {DET} SELECT image_id::VARCHAR AS new_key, detector, pos - 1 AS pos, label, round(score, 6) AS score, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM det",
        "detector_wide": f"""WITH {DET}, ix AS (SELECT image_id::VARCHAR AS new_key, detector, score, x0 + y0 + x1 + y1 AS xy, dense_rank() OVER (PARTITION BY image_id, detector ORDER BY label) - 1 AS l FROM det)
            SELECT new_key, detector || '_' || f AS field, (count(*) * CASE f WHEN 'bboxes' THEN 4 ELSE 1 END)::BIGINT AS n, round(sum(CASE f WHEN 'bboxes' THEN xy WHEN 'scores' THEN score ELSE l END::DOUBLE), 6) AS total FROM ix, (VALUES ('bboxes'), ('scores'), ('labels')) t(f) GROUP BY new_key, detector, f""",
        "input_audit": f"""WITH {_IMAGES}, a AS (SELECT image_id, 0 AS side FROM im WHERE image_id % 5 <> 0 UNION ALL SELECT image_id, 0 FROM im WHERE image_id % 11 = 1 UNION ALL SELECT NULL, 0 FROM im
              UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT l_suppkey, 2 FROM lineitem WHERE l_suppkey % 3 <> 0),
            n AS (SELECT image_id, count(*) FILTER (side = 0) AS n_image, count(*) FILTER (side = 1) AS n_caption, count(*) FILTER (side = 2) AS n_boxes FROM a GROUP BY image_id)
            SELECT coalesce(image_id::VARCHAR, 'none') AS image_id, n_image, n_caption, n_boxes, concat_ws('; ', CASE WHEN image_id IS NULL THEN 'null key' END, CASE WHEN n_image = 0 THEN 'no image' WHEN n_image > 1 THEN 'image repeats' END, CASE WHEN n_caption = 0 THEN 'no caption' WHEN n_caption > 1 THEN 'caption repeats' END, CASE WHEN n_boxes = 0 THEN 'no boxes' END) AS reasons FROM n""",
        "cost_batches": f"""{_CROP}, o AS (SELECT *, crop_w * crop_h AS px, max(crop_w * crop_h) OVER () AS top FROM c3), w AS (SELECT *, row_number() OVER (ORDER BY px DESC, image_id % 16, image_id, detector, pos) - 1 AS nth,
            sum(px) OVER (ORDER BY px DESC, image_id % 16, image_id, detector, pos) - px AS before FROM o) SELECT image_id, detector, pos, (nth // 40 + before // (1500000 - top))::BIGINT AS batch_id FROM w""",
        "instance_pick": f"""WITH {DET}, g AS (SELECT image_id, detector, list(label ORDER BY pos, label) AS a FROM det GROUP BY ALL)
            SELECT image_id, detector, coalesce(a[image_id % 9 + 1], '-') || ',' || a[1] || ',' || a[-1] || ',-' AS picked, coalesce(array_to_string(list_transform(range(1, len(a) - 1, 7), lambda k: a[k + 1]), ','), '') AS middle,
              array_to_string(list_transform(range(len(a), 0, -10), lambda k: a[k]), ',') AS backward FROM g""",
        "resumed_stream": "SELECT user_id, event_id % 2 AS half, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
        "json_resume": f"WITH {_IMAGES} SELECT * FROM im WHERE width < 1500",
        "line_files": f"WITH {_IMAGES} SELECT width AS value FROM im",
        "work_maps": """WITH m AS (SELECT o_orderkey::VARCHAR AS new_key, '0' AS replica, '/a/"' || o_orderstatus || '\\"{,}/' || o_orderkey AS path, o_custkey FROM orders UNION ALL SELECT o_orderkey::VARCHAR, '1', '{"[": ' || o_custkey, o_custkey FROM orders)
            SELECT new_key, replica, path, '/d"}/' || (o_custkey % 7) AS folder FROM m""",
        "keyed_files": f"WITH {_IMAGES} SELECT *, CASE WHEN width >= 1500 THEN 'first' ELSE 'second' END AS run, image_id::VARCHAR AS new_key FROM im",
        "arrow_batches": "SELECT l_orderkey, l_partkey, CAST(floor(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE floor(l_quantity) >= 20 AND l_orderkey % 2 = 1",
        "key_ranges": f"WITH {_IMAGES} SELECT *, 'range' AS part FROM im WHERE image_id >= 3 AND image_id < 8 UNION ALL SELECT *, 'up to' FROM im WHERE image_id <= 4",
        "key_parts": "SELECT p_partkey, replace(p_name, ' ', '_') || '.tar' AS stem, '/data/' || (p_partkey % 5) AS folder, '/data' AS top, replace(p_name, ' ', '_') || '.tar' AS key, p_partkey % 12 AS replica FROM part",
        "box_transform": f"{FULL} SELECT image_id, detector, pos, width / 2.0::DOUBLE - (x1 * 0.5::DOUBLE - 8) AS x0, y0 * 0.5::DOUBLE - 4 AS y0, width / 2.0::DOUBLE - (x0 * 0.5::DOUBLE - 8) AS x1, y1 * 0.5::DOUBLE - 4 AS y1 FROM styled",
        "text_places": f"{FULL} SELECT image_id, detector, pos, greatest(least(greatest(x0 - 300, 0), width - 300), 0) AS x0, greatest(least(greatest(y0 - 20, 0), height - 20), 0) AS y0, least(greatest(x0 - 300, 0) + 300, width) AS x1, least(greatest(y0 - 20, 0) + 20, height) AS y1 FROM styled",
        "instance_take": f"WITH {DET} SELECT image_id, detector, (CASE pos WHEN 3 THEN 0 ELSE 1 END)::BIGINT AS pos, label FROM det WHERE pos IN (1, 3)",
        "instance_arrays": f"WITH {DET} SELECT image_id, detector, pos - 1 AS pos, label, round(score, 6) AS score FROM det",
        "hashed_uniform": f"SELECT c_custkey, {_u(chr(39) + '3' + chr(39), chr(39) + 'x' + chr(39), 'c_custkey::VARCHAR')} AS u FROM customer",
    }
