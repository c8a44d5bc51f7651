"""DuckDB SQL of the layout chain, in forms that differ from the window plans: counts, joins and recursion."""

from __future__ import annotations

from pageloom.plans.fixtures import BLOCKS_SQL

TEXTUAL = "('title', 'paragraph', 'list', 'index', 'code', 'algorithm')"
AUXILIARY = "('page_header', 'page_footer', 'page_number', 'page_aside_text', 'page_footnote')"
WIDE = "('title', 'table', 'chart', 'image', 'equation_interline', 'algorithm', 'code')"
CJK = "一二三四五六七八九十"
MARKERS = (
    ("arabic", r"^\s*([0-9]+)[.)]\s+"), ("alpha", r"^\s*([a-zA-Z])[.)]\s+"), ("roman", r"^\s*([ivxlcdmIVXLCDM]+)[.)]\s+"), ("bullet", r"^\s*[•\-*>]\s+"),
    ("paren_arabic", r"^\s*[(（]([0-9]+)[)）]\s*"), ("paren_cjk", rf"^\s*[(（]([{CJK}]+)[)）]\s*"), ("cjk_comma", rf"^\s*([{CJK}]+)[、.．]\s*"), ("ordinal_cjk", rf"^\s*第[{CJK}]+[，,、.．]\s*"),
)


def marker(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in MARKERS) + " END"


def marker_text(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN trim(regexp_extract({c}, '{p}', 0))" for _, p in MARKERS) + " END"


def joined(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {a}[-1] = '-' THEN {a}[:-2] || {b} ELSE {a} || ' ' || {b} END"


def terminal(c: str) -> str:
    return f"coalesce(right(rtrim({c}), 1) IN ('.', '?', '!', '。', '？', '！', ';', '；'), false)"


def canonical(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"""CASE WHEN {low} IN ('paragraph', 'text') THEN 'text' WHEN {low} = 'title' THEN 'title' WHEN {low} IN ('equation', 'equation_interline', 'interline_equation', 'display_formula') THEN 'equation'
      WHEN {low} = 'table' THEN 'table' WHEN {low} IN ('figure', 'image', 'chart') THEN 'figure' WHEN {low} = 'algorithm' THEN 'algorithm' WHEN {low} = 'list' THEN 'list' WHEN {low} = 'code' THEN 'code'
      WHEN {low} IN ('reference', 'references', 'bibliography') THEN 'reference' ELSE 'other' END"""


STAND_IN = "CASE {c} WHEN 'equation' THEN '[EQUATION]' WHEN 'table' THEN '[TABLE]' WHEN 'figure' THEN '[FIGURE]' WHEN 'algorithm' THEN '[ALGORITHM]' WHEN 'code' THEN '[CODE]' WHEN 'reference' THEN '[REFERENCE]' ELSE '[EMPTY]' END"

GEOMETRY = f"""{BLOCKS_SQL},
geo AS (
  SELECT *, (x0 + x1) / 2.0 AS cx, (y0 + y1) / 2.0 AS cy, greatest(0.0, x1 - x0) AS width, type IN {TEXTUAL} AS is_textual, type IN {AUXILIARY} AS is_auxiliary,
    (greatest(0.0, x1 - x0) >= 620.0 OR (type IN {WIDE} AND x0 <= 380 AND x1 >= 620)) AS is_full_width
  FROM blocks),
kept AS (SELECT * FROM geo WHERE NOT is_auxiliary AND NOT (is_textual AND text = ''))"""

SPLIT = f"""{GEOMETRY},
centres AS (
  SELECT doc_id, page_idx, cx, lead(cx) OVER w AS nx, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id, page_idx) AS n
  FROM kept WHERE NOT is_full_width WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY cx, original_index)),
splits AS (
  SELECT doc_id, page_idx, (cx + nx) / 2.0 AS split FROM centres WHERE rn >= 2 AND n - rn >= 2 AND nx - cx >= 130
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY nx - cx DESC, rn) = 1)"""

COLUMNS = f"""{SPLIT},
cols AS (
  SELECT k.*, split, CAST(CASE WHEN is_full_width THEN NULL WHEN split IS NULL OR cx < split THEN 0 ELSE 1 END AS INTEGER) AS column_id
  FROM kept k LEFT JOIN splits USING (doc_id, page_idx))"""

ORDER = f"""{COLUMNS},
regions AS (
  SELECT a.*, (SELECT count(*) FROM cols f WHERE f.doc_id = a.doc_id AND f.page_idx = a.page_idx AND f.is_full_width
      AND CASE WHEN a.is_full_width THEN (f.y0, f.x0, f.original_index) < (a.y0, a.x0, a.original_index) ELSE f.y0 - 8 <= a.cy END) AS region
  FROM cols a),
ordered AS (
  SELECT a.*, CAST((SELECT count(*) FROM regions b WHERE b.doc_id = a.doc_id AND b.page_idx = a.page_idx
      AND (b.region, CAST(b.is_full_width AS INTEGER), coalesce(b.column_id, 0), b.y0, b.x0, b.original_index) < (a.region, CAST(a.is_full_width AS INTEGER), coalesce(a.column_id, 0), a.y0, a.x0, a.original_index)) AS INTEGER) AS visual_order
  FROM regions a)"""

RUNS = f"""{ORDER},
texts AS (
  SELECT o.*, o.is_textual AND o.text <> '' AS is_text, coalesce(p.is_textual AND p.text <> '' AND p.column_id IS NOT DISTINCT FROM o.column_id, false) AS goes_on
  FROM ordered o LEFT JOIN ordered p ON p.doc_id = o.doc_id AND p.page_idx = o.page_idx AND p.visual_order = o.visual_order - 1),
numbered AS (SELECT *, (SELECT count(*) FROM texts b WHERE b.doc_id = a.doc_id AND b.page_idx = a.page_idx AND b.visual_order <= a.visual_order AND b.is_text AND NOT b.goes_on) - 1 AS run FROM texts a),
runs AS (
  SELECT *, CASE WHEN is_text THEN printf('p%04d_r%04d', page_idx, CAST(run AS INTEGER)) END AS text_run_id,
    CAST(CASE WHEN is_text THEN row_number() OVER (PARTITION BY doc_id, page_idx, run, is_text ORDER BY visual_order) - 1 END AS INTEGER) AS text_run_index FROM numbered)"""

V3 = f"""{ORDER},
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, visual_order) AS n FROM ordered),
walk AS (
  SELECT doc_id, n, 0 AS grp, column_id AS head, type, text, page_idx, y0, y1 FROM seq WHERE n = 1
  UNION ALL
  SELECT doc_id, n, CASE WHEN m THEN grp ELSE grp + 1 END, CASE WHEN m THEN head ELSE column_id END, type, text, page_idx, y0, y1 FROM (
    SELECT s.*, w.grp, w.head, coalesce(w.type = s.type AND s.type IN ('paragraph', 'list') AND w.text <> '' AND s.text <> '' AND NOT {terminal("w.text")}
      AND CASE WHEN s.page_idx = w.page_idx THEN w.head = 0 AND s.column_id = 1 AND s.y0 <= w.y0 + 80 WHEN s.page_idx = w.page_idx + 1 THEN w.y1 >= 780 AND s.y0 <= 260 ELSE false END, false) AS m
    FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.n = w.n + 1)),
v3 AS (
  SELECT doc_id, CAST(grp AS INTEGER) AS global_order, first(s.type ORDER BY n) AS type, first(s.page_idx ORDER BY n) AS page_idx, first(visual_order ORDER BY n) AS visual_order,
    first(column_id ORDER BY n) AS column_id, first(is_full_width ORDER BY n) AS is_full_width, list_reduce(list(s.text ORDER BY n), lambda a, b: {joined("a", "b")}) AS text, count(*) AS merge_count,
    list(s.page_idx ORDER BY n) AS pages, list(visual_order ORDER BY n) AS orders, list(original_index ORDER BY n) AS indexes,
    list(s.x0 ORDER BY n) AS xs0, list(s.y0 ORDER BY n) AS ys0, list(x1 ORDER BY n) AS xs1, list(s.y1 ORDER BY n) AS ys1
  FROM walk JOIN seq s USING (doc_id, n) GROUP BY doc_id, grp)"""

FLOATS = "('algorithm', 'chart', 'code', 'equation', 'equation_interline', 'figure', 'image', 'interline_equation', 'table')"
V4 = f"""{V3},
plain AS (SELECT *, {marker("text")} AS mark, type IN {FLOATS} AS is_float FROM v3),
pairs AS (
  SELECT a.doc_id, a.global_order, min(b.global_order) AS nxt FROM plain a JOIN plain b ON b.doc_id = a.doc_id AND b.global_order > a.global_order AND b.global_order <= a.global_order + 4 AND NOT b.is_float
  WHERE NOT a.is_float GROUP BY ALL),
links AS (
  SELECT a.doc_id, a.global_order, b.global_order AS target, b.text AS more, b.merge_count AS more_count FROM pairs JOIN plain a USING (doc_id, global_order) JOIN plain b ON b.doc_id = a.doc_id AND b.global_order = nxt
  WHERE nxt - a.global_order BETWEEN 2 AND 4 AND a.type = 'paragraph' AND a.mark IS NULL AND a.text[-1] = '-' AND b.type = 'paragraph' AND b.mark IS NULL AND b.text <> ''
    AND (b.page_idx = a.pages[-1] OR (b.page_idx = a.pages[-1] + 1 AND b.ys0[1] <= 760))),
items AS (SELECT p.*, target, more, more_count FROM plain p LEFT JOIN links USING (doc_id, global_order)),
fold AS (
  SELECT doc_id, global_order AS i, false AS gone, target AS used, target AS taken, CASE WHEN target IS NULL THEN text ELSE {joined("text", "more")} END AS txt, mark,
    CASE WHEN right(CASE WHEN target IS NULL THEN text ELSE more END, 1) IN (':', '：') THEN 0 END AS colon, xs0[1] AS colon_x, CAST(NULL AS INTEGER) AS parent, CAST(NULL AS INTEGER) AS active,
    CASE WHEN mark IS NOT NULL THEN 1 ELSE 0 END AS marks FROM items WHERE global_order = 0
  UNION ALL
  SELECT doc_id, i, gone, used, coalesce(used, taken), txt, mark, CASE WHEN ends THEN i ELSE colon END, CASE WHEN ends THEN x ELSE colon_x END, CASE WHEN marked THEN here END,
    CASE WHEN gone OR marked OR type IN ('paragraph', 'list') THEN here END, marks + CASE WHEN marked THEN 1 ELSE 0 END
  FROM (
    SELECT *, NOT gone AND right(txt, 1) IN (':', '：') AS ends, CASE WHEN marked AND colon IS NOT NULL AND x > colon_x + 20 THEN colon ELSE active END AS here FROM (
      SELECT s.doc_id, s.global_order AS i, s.type, s.mark, s.xs0[1] AS x, coalesce(f.taken = s.global_order, false) AS gone, f.taken, f.colon, f.colon_x, f.active, f.marks,
        CASE WHEN coalesce(f.taken = s.global_order, false) THEN NULL ELSE s.target END AS used, s.mark IS NOT NULL AND NOT coalesce(f.taken = s.global_order, false) AS marked,
        CASE WHEN s.target IS NULL OR coalesce(f.taken = s.global_order, false) THEN s.text ELSE {joined("s.text", "s.more")} END AS txt
      FROM fold f JOIN items s ON s.doc_id = f.doc_id AND s.global_order = f.i + 1))),
v4 AS (
  SELECT f.doc_id, f.i AS source_global_order, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY f.i) - 1 AS INTEGER) AS global_order, s.type, f.txt AS text,
    s.merge_count + CASE WHEN f.used IS NULL THEN 0 ELSE s.more_count END AS merge_count, CASE WHEN f.used IS NOT NULL THEN array_to_string(range(f.i + 1, f.used), ',') END AS skipped,
    f.mark, CASE WHEN f.mark IS NOT NULL THEN printf('li_%05d', CAST(f.marks - 1 AS INTEGER)) END AS list_item_id, CASE WHEN f.mark IS NOT NULL THEN CASE WHEN f.parent IS NULL THEN 0 ELSE 1 END END AS list_level, f.parent
  FROM fold f JOIN items s ON s.doc_id = f.doc_id AND s.global_order = f.i WHERE NOT f.gone)"""

FRAMES = f"""{V3},
boxes AS (SELECT doc_id, global_order, unnest(pages) AS page, unnest(xs0) AS x0, unnest(xs1) AS x1, unnest(range(len(pages))) AS k FROM v3),
narrow AS (SELECT *, (x0 + x1) / 2.0 AS c FROM boxes WHERE x1 - x0 < 620),
gaps AS (
  SELECT doc_id, page, c, lead(c) OVER w AS nx, row_number() OVER w AS rn, count(*) OVER (PARTITION BY doc_id, page) AS n FROM narrow WINDOW w AS (PARTITION BY doc_id, page ORDER BY c, global_order, k)),
mids AS (
  SELECT doc_id, page, (c + nx) / 2.0 AS mid FROM gaps WHERE rn >= 2 AND n - rn >= 2 AND nx - c >= 130 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY nx - c DESC, rn) = 1),
frames AS (
  SELECT doc_id, page, min(x0) FILTER (c < mid) AS left_min, max(x1) FILTER (c < mid) AS left_max, min(x0) FILTER (c >= mid) AS right_min, max(x1) FILTER (c >= mid) AS right_max
  FROM narrow JOIN mids USING (doc_id, page) GROUP BY doc_id, page)"""


def _local(x: str, a: str, b: str, f: str) -> str:
    left = f"abs(({a} + {b}) / 2.0 - ({f}.left_min + {f}.left_max) / 2.0) <= abs(({a} + {b}) / 2.0 - ({f}.right_min + {f}.right_max) / 2.0)"
    return f"""CASE WHEN is_full_width OR {f}.page IS NULL THEN {x} / 1000.0 WHEN {left} THEN ({x} - {f}.left_min) / greatest(1.0, {f}.left_max - {f}.left_min)
      ELSE ({x} - {f}.right_min) / greatest(1.0, {f}.right_max - {f}.right_min) END"""


FEATURES = f"""{FRAMES},
sums AS (
  SELECT doc_id, global_order, list_sum(list_transform(range(1, len(xs0) + 1), lambda i: greatest(0.0, xs1[i] - xs0[i]))) AS w, list_sum(list_transform(range(1, len(xs0) + 1), lambda i: greatest(0.0, ys1[i] - ys0[i]))) AS h,
    list_sum(list_transform(range(1, len(xs0) + 1), lambda i: greatest(0.0, xs1[i] - xs0[i]) * greatest(0.0, ys1[i] - ys0[i]))) AS area FROM v3),
features AS (
  SELECT v.doc_id, v.global_order, {canonical("type")} AS canonical_type, {_local("xs0[1]", "xs0[1]", "xs1[1]", "f")} AS x_start, ys0[1] / 1000.0 AS y_start, {_local("xs1[-1]", "xs0[-1]", "xs1[-1]", "g")} AS x_end, ys1[-1] / 1000.0 AS y_end,
    CAST(row_number() OVER (PARTITION BY v.doc_id ORDER BY v.global_order) - 1 AS DOUBLE) / greatest(1, count(*) OVER (PARTITION BY v.doc_id) - 1) AS macro_position, h / greatest(w, 1.0) AS aspect_ratio,
    CASE WHEN {canonical("type")} IN ('equation', 'table', 'figure', 'algorithm', 'code') THEN 0.0 ELSE length(text) / greatest(area, 1.0) END AS text_density
  FROM v3 v JOIN sums USING (doc_id, global_order) LEFT JOIN frames f ON f.doc_id = v.doc_id AND f.page = v.pages[1] LEFT JOIN frames g ON g.doc_id = v.doc_id AND g.page = v.pages[-1])"""


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"
