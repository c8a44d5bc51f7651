"""Registered queries of the layout, manifest, style and graph operators, each with DuckDB SQL over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import nested
from pageloom.functions import text as T
from pageloom.operators import graph, layout, manifest, merge, style
from pageloom.plans import fixtures as X
from pageloom.plans import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


KEYS = ["doc_id", "page_idx", "original_index"]


# ---- layout


@registered(S.query(S.GEOMETRY, "SELECT doc_id, page_idx, original_index, cx, cy, width, is_textual, is_auxiliary, is_full_width FROM geo"))
def block_geometry(spark, sf):
    return layout.geometry(X.blocks(spark, sf)).select(*KEYS, "cx", "cy", "width", "is_textual", "is_auxiliary", "is_full_width")


@registered(S.query(S.SPLIT, "SELECT doc_id, page_idx, split FROM splits"))
def column_split(spark, sf):
    return layout.with_columns(X.blocks(spark, sf)).where("split is not null").groupBy("doc_id", "page_idx").agg(F.max("split").alias("split"))


@registered(S.query(S.COLUMNS, "SELECT doc_id, page_idx, original_index, column_id FROM cols"))
def column_assign(spark, sf):
    return layout.with_columns(X.blocks(spark, sf)).select(*KEYS, "column_id")


@registered(S.query(S.ORDER, "SELECT doc_id, page_idx, original_index, type, column_id, visual_order FROM ordered"))
def reading_order(spark, sf):
    return layout.reading_order(X.blocks(spark, sf)).select(*KEYS, "type", "column_id", "visual_order")


@registered(S.query(S.RUNS, "SELECT doc_id, page_idx, original_index, text_run_id, text_run_index FROM runs"))
def text_runs(spark, sf):
    return layout.text_runs(layout.reading_order(X.blocks(spark, sf))).select(*KEYS, "text_run_id", "text_run_index")


@registered(
    S.query(
        S.RUNS,
        """SELECT doc_id, page_idx, input_blocks, dropped_auxiliary_blocks, dropped_empty_textual_blocks, coalesce(output_blocks, 0) AS output_blocks, coalesce(column_count, 0) AS column_count,
      coalesce(full_width_blocks, 0) AS full_width_blocks, coalesce(text_runs, 0) AS text_runs
    FROM (SELECT doc_id, page_idx, count(*) AS input_blocks, count(*) FILTER (is_auxiliary) AS dropped_auxiliary_blocks, count(*) FILTER (is_textual AND text = '') AS dropped_empty_textual_blocks FROM geo GROUP BY ALL)
    LEFT JOIN (SELECT doc_id, page_idx, count(*) AS output_blocks, count(DISTINCT column_id) AS column_count, count(*) FILTER (is_full_width) AS full_width_blocks, count(DISTINCT text_run_id) AS text_runs FROM runs GROUP BY ALL) USING (doc_id, page_idx)""",
    )
)
def page_summary(spark, sf):
    return layout.page_summary(X.blocks(spark, sf))


@registered(S.query(S.GEOMETRY, "SELECT doc_id, page_idx, original_index, greatest(0.0, x0 / 1000.0 * 612 - 2) AS cx0, greatest(0.0, y0 / 1000.0 * 792 - 2) AS cy0, least(612.0, x1 / 1000.0 * 612 + 2) AS cx1, least(792.0, y1 / 1000.0 * 792 + 2) AS cy1 FROM geo"))
def clip_rect(spark, sf):
    box = style.clip_rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(612.0), F.lit(792.0))
    rows = X.blocks(spark, sf).withColumn("r", box)
    return rows.select(*KEYS, F.col("r.x0").alias("cx0"), F.col("r.y0").alias("cy0"), F.col("r.x1").alias("cx1"), F.col("r.y1").alias("cy1"))


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_totalprice AS DOUBLE) ELSE 0 END AS x0, CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_orderkey AS DOUBLE) ELSE 0 END AS y0,
      CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_custkey AS DOUBLE) ELSE 1000 END AS x1, CAST(CASE WHEN o_orderkey % 5 = 4 THEN 7 ELSE 1000 END AS DOUBLE) AS y1 FROM orders""")
def parse_bbox(spark, sf):
    o = X.table(spark, sf, "orders")
    box = F.slice(F.array(F.col("o_totalprice").cast("double"), F.col("o_orderkey").cast("double"), F.col("o_custkey").cast("double"), F.lit(7.0), F.lit(8.0)), 1, (F.col("o_orderkey") % 5).cast("int"))
    return o.select("o_orderkey", layout.parse_bbox(F.when(F.col("o_orderkey") % 5 != 3, box)).alias("b")).select("o_orderkey", "b.*")


# ---- text rules


@registered(f"WITH {X.BLOCKS_SQL} SELECT doc_id, pos, {S.terminal('t')} AS terminal FROM lines")
def terminal_punct(spark, sf):
    lines = X.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    return lines.select("doc_id", F.col("p").cast("long").alias("pos"), T.ends_terminal(F.col("t")).alias("terminal"))


@registered(S.query(S.BLOCKS_SQL, f"SELECT doc_id, page_idx, original_index, {S.marker('text')} AS marker_type, {S.marker_text('text')} AS marker FROM blocks"))
def list_markers(spark, sf):
    return X.blocks(spark, sf).select(*KEYS, T.marker_type(F.col("text")).alias("marker_type"), T.marker_text(F.col("text")).alias("marker"))


@registered(S.query(S.BLOCKS_SQL, f"SELECT doc_id, page_idx, original_index, {S.canonical('type')} AS canonical_type FROM blocks"))
def canonical_type(spark, sf):
    return X.blocks(spark, sf).select(*KEYS, T.canonical_type(F.col("type")).alias("canonical_type"))


@registered(S.query(S.BLOCKS_SQL, f"SELECT doc_id, page_idx, original_index, CASE WHEN {S.canonical('type')} <> 'reference' AND trim(text) <> '' THEN trim(text) ELSE {S.STAND_IN.format(c=S.canonical('type'))} END AS embedding_text FROM blocks"))
def embed_text(spark, sf):
    return X.blocks(spark, sf).select(*KEYS, T.embedding_text(F.col("type"), F.col("text")).alias("embedding_text"))


@registered(
    f"""SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda t: CASE WHEN length(t) % 3 = 0 THEN t || '-' ELSE t END),
      lambda a, b: {S.joined("rtrim(a)", "ltrim(b)")}) AS text FROM documents"""
)
def dehyphen_join(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda t: F.when(F.length(t) % 3 == 0, F.concat(t, F.lit("-"))).otherwise(t))
    rows = X.table(spark, sf, "documents").withColumn("l", lines)
    rest = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
    return rows.select("doc_id", F.aggregate(rest, F.get("l", F.lit(0)), lambda a, b: T.join_continuation(a, b)).alias("text"))


# ---- merging


def _v3(spark, sf):
    return merge.items_v3(layout.reading_order(X.blocks(spark, sf)))


_V3_SQL = "SELECT doc_id, global_order, type, page_idx, visual_order, column_id, is_full_width, text, merge_count, array_to_string(pages, ',') AS pages, array_to_string(orders, ',') AS orders, array_to_string(indexes, ',') AS indexes FROM v3"


@registered(S.query(S.V3, _V3_SQL))
def paragraph_merge_v3(spark, sf):
    items = _v3(spark, sf)
    lineage = {"pages": "source_page_idxs", "orders": "source_visual_orders", "indexes": "source_original_indexes"}
    return items.select(
        "doc_id", "global_order", "type", "page_idx", "visual_order", "column_id", "is_full_width", "text", F.col("merge_count").cast("long").alias("merge_count"),
        *[_joined(c).alias(n) for n, c in lineage.items()],
    )


@registered(S.query(S.V4, "SELECT doc_id, source_global_order, type, text, merge_count, skipped FROM v4"))
def float_continuation(spark, sf):
    items = merge.float_merged(_v3(spark, sf))
    return items.select("doc_id", F.col("global_order").alias("source_global_order"), "type", "text", F.col("merge_count").cast("long").alias("merge_count"), _joined("skipped_float_global_orders").alias("skipped"))


@registered(S.query(S.V4, "SELECT doc_id, source_global_order, mark AS marker_type, list_item_id, CAST(list_level AS INTEGER) AS list_level, parent AS list_parent_global_order FROM v4 WHERE mark IS NOT NULL"))
def list_parents(spark, sf):
    items = merge.items_v4(_v3(spark, sf)).where("list_marker is not null")
    return items.select("doc_id", "source_global_order", F.col("list_marker.type").alias("marker_type"), "list_item_id", "list_level", "list_parent_global_order")


@registered(S.query(S.V4, "SELECT doc_id, source_global_order, global_order, type, text, merge_count, mark AS marker_type, list_item_id, CAST(list_level AS INTEGER) AS list_level, parent AS list_parent_global_order FROM v4"))
def content_v4(spark, sf):
    items = merge.items_v4(_v3(spark, sf))
    return items.select(
        "doc_id", "source_global_order", "global_order", "type", "text", F.col("merge_count").cast("long").alias("merge_count"), F.col("list_marker.type").alias("marker_type"), "list_item_id", "list_level", "list_parent_global_order"
    )


# ---- graph


@registered(S.query(S.V3, "SELECT doc_id, global_order, CAST(i AS INTEGER) AS k, xs0[i + 1] AS x0, ys0[i + 1] AS y0, xs1[i + 1] AS x1, ys1[i + 1] AS y1 FROM (SELECT *, unnest(range(len(xs0))) AS i FROM v3)"))
def bbox_chunks(spark, sf):
    flat = F.flatten(F.transform("bbox", lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])))
    rows = _v3(spark, sf).select("doc_id", "global_order", F.posexplode(graph.bbox_chunks(F.concat(flat, F.array(F.lit(1.0))))).alias("k", "b"))
    return rows.select("doc_id", "global_order", "k", "b.*")


@registered(S.query(S.FRAMES, "SELECT doc_id, page, left_min, left_max, right_min, right_max FROM frames"))
def page_frames(spark, sf):
    return graph.page_frames(_v3(spark, sf))


@registered(S.query(S.V3, f"SELECT doc_id, global_order, list_position(['text', 'title', 'equation', 'table', 'figure', 'algorithm', 'list', 'code', 'reference', 'other'], {S.canonical('type')}) - 1 AS hot, 1.0 AS total FROM v3"))
def type_onehot(spark, sf):
    rows = _v3(spark, sf).withColumn("v", graph.type_onehot(F.col("type")))
    return rows.select("doc_id", "global_order", (F.array_position("v", F.lit(1.0).cast("float")) - 1).cast("int").alias("hot"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@registered(S.query(S.FEATURES, "SELECT doc_id, global_order, x_start, y_start, x_end, y_end FROM features"))
def geometry_features(spark, sf):
    return graph.geometry(_v3(spark, sf)).select("doc_id", "global_order", "x_start", "y_start", "x_end", "y_end")


@registered(S.query(S.FEATURES, "SELECT doc_id, global_order, macro_position, aspect_ratio, text_density FROM features"))
def derived_stats(spark, sf):
    return graph.derived_stats(_v3(spark, sf)).select("doc_id", "global_order", "macro_position", "aspect_ratio", "text_density")


_FEATURES = ("x_start", "y_start", "x_end", "y_end", "macro_position", "aspect_ratio", "text_density")


@registered(S.query(S.FEATURES, f"SELECT doc_id, global_order AS node, list_position(['text', 'title', 'equation', 'table', 'figure', 'algorithm', 'list', 'code', 'reference', 'other'], canonical_type) - 1 AS hot, 17 AS width, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in _FEATURES)} FROM features"))
def node_features(spark, sf):
    rows = graph.node_features(_v3(spark, sf))
    hot = (F.array_position(F.slice("x", 1, 10), F.lit(1.0).cast("float")) - 1).cast("int")
    return rows.select("doc_id", "node", hot.alias("hot"), F.size("x").alias("width"), *[F.get("x", F.lit(10 + k)).alias(c) for k, c in enumerate(_FEATURES)])


@registered(
    S.query(
        S.V3,
        """SELECT doc_id, CAST(2 * a AS BIGINT) + back AS edge_pos, CAST(CASE WHEN back = 1 THEN a + 1 ELSE a END AS INTEGER) AS source, CAST(CASE WHEN back = 1 THEN a ELSE a + 1 END AS INTEGER) AS target
    FROM (SELECT doc_id, global_order AS a FROM v3 WHERE (doc_id, global_order + 1) IN (SELECT (doc_id, global_order) FROM v3)), (VALUES (0), (1)) v(back)""",
    )
)
def seq_edges(spark, sf):
    rows = graph.sequential_edges(_v3(spark, sf))
    return rows.select("doc_id", F.col("edge_pos").cast("long").alias("edge_pos"), F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"))


@registered(S.query(S.V3, f"SELECT doc_id, global_order, {S.canonical('type')} AS canonical_type, page_idx, visual_order, merge_count, array_to_string(pages, ',') AS pages, text[1:200] AS text_preview FROM v3"))
def node_records(spark, sf):
    rows = graph.node_records(_v3(spark, sf))
    return rows.select("doc_id", "global_order", "canonical_type", "page_idx", "visual_order", F.col("merge_count").cast("long").alias("merge_count"), _joined("source_page_idxs").alias("pages"), "text_preview")


@registered("SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(v AS DOUBLE)), 9) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def mean_pool(spark, sf):
    pooled = graph.mean_pool(X.table(spark, sf, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 9))


@registered(
    """SELECT doc_id, n_tokens, array_to_string(CASE WHEN n_tokens = 0 THEN [] ELSE list_transform(range(0, 1 + CAST(greatest(0, ceil((n_tokens - 510) / 384.0)) AS BIGINT)), lambda k: k * 384) END, ',') AS starts
    FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) AS INTEGER) AS n_tokens FROM documents)""".replace("\\\\", "\\")
)
def token_windows(spark, sf):
    rows = X.table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("n_tokens"))
    return rows.withColumn("starts", F.array_join(F.transform(graph.token_windows(F.col("n_tokens")), lambda v: v.cast("string")), ","))


# ---- manifests


def _ids(spark, sf):
    return X.manifest(spark, sf).withColumn("arxiv_id", T.normalized_id(F.col("raw_id")))


_YEAR = "CASE WHEN CAST(arxiv_id[1:2] AS INTEGER) < 90 THEN 2000 ELSE 1900 END + CAST(arxiv_id[1:2] AS INTEGER)"
_M = f"WITH {X.MANIFEST_SQL}"


@registered(f"{_M} SELECT line, arxiv_id FROM ids")
def norm_id(spark, sf):
    return _ids(spark, sf).select("line", "arxiv_id")


@registered(f"{_M} SELECT line, CAST({_YEAR} AS INTEGER) AS year FROM ids")
def id_year(spark, sf):
    return _ids(spark, sf).select("line", T.id_year(F.col("arxiv_id")).alias("year"))


@registered(f"{_M} SELECT line, coalesce({_YEAR}, CASE WHEN line % 2 = 1 AND line % 7 = 3 THEN 1987 END, CASE WHEN line % 11 = 4 THEN 2003 END, CAST(nullif(regexp_extract(update_date, '\\b(?:19|20)[0-9]{{2}}\\b', 0), '') AS INTEGER), CAST(nullif(regexp_extract(created, '\\b(?:19|20)[0-9]{{2}}\\b', 0), '') AS INTEGER)) AS year FROM ids")
def record_year(spark, sf):
    return _ids(spark, sf).select("line", T.record_year(F.col("arxiv_id"), [F.when(F.col("line") % 2 == 0, "n/a").when(F.col("line") % 7 == 3, "1987"), F.when(F.col("line") % 11 == 4, F.lit(2003))], [F.col("update_date")], F.col("versions")).alias("year"))


@registered(f"{_M} SELECT line, CAST(coalesce(nullif(regexp_extract(created, '\\b(?:19|20)[0-9]{{2}}\\b', 0), ''), CASE WHEN regexp_matches(update_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN update_date[1:4] END) AS INTEGER) AS year FROM manifest")
def version_year(spark, sf):
    return X.manifest(spark, sf).select("line", T.version_year(F.col("versions"), F.col("update_date")).alias("year"))


_FIRST = f"""{_M}, chosen AS (SELECT arxiv_id, min(line) AS line FROM ids WHERE arxiv_id IS NOT NULL AND {_YEAR} = 1995 GROUP BY arxiv_id), best AS (SELECT line, arxiv_id FROM chosen)"""


def _first(spark, sf):
    rows = _ids(spark, sf).select("line", "arxiv_id").where(T.id_year(F.col("arxiv_id")) == 1995)
    return manifest.first_seen(rows, "arxiv_id", "line")


@registered(f"{_FIRST} SELECT line, arxiv_id FROM best ORDER BY line LIMIT 100")
def first_seen_limit(spark, sf):
    return manifest.limited(_first(spark, sf), "line", 100)


def _processed(spark, sf):
    return _ids(spark, sf).where("status = 'F' and line % 2 = 0").select("arxiv_id")


_DONE = "(SELECT arxiv_id FROM ids WHERE status = 'F' AND line % 2 = 0 AND arxiv_id IS NOT NULL)"


@registered(f"{_FIRST} SELECT line, arxiv_id FROM best WHERE arxiv_id NOT IN {_DONE}")
def resume_antijoin(spark, sf):
    return manifest.unprocessed(_first(spark, sf), _processed(spark, sf), "arxiv_id").select("line", "arxiv_id")


@registered(f"{_FIRST} SELECT line, arxiv_id FROM (SELECT * FROM best ORDER BY line LIMIT 200) WHERE arxiv_id NOT IN {_DONE}")
def limit_then_antijoin(spark, sf):
    return manifest.unprocessed(manifest.limited(_first(spark, sf), "line", 200), _processed(spark, sf), "arxiv_id").select("line", "arxiv_id")


@registered(f"{_FIRST} SELECT line, arxiv_id FROM best WHERE arxiv_id NOT IN {_DONE} ORDER BY line LIMIT 200")
def antijoin_then_limit(spark, sf):
    return manifest.limited(manifest.unprocessed(_first(spark, sf), _processed(spark, sf), "arxiv_id").select("line", "arxiv_id"), "line", 200)


@registered("SELECT event_id, accepted_index FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) + 7 AS accepted_index FROM events WHERE event_type = 'purchase') WHERE accepted_index <= 500")
def accept_quota(spark, sf):
    return manifest.accept_quota(X.table(spark, sf, "events"), F.col("event_type") == "purchase", "event_id", 500, 7).select("event_id", F.col("accepted_index").cast("long").alias("accepted_index"))


@registered("SELECT event_id, n AS successes FROM (SELECT event_id, event_type = 'purchase' AS ok, count(*) FILTER (event_type = 'purchase') OVER (ORDER BY event_id) AS n FROM events) WHERE n - CAST(ok AS INTEGER) < 300")
def success_quota(spark, sf):
    return manifest.success_quota(X.table(spark, sf, "events"), F.col("event_type") == "purchase", "event_id", 300).select("event_id", F.col("successes").cast("long").alias("successes"))


def _main_sql(weights, least):
    a, b, c, d, e = weights
    return f"""WITH {X.FILES_SQL}, scored AS (SELECT *, {a} * CAST(contains(text, '\\documentclass') AS INTEGER) + {b} * CAST(contains(text, '\\begin{{document}}') AS INTEGER) + {c} * CAST(contains(text, '\\end{{document}}') AS INTEGER)
      + {d} * CAST(lower(list_extract(string_split(path, '/'), -1)) IN ('main.tex', 'paper.tex', 'ms.tex', 'article.tex') AS INTEGER) + {e} * CAST(NOT contains(path, '/') AS INTEGER) AS score FROM files WHERE path LIKE '%.tex')
    SELECT doc, path, score FROM scored WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, size DESC, path DESC) = 1"""


@registered(_main_sql(*manifest.BUILDER))
def main_file_builder(spark, sf):
    return manifest.main_file(X.files(spark, sf), *manifest.BUILDER)


@registered(_main_sql(*manifest.SERIAL))
def main_file_serial(spark, sf):
    return manifest.main_file(X.files(spark, sf), *manifest.SERIAL)


@registered("SELECT coalesce(nullif(event_type, 'view'), 'unknown') AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf):
    return manifest.status_counts(X.table(spark, sf, "events").select(F.nullif(F.col("event_type"), F.lit("view")).alias("status")))


def _outcomes(spark, sf):
    e, k = X.table(spark, sf, "events"), F.col("event_id")
    compiled = F.when(k % 6 == 0, "failed").when(k % 6 == 1, "timeout").when(k % 6 == 2, "error").otherwise("ok")
    return e.select("event_id", manifest.outcome(k % 13 == 0, k % 5 != 0, k % 10 == 0, k % 17 != 0, k % 7 != 0, compiled).alias("status"))


_OUTCOME = """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'already_present' WHEN event_id % 10 = 0 THEN 'source_not_found' WHEN event_id % 5 = 0 THEN 'download_error' WHEN event_id % 17 = 0 THEN 'error'
      WHEN event_id % 7 = 0 THEN 'no_main_tex' WHEN event_id % 6 = 0 THEN 'compile_failed' WHEN event_id % 6 = 1 THEN 'timeout' WHEN event_id % 6 = 2 THEN 'error' ELSE 'accepted' END AS status FROM events"""


@registered(_OUTCOME)
def outcome_class(spark, sf):
    return _outcomes(spark, sf)


@registered(f"SELECT CASE status WHEN 'accepted' THEN 'accepted' WHEN 'already_present' THEN 'accepted' WHEN 'download_error' THEN 'transient' ELSE 'rejected' END AS log, count(*) AS n FROM ({_OUTCOME}) GROUP BY 1")
def log_routing(spark, sf):
    return _outcomes(spark, sf).groupBy(manifest.log_of(F.col("status")).alias("log")).agg(F.count("*").alias("n"))


@registered("SELECT m.i * 900 + n.k - 1 AS position, printf('25%02d.%05d', m.month, n.k) AS arxiv_id, printf('2025-%02d', m.month) AS created FROM (VALUES (0, 3), (1, 1)) m(i, month), (SELECT CAST(unnest(range(1, 901)) AS INTEGER) AS k) n WHERE m.i * 900 + n.k <= 1500")
def id_scan(spark, sf):
    return manifest.id_scan(spark, 2025, "03, ,01", 1, 900, 1500)


@registered(
    f"""{_M}, listing AS (SELECT DISTINCT paper AS arxiv_id FROM manifest WHERE line % 3 <> 1),
    fetched AS (SELECT min(line) AS line, arxiv_id FROM ids WHERE status = 'F' AND arxiv_id IN (SELECT arxiv_id FROM listing) GROUP BY arxiv_id)
    SELECT line, arxiv_id, 'downloaded' AS status FROM fetched UNION ALL SELECT NULL, arxiv_id, 'scanned_pool' FROM listing WHERE arxiv_id NOT IN (SELECT arxiv_id FROM fetched)"""
)
def pool_union(spark, sf):
    rows = _ids(spark, sf)
    fetched = rows.select("line", F.coalesce("arxiv_id", F.lit("")).alias("arxiv_id"), F.when(F.col("status") == "F", "downloaded").otherwise("download_error").alias("status"))
    return manifest.pool_union(fetched, rows.where("line % 3 <> 1").select(F.col("paper").alias("arxiv_id")))


@registered("SELECT doc_id, right(text, 12000) AS tail, substring(text, 1, 500) AS short FROM documents")
def tail_text(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.tail_text(F.col("text")).alias("tail"), T.short_error(F.col("text")).alias("short"))


@registered("SELECT page_id, replace(url, '/', '_') AS safe FROM pages")
def safe_id(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe"))


# ---- styles


def _styled(spark, sf):
    name, text = style.font_name(F.col("raw_font")), F.col("text")
    raw = X.raw_spans(X.documents(spark, sf))
    return raw.select(
        "doc_id", "pos", "text", name.alias("font_name"), style.size_bucket(F.col("size")).alias("font_size"), style.is_bold(F.col("flags"), name).alias("is_bold"),
        style.is_italic(F.col("flags"), name).alias("is_italic"), style.is_math(name, text).alias("is_inline_math"), style.is_code(name).alias("is_inline_code"),
    )


_STYLED = f"""{X.SPANS_SQL},
named AS (SELECT *, lower(regexp_replace(raw_font, '^[A-Z]{{6}}[+]', '')) AS font_name FROM raw_spans),
styled AS (
  SELECT doc_id, pos, text, font_name, round_even(size / 0.5, 0) * CAST(0.5 AS DOUBLE) AS font_size, (flags & 16) <> 0 OR regexp_matches(font_name, '{"|".join(style.BOLD)}') AS is_bold,
    (flags & 2) <> 0 OR regexp_matches(font_name, '{"|".join(style.ITALIC)}') AS is_italic, regexp_matches(font_name, '{"|".join(style.MATH)}') OR (contains(font_name, 'symbol') AND regexp_matches(text, '[{style.MATH_CHARS.replace("^", "").replace("_", "_^")}]')) AS is_inline_math,
    regexp_matches(font_name, '{"|".join(style.CODE)}') AS is_inline_code
  FROM named)"""


@registered(f"WITH {_STYLED} SELECT doc_id, pos, font_name, is_bold, is_italic, is_inline_math, is_inline_code FROM styled")
def font_flags(spark, sf):
    return _styled(spark, sf).select("doc_id", "pos", "font_name", "is_bold", "is_italic", "is_inline_math", "is_inline_code")


@registered("SELECT p_partkey, round_even(p_retailprice / 0.5, 0) * CAST(0.5 AS DOUBLE) AS bucket FROM part")
def size_bucket(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", style.size_bucket(F.col("p_retailprice")).alias("bucket"))


_WORD = "regexp_matches({c}, '^[\\p{{L}}\\p{{N}}]$')"


def _span_sql(a: str, b: str) -> str:
    la, fb = f"{a}[-1]", f"{b}[1]"
    wa, wb = _WORD.format(c=la), _WORD.format(c=fb)
    close, opening, openers = "'.,;:!?)]}%”’'", "'([{{/%“‘'".replace("{{", "{"), "'([{“‘'"
    return f"""CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {la} IN (' ', chr(10)) OR {fb} IN (' ', chr(10)) OR {la} = '-' OR contains({close}, {fb}) OR contains({opening}, {la}) THEN {a} || {b}
      WHEN {wa} AND ({wb} OR contains({openers}, {fb})) THEN {a} || ' ' || {b} WHEN {la} = '.' AND length({a}) >= 2 AND regexp_matches({a}[-2:-2], '^[0-9]$') AND regexp_matches({fb}, '^[0-9]$') THEN {a} || {b}
      WHEN contains({close}, {la}) AND {wb} THEN {a} || ' ' || {b} ELSE {a} || {b} END"""


_MERGED = f"""{_STYLED},
breaks AS (SELECT *, CAST(coalesce(lag((font_name, font_size, is_bold, is_italic, is_inline_math, is_inline_code)) OVER w = (font_name, font_size, is_bold, is_italic, is_inline_math, is_inline_code), false) AS INTEGER) AS same FROM styled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
islands AS (SELECT *, sum(1 - same) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS span FROM breaks),
merged AS (
  SELECT doc_id, CAST(span AS BIGINT) AS span, list_reduce(list(text ORDER BY pos), lambda a, b: {_span_sql("a", "b")}) AS text, any_value(font_name) AS font_name, any_value(font_size) AS font_size, CAST(sum(length(text)) AS BIGINT) AS char_count
  FROM islands GROUP BY doc_id, span)"""


def _merged(spark, sf):
    return style.merge_spans(_styled(spark, sf), ["doc_id"], "pos")


@registered(f"WITH {_MERGED} SELECT doc_id, span, text, font_name, font_size, char_count FROM merged")
def span_merge(spark, sf):
    return _merged(spark, sf).select("doc_id", "span", "text", "font_name", "font_size", "char_count")


@registered(f"WITH {X.SPANS_SQL}, pairs AS (SELECT doc_id, pos, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM raw_spans) SELECT doc_id, pos, {_span_sql('a', 'b')} AS joined FROM pairs WHERE b IS NOT NULL")
def span_join(spark, sf):
    from pyspark.sql import Window

    rows = X.raw_spans(X.documents(spark, sf)).withColumn("b", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).where("b is not null")
    return rows.select("doc_id", "pos", style.join_spans(F.col("text"), F.col("b")).alias("joined"))


@registered(
    f"""WITH {_MERGED}, totals AS (SELECT doc_id, font_size, sum(greatest(1, char_count)) AS n, min(span) AS first FROM merged GROUP BY ALL)
    SELECT doc_id, font_size AS baseline_size FROM totals QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"""
)
def baseline_size(spark, sf):
    return style.baseline_size(style.span_sizes(_styled(spark, sf), ["doc_id"], "pos"), ["doc_id"], "span")


@registered(
    f"""WITH {_STYLED.replace("doc_id, pos, text, list_extract", "doc_id, pos, CASE WHEN pos % 9 = 4 THEN ' ' ELSE text END AS text, list_extract")},
    items AS (SELECT doc_id, unnest(range(0, 1 + (SELECT max(pos) FROM raw_spans) // 40)) AS global_order FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT DISTINCT doc_id, pos // 40 FROM raw_spans WHERE doc_id % 10 <> 3),
    rows AS (SELECT *, pos // 40 AS global_order FROM styled WHERE trim(text) <> ''),
    breaks AS (SELECT *, CAST(coalesce(lag((font_name, font_size, is_bold, is_italic, is_inline_math, is_inline_code)) OVER w = (font_name, font_size, is_bold, is_italic, is_inline_math, is_inline_code), false) AS INTEGER) AS same FROM rows WINDOW w AS (PARTITION BY doc_id, global_order ORDER BY pos)),
    islands AS (SELECT *, sum(1 - same) OVER (PARTITION BY doc_id, global_order ORDER BY pos) - 1 AS span FROM breaks),
    merged AS (
      SELECT doc_id, global_order, span, list_reduce(list(text ORDER BY pos), lambda a, b: {_span_sql("a", "b")}) AS text, any_value(font_size) AS font_size, sum(length(text)) AS char_count, bool_or(is_bold) AS is_bold
      FROM islands GROUP BY doc_id, global_order, span),
    totals AS (SELECT doc_id, global_order, font_size, sum(greatest(1, char_count)) AS n, min(span) AS first FROM merged GROUP BY ALL),
    base AS (SELECT doc_id, global_order, font_size AS style_baseline_size FROM totals QUALIFY row_number() OVER (PARTITION BY doc_id, global_order ORDER BY n DESC, first) = 1),
    nested AS (SELECT doc_id, global_order, count(*) AS k, string_agg(text || '/' || char_count || '/' || CAST(is_bold AS INTEGER), '|' ORDER BY span) AS spans FROM merged GROUP BY ALL)
    SELECT doc_id, CAST(global_order AS INTEGER) AS global_order, coalesce(spans, '') AS spans, style_baseline_size, CAST(coalesce(k, 0) AS INTEGER) AS style_span_count, CASE WHEN k > 0 THEN 'ok' ELSE 'empty' END AS style_extract_status
    FROM items LEFT JOIN nested USING (doc_id, global_order) LEFT JOIN base USING (doc_id, global_order)"""
)
def styled_items(spark, sf):
    docs = X.documents(spark, sf)
    raw = X.raw_spans(docs).withColumn("global_order", F.expr("pos div 40").cast("int"))
    # a document's last word by its text alone: only the first and the last piece of a split can be empty
    ended = X.table(spark, sf, "documents").select("doc_id", F.rtrim("text", F.lit(" \n")).alias("t")).select("doc_id", F.when(F.col("t") != "", ((F.size(F.split("t", "[ \n]+")) - 1) / 40).cast("int")).alias("last"))
    last = ended.agg(F.max("last")).first()[0]
    upto = lambda n: F.explode(F.sequence(F.lit(0), n)).alias("global_order")
    listed = ended.where("doc_id % 10 = 3").select("doc_id", upto(F.lit(last)))
    items = listed.unionByName(ended.where("doc_id % 10 <> 3").groupBy("doc_id").agg(F.max("last").alias("last")).where("last is not null").select("doc_id", upto(F.col("last"))))
    spans = raw.select("doc_id", "global_order", F.expr("pos % 40 div 20").cast("int").alias("chunk"), "pos", F.when(F.col("pos") % 9 == 4, " ").otherwise(F.col("text")).alias("text"), F.col("raw_font").alias("font_name"), "size", "flags")
    said = F.array_join(F.transform("style_spans", lambda s: F.concat_ws("/", s["text"], s["char_count"].cast("string"), s["is_bold"].cast("int").cast("string"))), "|")
    return style.styled_items(items, spans).select("doc_id", "global_order", said.alias("spans"), "style_baseline_size", "style_span_count", "style_extract_status")


@registered(
    f"""WITH {X.SPANS_SQL}, chars AS (SELECT doc_id, pos, size, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM raw_spans),
    placed AS (SELECT *, i * 6.0 + CASE WHEN (i + pos) % 5 = 0 THEN 3.0 ELSE 0.0 END AS x0, i * 6.0 + 5.5 AS x1 FROM chars),
    seen AS (SELECT *, lag(x1) OVER w AS px, lag(c) OVER w AS pc FROM placed WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i))
    SELECT doc_id, pos, string_agg(CASE WHEN coalesce(x0 - px > greatest(1.0, size * CAST(0.22 AS DOUBLE)) AND NOT contains(' ([{{/%“‘', pc) AND NOT contains(' .,;:!?)]}}%”’', c), false) THEN ' ' || c ELSE c END, '' ORDER BY i) AS text
    FROM seen GROUP BY doc_id, pos"""
)
def char_gap_text(spark, sf):
    raw = X.raw_spans(X.texts(spark, sf))
    x0 = lambda i: i * 6.0 + F.when((i + F.col("pos")) % 5 == 0, 3.0).otherwise(0.0)
    chars = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("c"), x0(i).alias("x0"), (i * 6.0 + 5.5).alias("x1")))
    return raw.withColumn("chars", chars).select("doc_id", "pos", style.span_text(F.col("chars"), F.col("size"), F.col("text")).alias("text"))


# ---- id sets


@registered(f"{_M} SELECT DISTINCT arxiv_id FROM ids WHERE arxiv_id IS NOT NULL")
def id_set_normalised(spark, sf):
    return manifest.id_set(X.manifest(spark, sf).withColumnRenamed("raw_id", "arxiv_id"))


@registered(f"{_M} SELECT DISTINCT raw_id AS arxiv_id FROM manifest WHERE raw_id <> ''")
def id_set_raw(spark, sf):
    return manifest.id_set(X.manifest(spark, sf).withColumnRenamed("raw_id", "arxiv_id"), normalise=False)


@registered(f"{_M} SELECT DISTINCT arxiv_id FROM ids WHERE arxiv_id IS NOT NULL AND (status = 'F' OR line % 11 = 0)")
def id_set_union(spark, sf):
    rows = X.manifest(spark, sf).withColumnRenamed("raw_id", "arxiv_id")
    return manifest.id_union(manifest.id_set(rows.where("status = 'F'")), manifest.id_set(rows.where("line % 11 = 0")), manifest.id_set(rows.limit(0)))


# ---- nested content


def _json_blocks(spark, sf):
    c = X.table(spark, sf, "conversations")
    body = F.struct(F.lit("reference_list").alias("list_type"), F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("content")), F.struct(F.lit("text").alias("type"), F.col("role").alias("content"))).alias("item_content")), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("  ").alias("content"))).alias("item_content"))).alias("list_items"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.lit("list").alias("type"), body.alias("content"))).alias("block"))


_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@registered(f"SELECT conv_id, turn, trim({_STRIP} || ' ' || role) AS text FROM conversations")
def extract_text(spark, sf):
    return _json_blocks(spark, sf).select("conv_id", "turn", nested.extract_text("block").alias("text"))


@registered(f"SELECT conv_id, turn, trim({_STRIP} || ' ' || role) AS items, 1 AS n FROM conversations")
def reference_items(spark, sf):
    rows = _json_blocks(spark, sf).withColumn("r", nested.reference_items("block"))
    return rows.select("conv_id", "turn", F.array_join("r", "|").alias("items"), F.size("r").alias("n"))


@registered("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'paragraph' END AS type, CASE turn % 3 WHEN 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'reference' ELSE 'list' END WHEN 1 THEN 'paragraph' END AS logical_type FROM conversations")
def logical_type(spark, sf):
    c = X.table(spark, sf, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "list").when(F.col("turn") % 3 == 1, "paragraph")
    listed = F.when(F.col("conv_id") % 2 == 0, "reference_list").otherwise("text_list")
    rows = c.select("conv_id", "turn", F.to_json(F.struct(kind.alias("type"), F.struct(listed.alias("list_type"), "text").alias("content"))).alias("block"))
    return nested.block_fields(rows, "block").select("conv_id", "turn", "type", "logical_type")


@registered(
    S.query(
        S.V3,
        """SELECT doc_id, global_order, type AS raw_type, CASE WHEN type = 'list' THEN 'reference_list' END AS list_type, CASE WHEN type = 'list' AND indexes[1] % 2 = 0 THEN 'r' || indexes[1] ELSE '' END AS refs,
      '{"k":' || page_idx || '}' AS block FROM v3""",
    )
)
def item_lineage(spark, sf):
    kind, at = F.col("type"), F.col("original_index")
    refs = F.when((kind == "list") & (at % 2 == 0), F.array(F.concat(F.lit("r"), at.cast("string"))))
    rows = X.blocks(spark, sf).withColumns({"raw_type": kind, "list_type": F.when(kind == "list", "reference_list"), "reference_items": refs, "block": F.concat(F.lit('{"k":'), F.col("page_idx").cast("string"), F.lit("}"))})
    items = merge.items_v3(layout.reading_order(rows))
    return items.select("doc_id", "global_order", "raw_type", "list_type", F.array_join("reference_items", ",").alias("refs"), "block")


@registered(f"SELECT conv_id, turn, trim(CASE turn % 3 WHEN 0 THEN {_STRIP} || ' x^2 ' || role WHEN 1 THEN role ELSE 'cap ' || {_STRIP} END) AS text FROM conversations")
def nested_text(spark, sf):
    """Other shapes of content than lists: runs of inline pieces, a bare string, and captions beside a body without text."""
    piece = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    c, whole = X.table(spark, sf, "conversations"), lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("type"), body.alias("content")))
    inline = F.struct(F.array(piece("text", F.col("text")), piece("equation_inline", F.lit(" x^2 ")), piece("text", F.concat(F.lit(" "), F.col("role")))).alias("paragraph_content"))
    captions = F.struct(F.array(piece("text", F.lit("cap")), piece("text", F.col("text"))).alias("table_caption"), F.lit("<td>no</td>").alias("html"))
    block = F.when(F.col("turn") % 3 == 0, whole("paragraph", inline)).when(F.col("turn") % 3 == 1, whole("title", F.col("role"))).otherwise(whole("table", captions))
    return c.select("conv_id", "turn", nested.extract_text(block).alias("text"))
