"""Inputs of the reference queries, derived from whole tables: layout blocks, manifests, raw spans, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Literal documents that reach branches the derived blocks don't: (doc, page, index, type, text, x0, y0, x1, y1).
LITERAL = (
    (-1, 0, 0, "paragraph", "Alpha ends.", 80, 60, 480, 180), (-1, 0, 1, "paragraph", "Beta ends.", 80, 200, 480, 320),
    (-1, 0, 2, "paragraph", "Gamma ends.", 520, 60, 920, 180), (-1, 0, 3, "paragraph", "delta continues", 520, 760, 920, 880),
    (-1, 1, 0, "paragraph", "epsilon goes", 80, 60, 480, 180), (-1, 1, 1, "paragraph", "zeta here", 520, 60, 920, 180),
    (-1, 1, 2, "title", "Part Two", 120, 400, 880, 440), (-1, 1, 3, "paragraph", "Eta ends.", 80, 500, 480, 620),
    (-1, 1, 4, "paragraph", "Theta ends.", 520, 500, 920, 620), (-2, 0, 0, "paragraph", "one goes", 80, 100, 480, 160),
    (-2, 0, 1, "paragraph", "two goes", 520, 100, 920, 160), (-2, 0, 2, "paragraph", "three ends.", 520, 170, 920, 230),
    (-2, 0, 3, "title", "Part Three", 120, 400, 880, 440), (-2, 0, 4, "paragraph", "Left ends.", 80, 500, 480, 620),
    (-2, 0, 5, "paragraph", "Right ends.", 520, 500, 920, 620), (-3, 0, 0, "paragraph", "one al-", 80, 60, 480, 120),
    (-3, 0, 1, "table", "", 80, 150, 480, 210), (-3, 0, 2, "paragraph", "pha two be-", 80, 240, 480, 300),
    (-3, 0, 3, "table", "", 80, 330, 480, 390), (-3, 0, 4, "paragraph", "ta three ga-", 80, 420, 480, 480),
    (-3, 0, 5, "table", "", 80, 510, 480, 570), (-3, 0, 6, "paragraph", "mma four.", 80, 600, 480, 660),
    (-4, 0, 0, "paragraph", "items:", 80, 60, 480, 80), (-4, 0, 1, "paragraph", "(1) one.", 120, 100, 480, 120),
    (-4, 0, 2, "paragraph", "（二）two.", 120, 140, 480, 160), (-4, 0, 3, "list", "三、three.", 70, 180, 480, 200),
    (-4, 0, 4, "paragraph", "第四，four.", 120, 220, 480, 240), (-4, 0, 5, "paragraph", "xiv) five.", 120, 260, 480, 280),
    (-4, 0, 6, "list", "• six.", 120, 300, 480, 320), (-4, 0, 7, "table", "", 120, 340, 480, 360), (-4, 0, 8, "paragraph", "- seven.", 120, 380, 480, 400),
)
COLUMNS = "doc_id long, page_idx int, original_index int, type string, text string, x0 double, y0 double, x1 double, y1 double"
BLOCK = "page_idx:int,original_index:int,type:string,text:string,x0:double,y0:double,x1:double,y1:double"
#: Bytes of text of a task where documents are partitioned, and what a line counts for besides its bytes.
TASK_BYTES, LINE_BYTES = 8 << 20, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work on each text, dealt over the cores if its files make fewer tasks than that."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.rdd().getNumPartitions() < cores else docs


def by_document(docs: DataFrame, size: Column) -> DataFrame:
    """Documents partitioned by doc_id, in so many parts that a task has about TASK_BYTES, and in as many as there are cores at least.

    What is taken from a document later stays in its partition, so lines or words needn't be shuffled,
    and the memory of a task doesn't grow with the table. The sizes are summed for that in a pass.
    """
    total = docs.agg(F.sum(size)).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK_BYTES)), "doc_id")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks: a row for each line of ``documents``, and the literal documents; partitioned by document once, as whole documents."""
    literal: dict[int, list] = {}
    for r in LITERAL:
        literal.setdefault(r[0], []).append((*r[1:5], *map(float, r[5:])))
    made = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast(f"array<struct<{BLOCK}>>").alias("given"))
    given = spark.createDataFrame([(k, None, v) for k, v in literal.items()], f"doc_id long, text string, given array<struct<{BLOCK}>>")
    size = F.coalesce(F.octet_length("text") + LINE_BYTES * (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))), F.lit(0))
    docs = by_document(made.unionByName(given), size.cast("long"))
    lines = docs.select("doc_id", "given", F.posexplode(F.coalesce("given.text", F.split("text", "\n"))).alias("pos", "t"))
    h, bare = (F.col("doc_id") * 7919 + F.col("pos") * 10427) % 1000, F.expr("trim(trailing '.!?' from t)")
    slot, ten, seven = F.col("pos") % 12, h % 10, h % 7
    kind = F.when(ten == 0, "title").when(ten == 1, "table").when(ten == 2, "list").when(ten == 3, "page_number").otherwise("paragraph")
    text = F.when(ten == 1, "").when(seven == 0, F.concat(F.lit("1. "), "t")).when(seven == 1, F.concat(bare, F.lit("-"))).when(seven.isin(2, 3), bare).when(seven == 4, F.concat(bare, F.lit(":"))).otherwise(F.col("t"))
    y0 = 60 + F.expr("pos % 12 div 2") * 140 + h % 9
    fields = {
        "page_idx": F.expr("pos div 12").cast("int"), "original_index": slot.cast("int"), "type": kind, "text": F.trim(text),
        "x0": F.when(ten == 0, 120).when(slot % 2 == 0, 80).otherwise(520).cast("double"), "y0": y0.cast("double"),
        "x1": F.when(ten == 0, 880).when(slot % 2 == 0, 480).otherwise(920).cast("double"), "y1": (y0 - h % 9 + 120).cast("double"),
    }
    return lines.select("doc_id", *[F.when(F.col("given").isNotNull(), F.get("given", F.col("pos"))[c]).otherwise(v).alias(c) for c, v in fields.items()])


BLOCKS_SQL = f"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
hashed AS (SELECT *, (doc_id * 7919 + pos * 10427) % 1000 AS h, rtrim(t, '.!?') AS bare, pos % 12 AS slot FROM lines),
blocks AS (
  SELECT doc_id, CAST(pos // 12 AS INTEGER) AS page_idx, CAST(slot AS INTEGER) AS original_index,
    CASE h % 10 WHEN 0 THEN 'title' WHEN 1 THEN 'table' WHEN 2 THEN 'list' WHEN 3 THEN 'page_number' ELSE 'paragraph' END AS type,
    trim(CASE WHEN h % 10 = 1 THEN '' WHEN h % 7 = 0 THEN '1. ' || t WHEN h % 7 = 1 THEN bare || '-' WHEN h % 7 IN (2, 3) THEN bare WHEN h % 7 = 4 THEN bare || ':' ELSE t END) AS text,
    CAST(CASE WHEN h % 10 = 0 THEN 120 WHEN slot % 2 = 0 THEN 80 ELSE 520 END AS DOUBLE) AS x0, CAST(60 + (slot // 2) * 140 + h % 9 AS DOUBLE) AS y0,
    CAST(CASE WHEN h % 10 = 0 THEN 880 WHEN slot % 2 = 0 THEN 480 ELSE 920 END AS DOUBLE) AS x1, CAST(60 + (slot // 2) * 140 + 120 AS DOUBLE) AS y1
  FROM hashed
  UNION ALL
  SELECT d, p, i, t, s, CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(e AS DOUBLE) FROM (VALUES {", ".join(map(str, LITERAL))}) v(d, p, i, t, s, a, b, c, e))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata lines from ``orders``: line, raw id (repeated, versioned, in a URL or malformed), dates, status."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    paper = F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad((key % 1000).cast("string"), 5, "0"))
    raw = F.when(key % 5 == 1, F.concat(paper, F.lit("v2"))).when(key % 5 == 2, F.concat(F.lit(" http://x.org/abs/"), paper, F.lit("v1/ "))).when(key % 5 == 3, F.concat(F.lit("hep-th/"), (key % 1000).cast("string"))).otherwise(paper)
    versions = F.when(key % 3 == 0, F.array(F.struct(F.concat(F.lit("Mon, 2 Apr "), F.date_format("o_orderdate", "yyyy"), F.lit(" 19:18 GMT")).alias("created"))))
    return o.select(key.alias("line"), raw.alias("raw_id"), paper.alias("paper"), F.when(key % 7 != 0, day).otherwise("n/a").alias("update_date"), versions.alias("versions"), F.col("o_orderstatus").alias("status"))


MANIFEST_SQL = """
manifest AS (
  SELECT line, paper, status, CASE WHEN line % 7 <> 0 THEN day ELSE 'n/a' END AS update_date, CASE WHEN line % 3 = 0 THEN 'Mon, 2 Apr ' || yyyy || ' 19:18 GMT' END AS created,
    CASE line % 5 WHEN 1 THEN paper || 'v2' WHEN 2 THEN ' http://x.org/abs/' || paper || 'v1/ ' WHEN 3 THEN 'hep-th/' || (line % 1000) ELSE paper END AS raw_id
  FROM (SELECT o_orderkey AS line, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y') AS yyyy,
    strftime(o_orderdate, '%y%m') || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') AS paper FROM orders)),
ids AS (
  SELECT *, CASE WHEN regexp_matches(bare, '^[0-9]{4}[.][0-9]{4,5}$') THEN bare END AS arxiv_id
  FROM (SELECT *, regexp_replace(list_extract(string_split(rtrim(trim(raw_id), '/'), '/'), -1), 'v[0-9]+$', '') AS bare FROM manifest))"""

FONTS = ("times", "times-bold", "cmmi10", "courier", "ABCDEF+NimbusRomNo9L-Regu", "symbolmt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``, partitioned by document."""
    return by_document(table(spark, sf_dir, "documents").select("doc_id", "text"), F.octet_length("text").cast("long"))


def raw_spans(docs: DataFrame) -> DataFrame:
    """Raw spans: words of the documents in order, with font, size and flags by an integer hash."""
    words = docs.select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("pos", "text")).where("text <> ''")
    h = (F.col("doc_id") * 31 + F.expr("pos div 3") * 17) % 97
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.get(F.array(*map(F.lit, FONTS)), (h % 6).cast("int")).alias("raw_font"), (8.25 + (h % 7) * 0.25).alias("size"), ((h * 3) % 32).cast("int").alias("flags"))


SPANS_SQL = f"""
words AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS text, generate_subscripts(regexp_split_to_array(text, '[ \\n]+'), 1) - 1 AS pos FROM documents),
raw_spans AS (
  SELECT doc_id, pos, text, list_extract({list(FONTS)}, CAST(h % 6 + 1 AS INTEGER)) AS raw_font, 8.25 + (h % 7) * CAST(0.25 AS DOUBLE) AS size, CAST((h * 3) % 32 AS INTEGER) AS flags
  FROM (SELECT *, (doc_id * 31 + (pos // 3) * 17) % 97 AS h FROM words WHERE text <> ''))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source folder: documents grouped by source, with TeX signs by an integer rule."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    name = F.when(k % 11 == 0, "main.tex").when(k % 11 == 1, "sub/Paper.tex").when(k % 11 == 2, "notes.txt").otherwise(F.concat(F.lit("part"), k.cast("string"), F.lit(".tex")))
    signs = F.concat(F.when(k % 4 == 0, "\\documentclass{article}\n").otherwise(""), F.when(k % 6 < 2, "\\begin{document}\n").otherwise(""), F.when(k % 9 == 0, "\\end{document}\n").otherwise(""))
    return d.select(F.col("source").alias("doc"), name.alias("path"), F.length("text").cast("long").alias("size"), F.concat(signs, "text").alias("text"))


FILES_SQL = r"""
files AS (
  SELECT source AS doc, CASE doc_id % 11 WHEN 0 THEN 'main.tex' WHEN 1 THEN 'sub/Paper.tex' WHEN 2 THEN 'notes.txt' ELSE 'part' || doc_id || '.tex' END AS path, CAST(length(text) AS BIGINT) AS size,
    (CASE WHEN doc_id % 4 = 0 THEN '\documentclass{article}' ELSE '' END) || (CASE WHEN doc_id % 6 < 2 THEN '\begin{document}' ELSE '' END) || (CASE WHEN doc_id % 9 = 0 THEN '\end{document}' ELSE '' END) || text AS text
  FROM documents)"""
