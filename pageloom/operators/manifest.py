"""Manifests: first-seen dedup, resume, quotas, main files, outcomes, counts, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import normalized_id


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by the order; one row a key is kept before anything is shuffled."""
    other = [c for c in rows.columns if c not in (key, order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(order, *other), order).alias("r"))
    return best.select(key, "r.*").select(rows.columns)


def limited(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def unprocessed(rows: DataFrame, processed: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return rows if force else rows.join(processed.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def _range_of(value: Column, ends: list) -> Column:
    """The number of ``ends`` (sorted) that are at most ``value``, by binary search."""
    if not ends:
        return F.lit(0)
    bounds = F.array(*map(F.lit, ends))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(ends)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(ends).bit_length() + 1)), start, halve, lambda s: s["lo"])


def running(rows: DataFrame, value: Column, order: str, name: str, parts: int = 256) -> DataFrame:
    """Running sums over the whole table in the order, without a window over one partition.

    Rows are ranged over about ``parts`` parts, whose ends are values of a bounded sample of the order
    (its lowest hashes), so parts hold about as many rows however the values are spread; sums of the
    parts before are added to sums within a part. ``order`` may be of any type that sorts, and names
    one row each; rows without it come last.
    """
    some = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(16 * parts).collect())
    ends = sorted(set(some[16::16]) if len(some) > 16 else set())
    place = F.when(F.col(order).isNull(), len(ends) + 1).otherwise(_range_of(F.col(order), ends))
    placed = rows.withColumn("_v", value).withColumn("_part", place)
    sums = placed.groupBy("_part").agg(F.sum("_v").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.sum("_v").over(Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_w") + F.col("_b")).drop("_v", "_part", "_w", "_b")


def accept_quota(rows: DataFrame, ok: Column, order: str, target: int, initial: int = 0) -> DataFrame:
    """Accepted rows with accepted_index from initial + 1 up to the target, in the order, rows without it last.

    Only the rows of the quota are numbered; they are taken as a limit, a few of each partition.
    """
    first = rows.where(ok).orderBy(F.col(order).asc_nulls_last()).limit(max(0, target - initial))
    return first.withColumn("accepted_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(order).asc_nulls_last())) + initial)


def success_quota(rows: DataFrame, ok: Column, order: str, target: int, initial: int = 0) -> DataFrame:
    """Rows attempted until the target number of successes is reached, in the order, rows without it last.

    The success that fills the quota is found first, as a limit; only rows up to it are counted.
    """
    okay, wanted = F.coalesce(ok, F.lit(False)), max(0, target - initial)
    last = rows.where(okay).select(order).orderBy(F.col(order).asc_nulls_last()).limit(wanted).agg(F.count("*").alias("n"), F.count(order).alias("known"), F.max(order).alias("at")).first()
    if wanted and last["n"] == last["known"] == wanted:
        rows = rows.where(F.col(order) <= F.lit(last["at"]))
    done = running(rows if wanted else rows.limit(0), okay.cast("int"), order, "_n")
    return done.where(F.col("_n") - okay.cast("int") + initial < target).withColumn("successes", F.col("_n") + initial).drop("_n")


def id_set(records: DataFrame, key: str = "arxiv_id", normalise: bool = True) -> DataFrame:
    """The distinct ids of records: normalised, those that are none left out, or as they stand."""
    raw = F.col(key).cast("string")
    ids = normalized_id(raw) if normalise else F.nullif(raw, F.lit(""))
    return records.select(ids.alias(key)).where(F.col(key).isNotNull()).distinct()


def id_union(*sets: DataFrame) -> DataFrame:
    """The ids that any of the sets holds, once each."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()


#: Names of main files.
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex", "article.tex")


def main_file(files: DataFrame, weights: tuple[int, int, int, int, int], least: int) -> DataFrame:
    """(doc, path, score): the file of the best (score, size, path) of each doc, if its score reaches ``least``.

    ``files`` has doc, path (relative), size, text; weights are for a document class, a begin, an
    end, a known name and a place at the root.
    """
    has = lambda s: F.contains(F.coalesce("text", F.lit("")), F.lit(s)).cast("int")
    name = F.lower(F.substring_index("path", "/", -1))
    signs = (has("\\documentclass"), has("\\begin{document}"), has("\\end{document}"), name.isin(*MAIN_NAMES).cast("int"), (~F.contains("path", F.lit("/"))).cast("int"))
    score = sum((s * w for s, w in zip(signs, weights, strict=True)), F.lit(0))
    scored = files.where(F.col("path").endswith(".tex")).withColumn("score", score)
    best = scored.groupBy("doc").agg(F.max(F.struct("score", "size", "path")).alias("b"))
    return best.select("doc", "b.path", "b.score").where(F.col("score") >= least)


BUILDER, SERIAL = ((20, 20, 10, 5, 3), 20), ((10, 10, 5, 0, 2), 10)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def outcome(present: Column, download: Column, permanent: Column, unpacked: Column, has_main: Column, compiled: Column) -> Column:
    """Status of a candidate from what each step gave; the first that decides counts. compiled: ok, failed, timeout or error."""
    return (
        F.when(present, "already_present")
        .when(~download, F.when(permanent, "source_not_found").otherwise("download_error"))
        .when(~unpacked, "error")
        .when(~has_main, "no_main_tex")
        .when(compiled == "ok", "accepted")
        .when(compiled == "timeout", "timeout")
        .when(compiled == "failed", "compile_failed")
        .otherwise("error")
    )


def log_of(status: Column) -> Column:
    """The log that a status goes to."""
    return (
        F.when(status.isin("accepted", "already_present"), "accepted")
        .when(status == "download_error", "transient")
        .when(status == "skipped_target_reached", F.lit(None))
        .otherwise("rejected")
    )


def scan_months(raw: str) -> list[int]:
    """``"01,02"`` -> [1, 2]; blanks are skipped, others must be months, and one must be there."""
    months = [int(p) for p in raw.split(",") if p.strip()]
    if not months or any(not 1 <= m <= 12 for m in months):
        raise ValueError(f"no months, or not from 1 to 12: {raw}")
    return months


def id_scan(spark, year: int, months: str, first: int, last: int, limit: int) -> DataFrame:
    """Generated ids, months in the order given, then numbers; the limit is applied by arithmetic, not by a sort."""
    if first < 1 or last < first:
        raise ValueError("numbers must run from 1 or more upwards")
    listed, n = scan_months(months), last - first + 1
    month = F.get(F.array(*[F.lit(m) for m in listed]), (F.col("id") / n).cast("int"))
    rows = spark.range(min(limit, n * len(listed)))
    paper = F.format_string("%02d%02d.%05d", F.lit(year % 100), month, F.lit(first) + F.col("id") % n)
    return rows.select(F.col("id").alias("position"), paper.alias("arxiv_id"), F.format_string("%d-%02d", F.lit(year), month).alias("created"))


def pool_union(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Pool rows: manifest rows that were fetched and whose folder is listed, first seen; then other folders as scanned.

    manifest: line, arxiv_id, status; listing: arxiv_id (folder names).
    """
    fetched = manifest.where(F.col("status").isin("downloaded", "already_present") & (F.col("arxiv_id") != ""))
    kept = first_seen(fetched.join(listing.select("arxiv_id").distinct(), "arxiv_id", "left_semi").select("line", "arxiv_id", "status"), "arxiv_id", "line")
    rest = unprocessed(listing.select("arxiv_id").distinct(), kept, "arxiv_id").select(F.lit(None).cast("long").alias("line"), "arxiv_id", F.lit("scanned_pool").alias("status"))
    return kept.unionByName(rest)
