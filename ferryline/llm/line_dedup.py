"""Line dedup across sites, with DataFrame functions only.

For every distinct line a HyperLogLog sketch of the sites it occurs on, made where the lines are and merged by aggregation,
so a line on a third of all pages leaves a task as one sketch. Lines whose estimate is near the threshold
are counted exactly; the others are decided by the sketch. Lines on at least ``min_sites`` sites are boilerplate and are
removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, read_documents

_LG_K = 10
#: An estimate further than this share from the threshold is over nine standard errors (3.25 % at 2**10 registers) away.
NEAR = 0.3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_sites(lines: DataFrame, min_sites: int) -> DataFrame:
    """(hash_a, hash_b) of the lines of ``lines(hash_a, hash_b, site)`` on at least ``min_sites`` sites."""
    key = ["hash_a", "hash_b"]
    spread = lines.where("site is not null").groupBy(*key).agg(F.hll_sketch_agg("site", F.lit(_LG_K)).alias("sketch")).select(*key, F.hll_sketch_estimate("sketch").alias("sites"))
    spread, _ = materialize(spread.where(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select(*key)
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR)).select(*key)
    counted = lines.where("site is not null").join(near, key, "left_semi").groupBy(*key).agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(counted.select(*key))


def site_line_dedup(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """Remove the lines that occur on at least ``min_sites`` different sites.

    Lines are compared without the blanks around them; blank lines always stay. Returns (doc_id, n_lines,
    n_removed, kept_sha256), one row per input row; kept lines, unchanged, are joined by newlines.

    * null and empty texts are one blank line; a text may lose all its lines and becomes empty;
    * a very long text has one row for each line until its lines are gathered again, in one task;
    * a null site is no site, though lines of its documents are removed like others;
    * a null doc_id stays null, and repeated rows give repeated rows: rows are told apart by doc_id and text;
    * an empty table gives an empty result; further columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(site).cast("string").alias("site")).withColumn("key", F.xxhash64("text"))
    trimmed = F.transform(_lines(F.col("text")), lambda x: F.trim(x))
    lines = base.select("doc_id", "key", "site", F.posexplode(trimmed).alias("at", "line")).where("line <> ''")
    lines, _ = materialize(lines.select("doc_id", "key", "site", "at", F.xxhash64(F.lit(1), "line").alias("hash_a"), F.xxhash64(F.lit(2), "line").alias("hash_b")), "lines")
    common, _ = materialize(line_sites(lines, min_sites), "common")
    gone = lines.join(common, ["hash_a", "hash_b"], "left_semi").groupBy("doc_id", "key").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "gone")
    rows = base.join(gone, base["doc_id"].eqNullSafe(F.col("g_id")) & (base["key"] == F.col("g_key")), "left")
    rows = rows.select("doc_id", "text", "gone", _lines(F.col("text")).alias("parts"))
    # A difference of sets of places, so that the work grows with the lines of a text, not with their square.
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_line_dedup(read_documents(spark, sf_dir), site="source", min_sites=10)


OP8_SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT r, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM t),
c AS (SELECT trim(line, ' ') AS norm FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT r, line, k, norm IS NOT NULL AS gone FROM l LEFT JOIN c ON trim(line, ' ') = norm)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN t USING (r) GROUP BY r, doc_id
"""
