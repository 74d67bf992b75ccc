"""Sources and sinks: trace CSV, registry records, web pages, leaderboard rows, hashed files, and surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.validate import assert_valid, checks

TRACES = "record_id int, x0 double, y0 double, x1 double, y1 double, sense string"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace CSV with an explicit schema; row_no orders the rows of a file, later ones last."""
    rows = spark.read.csv(path, schema=TRACES, header=True, mode="FAILFAST")
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of all files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def prior_files(spark: SparkSession, roots: list[str], pattern: str = "*", exclude: str | None = None, own: DataFrame | None = None, least_bytes: int = 0) -> DataFrame:
    """sha256, bytes, path, copies of the contents below several roots: the first path of each and how many files hold it. Left out are
    files of fewer than least_bytes, paths that match exclude (inputs, say), and every copy of the candidate's own contents
    (own: sha256), whatever their names. A root that is missing raises."""
    files = hashed_files(spark, roots[0], pattern)
    for root in roots[1:]:
        files = files.unionByName(hashed_files(spark, root, pattern))
    files = files.distinct().where(F.col("bytes") >= least_bytes)  # roots may lie in one another
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    if own is not None:
        files = files.join(own.select("sha256").distinct(), "sha256", "left_anti")
    return files.groupBy("sha256", "bytes").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def require_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files; reading it raises, with the first name, where an expected file (name, sha256) is missing or has another content. files:
    path, sha256; a file's name is the end of its path."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("_found"))
    odd = expected.select("name", "sha256").join(found, "name", "left").where(F.col("_found").isNull() | (F.col("_found") != F.col("sha256")))
    text = F.min(F.concat("name", F.when(F.col("_found").isNull(), ": missing").otherwise(": another content")))
    checked = odd.agg(text.alias("_odd")).select(F.when(F.col("_odd").isNotNull(), F.raise_error(F.col("_odd")).cast("int")).otherwise(0).alias("_ok"))
    return files.join(F.broadcast(checked)).where("_ok = 0").drop("_ok")  # one row


def blob_id(content: str) -> Column:
    """The object id git gives to a blob: SHA-1 of its header and bytes."""
    data = F.col(content).cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Records of a registry: a bare list, or an object with rasters and a certificate; a bare list is never complete."""
    df = spark.read.json(path, multiLine=True)
    if "rasters" not in df.columns:
        return df.withColumn("complete", F.lit(False))
    done = F.coalesce(F.col("complete_accessible_scan"), F.lit(False)) & (F.size(F.coalesce(F.col("errors").cast("array<string>"), F.array().cast("array<string>"))) == 0)
    return df.select(F.explode("rasters").alias("r"), done.alias("complete")).select("r.*", "complete")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, n_links, n_headings, title: what a page review needs, by regular expressions."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        F.size(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("n_links"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?i)<h[12][^>]*>"), F.lit(0))).alias("n_headings"),
        F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
    )


def broken_anchors(pages: DataFrame) -> DataFrame:
    """page_id, anchor: local links to an id that the page does not have."""
    html = F.coalesce("html", F.lit(""))
    found = lambda p: F.array_distinct(F.regexp_extract_all(html, F.lit(p), F.lit(1)))
    missing = F.array_except(found(r'(?i)href="#([^"]+)"'), found(r'(?i)\sid="([^"]+)"'))
    return pages.select("page_id", F.explode(missing).alias("anchor"))


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, row_no, cells (array): the cells of every table row, tags removed."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<tr[^>]*>(.*?)(?=<tr|</tr|</table|$)"), F.lit(1))).alias("row_no", "r"))
    cells = F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)(?=<t[dh]|</t[dh]|$)"), F.lit(1))
    return rows.select("page_id", "row_no", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("cells"))


def write_surface(cells: DataFrame, path: str, grid: GridSpec, catalogue: DataFrame | None = None) -> None:
    """Check, then write a surface as Parquet in tiles of 256 x 256; fails on a failed check or an existing path."""
    assert_valid(checks(cells, grid, catalogue))
    tiles = {f"tile_{c}": (F.col(c) / 256).cast("int") for c in ("row", "col")}
    cells.withColumns(tiles).repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").mode("errorifexists").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines; fails on NaN, which JSON does not have."""
    floats = [c for c, t in report.dtypes if t in ("double", "float")]
    if floats and report.where(" or ".join(f"isnan(`{c}`)" for c in floats)).limit(1).count():
        raise ValueError("a report must not hold NaN")
    report.write.mode("errorifexists").json(path)
