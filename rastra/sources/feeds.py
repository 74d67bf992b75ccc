"""Parsers of pages and reports, and the assembly of files from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.sources.files import table_rows


def leaderboard(pages: DataFrame, strict: bool = True) -> DataFrame:
    """page_id, rank, participant, score of the table rows that start with a rank and hold exactly one score.

    strict: reading raises for a page whose ranks repeat or don't start at 1 or whose scores don't fall with the rank; a feed
    then keeps its last good state. A leaderboard is one page, so its rows are one group.
    """
    rows = table_rows(pages).withColumn("scores", F.filter(F.slice("cells", 2, 1000), lambda c: c.rlike(r"^(?:0|1)\.\d{4,}$")))
    rows = rows.where(F.get("cells", F.lit(0)).rlike(r"^#?\d+$") & (F.size("scores") == 1))
    name = F.when(F.size("cells") >= 4, F.get("cells", F.lit(2))).otherwise(F.get("cells", F.lit(1)))
    out = rows.select("page_id", "row_no", F.ltrim(F.get("cells", F.lit(0)), F.lit("#")).cast("int").alias("rank"), name.alias("participant"), F.get("scores", F.lit(0)).cast("double").alias("score"))
    if not strict:
        return out.drop("row_no")
    w = Window.partitionBy("page_id").orderBy("row_no")
    before = F.lag("score").over(w)
    wrong = ((F.row_number().over(w) == 1) & (F.col("rank") != 1)) | (before < F.col("score")) | (F.count("*").over(Window.partitionBy("page_id", "rank")) > 1) | (F.col("score") > 1)
    checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("no valid leaderboard table")).cast("int")).otherwise(F.col("rank"))
    return out.select("page_id", checked.alias("rank"), "participant", "score")


def owner_reports(lines: DataFrame, key: str, order: str, line: str, site: str) -> DataFrame:
    """key, repo, file, score: lines `file: score` (the score may be missing) after a line that names a page of the site, whose
    first path segment is the repo they belong to; each once. A key is one report's text."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.nullif(F.regexp_extract(line, site + r"([^/\s)]+)", 1), F.lit(""))
    item = r"^\s*([^\s:]+):\s*(0\.\d+)?\s*$"
    out = lines.withColumn("repo", F.last(named, ignorenulls=True).over(w)).where(F.col("repo").isNotNull() & F.col(line).rlike(item))
    score = F.nullif(F.regexp_extract(line, item, 2), F.lit("")).cast("double")
    return out.select(key, "repo", F.regexp_extract(line, item, 1).alias("file"), score.alias("score")).distinct()


def assembled(parts: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """key, parts, bytes, sha256 of every file put together from its parts in order. A file's parts are one group: they are what
    one file holds."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda p: p[content]), "")
    out = parts.groupBy(key).agg(F.count("*").alias("parts"), F.sum(F.octet_length(content)).alias("bytes"), joined.alias("_t"))
    return out.select(key, "parts", "bytes", F.sha2("_t", 256).alias("sha256"))
