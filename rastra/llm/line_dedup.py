"""Corpus-wide line dedup on levelled sorted runs of line hashes (DataFrame functions only).

Every run is a table of (h1, h2, owner), bucketed and sorted by the hash, that holds each of its keys once with the
smallest document that has it. A batch of documents, older ids first, reduces its lines to one row for each key,
merge-anti-joins every run (the runs' buckets are read in place, only the batch is shuffled) and is written as a new run
of level 0. As soon as a level has `fanout` runs they are compacted into one run of the next level, so a batch meets a
number of runs that grows with the logarithm of the batches.

A line survives where its document owns its key, so the way back to the documents needs one row for each distinct key,
sent to its owner; occurrences of a common line are never brought together. Only rows without a doc_id, one owner together,
look their lines up one by one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import SPACE_CHARS, ascii_lower, boxed, shuffle_width, with_text
from rastra.storage import drop_staged, new_path, remove_path, stage_table

_KEY = ["h1", "h2"]
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """The levels of sorted runs; add(batch) must get batches in ascending order of their documents. Runs are bucketed tables
    with a path of their own in the shared folder; drop() when nothing reads them any more."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def tables(self) -> list[str]:
        return [t for level in reversed(self.levels) for t in level]

    def _write(self, keys: DataFrame) -> str:
        name = f"rastra_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        keys.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        return name

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        remove_path(self.spark, self.paths.pop(table))

    def drop(self) -> None:
        for table in self.tables():
            self._forget(table)
        self.levels = []

    def add(self, lines: DataFrame) -> None:
        """lines: h1, h2, id. Keys that no run has become a new run."""
        fresh = lines.groupBy(*_KEY).agg(F.min("id").alias("owner"))
        for table in self.tables():
            fresh = fresh.join(self.spark.table(table).hint("merge"), _KEY, "left_anti")
        run, level = self._write(fresh), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged, self.levels[level] = self.levels[level], []
            run, level = self._write(self._all(merged).repartition(self.buckets, *_KEY)), level + 1
            for table in merged:
                self._forget(table)

    def _all(self, tables: list[str]) -> DataFrame:
        out = self.spark.table(tables[0])
        for table in tables[1:]:
            out = out.unionByName(self.spark.table(table))
        return out

    def owners(self) -> DataFrame:
        """h1, h2, owner: each key once."""
        return self._all(self.tables())


def _doc_lines(docs: DataFrame, min_chars: int, id_col: str = "_id") -> DataFrame:
    keys = docs.select(id_col, F.explode(F.split("text", "\n", -1)).alias("line")).select(id_col, line_key(F.col("line")).alias("k"))
    return keys.where(F.length("k") >= min_chars).select(F.xxhash64("k").alias("h1"), F.hash("k").alias("h2"), F.col(id_col).alias("id"))


def owned_lines(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """_id, _part and _cells: the hashes of the keys that document owns, as sqrt(n)-sized cells so that a lookup stays short.

    The rows without a doc_id own their keys together, but can be any number: there _part is the hash of a row's text, and
    _cells has only the owned keys that text has. (If two texts' hashes are equal, each finds its own keys among both's.)
    """
    bounds = docs.select(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    batch = sum((F.when(F.col("id") > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    lines = stage_table(_doc_lines(docs, min_chars).withColumn("batch", batch), "lines", ("batch",))
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(len(set(bounds)) + 1):
        runs.add(lines.where(F.col("batch") == b).select("h1", "h2", "id"))
    owners = runs.owners()
    owned = owners.where(F.col("owner") < _LAST).select(F.col("owner").alias("_id"), F.lit(0).cast("long").alias("_part"), "h1")
    last = _doc_lines(docs.where(F.col("doc_id").isNull() | (F.col("doc_id") == _LAST)), min_chars, "_part").distinct()
    last = last.join(owners.where(F.col("owner") == _LAST).select(*_KEY).hint("merge"), _KEY, "left_semi")
    owned = owned.unionByName(last.select(F.lit(_LAST).alias("_id"), F.col("id").alias("_part"), "h1"))
    owned = owned.groupBy("_id", "_part").agg(F.collect_list("h1").alias("_h"))
    owned = owned.withColumn("_n", F.ceil(F.sqrt(F.size("_h") / F.lit(64))).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.filter("_h", lambda h: F.pmod(h, F.col("_n").cast("long")) == b))
    owned = stage_table(owned.select("_id", "_part", cells.alias("_cells")), "owned")
    runs.drop()
    drop_staged(lines)
    return owned


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """row (all columns of docs), doc_id, text, lines and kept (arrays): keys of at least min_chars stay in their smallest
    document only.

    Null and empty texts are one empty line. All lines with the same key in the owning document stay. Rows that repeat a
    doc_id are one document; rows without a doc_id are one document after all others. Very long texts are split whole. An
    empty table gives no rows.
    """
    docs = boxed(docs, id_col, text_col).withColumn("_id", F.coalesce("doc_id", F.lit(_LAST)))
    docs = docs.withColumn("_part", F.when(F.col("_id") == _LAST, F.xxhash64("text")).otherwise(0))
    owned = owned_lines(docs.select("_id", "_part", "doc_id", "text"), min_chars, batches, fanout)
    joined = docs.join(owned, ["_id", "_part"], "left").withColumn("lines", F.split("text", "\n", -1))

    def owns(h: Column) -> Column:
        return F.array_contains(F.element_at("_cells", (F.pmod(h, F.size("_cells").cast("long")) + 1).cast("int")), h)

    def stays(line: Column) -> Column:  # exists(array(x), f) evaluates x once
        long_and_owned = lambda k: (F.length(k) < min_chars) | F.exists(F.array(F.xxhash64(k)), owns)
        return F.exists(F.array(line_key(line)), long_and_owned)

    kept = F.when(F.col("_cells").isNull(), F.filter("lines", lambda x: F.length(line_key(x)) < min_chars)).otherwise(F.filter("lines", stays))
    return joined.select("row", "doc_id", "text", "lines", kept.alias("kept"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, same columns, with text's repeated lines dropped; a document stays even if no line does. Nulls, repeated rows,
    rows without a doc_id and empty tables as in drop_repeated_lines; a text that loses nothing is left as it is, null too."""
    out = drop_repeated_lines(docs)
    return with_text(out, docs, F.when(F.size("kept") == F.size("lines"), F.col("row.text")).otherwise(F.array_join("kept", "\n")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drop_repeated_lines on all documents, as digests; null and empty texts are one empty line, other odd rows as there."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT doc_id, pos, line, (length(k) < 10 OR owner = doc_id) AS stays
  FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
