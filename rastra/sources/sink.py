"""A sink in two phases: a surface is staged beside its place, read back and checked again, and then put there by one rename.

The receipt lies in the same folder, so it comes and goes with the surface. Whatever fails before the rename, a check, a task or
the driver, leaves nothing at the path; a staging folder that a lost driver leaves behind has a name of its own and is never read.
On a file system whose rename is not atomic (object stores) the path must be read through a table or a receipt instead.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.validate import assert_valid, checks
from rastra.sources.files import hashed_files
from rastra.storage import remove_path

RECEIPT = "_receipt.json"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fingerprint(cells: DataFrame) -> DataFrame:
    """One row: n_cells, n_positive, total (the values' sum) and content, a sum of row hashes that doesn't depend on the order."""
    content = F.sum(F.xxhash64("row", "col", "value").cast("decimal(38,0)"))
    return cells.agg(F.count("*").alias("n_cells"), F.count_if(F.col("value") > 0).alias("n_positive"), F.sum("value").alias("total"), content.alias("content"))


def commit_surface(
    cells: DataFrame, path: str, grid: GridSpec, name: str, note: str, footprint: DataFrame | None = None, catalogue: DataFrame | None = None, metadata: dict[str, str] | None = None,
) -> dict:
    """Write row, col, value as tiles at path, and return the receipt.

    Raises ValueError for a name or note that is blank or longer than 140 characters, a failed check (validate.checks, and no
    positive cell outside the footprint), or a surface that is not the same when it is read back; FileExistsError for a path that is
    there already. Values are never repaired.
    """
    spark = cells.sparkSession
    for what, text in (("name", name), ("note", note)):
        if not text.strip() or len(text) > 140:
            raise ValueError(f"{what} must have 1 to 140 characters")
    fs, final = _file_system(spark, path)
    if fs.exists(final):
        raise FileExistsError(path)
    cells = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        tiles = {f"tile_{c}": F.floor(F.col(c) / 256).cast("int") for c in ("row", "col")}
        cells.withColumns(tiles).repartition("tile_row", "tile_col").write.partitionBy("tile_row", "tile_col").parquet(staging)
        back = spark.read.schema("row int, col int, value double").parquet(staging).select("row", "col", "value")
        assert_valid(checks(back, grid, catalogue))
        if footprint is not None and back.where("value > 0").join(footprint.select("row", "col"), ["row", "col"], "left_anti").limit(1).count():
            raise ValueError("failed checks: inside_footprint")
        before, after = fingerprint(cells).first(), fingerprint(back).first()
        if (before["n_cells"], before["n_positive"], before["content"]) != (after["n_cells"], after["n_positive"], after["content"]):
            raise ValueError("the surface changed while it was written")
        digest = hashed_files(spark, staging, "*.parquet").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"), F.bit_xor(F.xxhash64("sha256")).alias("files_hash")).first()
        receipt = {
            "name": name, "note": note, "n_cells": after["n_cells"], "n_positive": after["n_positive"], "total": after["total"], "content": str(after["content"]),
            "bytes": digest["bytes"], "files": digest["files"], "files_hash": digest["files_hash"], "grid": [grid.height, grid.width], "metadata": metadata or {},
        }
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/{RECEIPT}"), False)
        try:
            out.write(bytearray(json.dumps(receipt, allow_nan=False).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(_file_system(spark, staging)[1], final):
            raise FileExistsError(path)
        return receipt
    except BaseException:
        remove_path(spark, staging)
        raise


def read_receipt(spark: SparkSession, path: str) -> dict:
    """The receipt of a committed surface. Raises ValueError where the files are not those that it names."""
    fs, where = _file_system(spark, f"{path}/{RECEIPT}")  # Spark's readers don't see files of such names
    stream = fs.open(where)
    try:
        receipt = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    found = hashed_files(spark, path, "*.parquet").agg(F.bit_xor(F.xxhash64("sha256")).alias("h")).first()["h"]
    if found != receipt["files_hash"]:
        raise ValueError(f"the files at {path} are not those of the receipt")
    return receipt
