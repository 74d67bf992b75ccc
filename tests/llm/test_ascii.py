from pyspark.sql import functions as F

from rastra.llm.common import ascii_lower


def test_ascii_lower_changes_no_other_code_point(spark):
    """Every code point but the surrogates, which no string holds."""
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    lowered = points.select("id", "c", ascii_lower(F.col("c")).alias("low"), ascii_lower(F.concat(F.lit("A"), "c")).alias("pair"))
    wanted = F.when(F.col("id").between(65, 90), F.char(F.col("id") + 32)).otherwise(F.col("c"))
    assert lowered.where((F.col("low") != wanted) | (F.col("pair") != F.concat(F.lit("a"), wanted))).count() == 0
    assert lowered.where("length(c) = 1").count() == 0x10FFFF - 2048 - 1  # U+FEFF is read as a mark of byte order
