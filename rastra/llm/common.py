"""Helpers shared by the text operators: column handling and ASCII text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all text contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts read as empty; all other columns are pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text as in doc_rows, and row: all columns as one struct, so that no working column can clash with them."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(whole, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unboxed(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns names of row, some of them changed."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])


def with_text(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The rows of df with the columns of docs and a new text; n_chars, where there is one, follows it."""
    df = df.select("row", text.alias("new_text"))  # evaluated once, for both columns
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return unboxed(df, docs.columns, **changed)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() gives the same where no other character has a lower case, and is many times as fast. Code
    points that Java does not know yet (Cn) may be known to lower(); the tests try every code point."""
    other = text.rlike("[\\x{80}-\\x{10FFFF}&&[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}\\p{Cn}]]")
    return F.when(other, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def ascii_words(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased. bytes.lower and bytes.split know ASCII only, which is the rule here."""
    return text.encode("utf-8", "surrogatepass").lower().split()
