"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is the multiset of its words; a word's weight is its count. For sample i and word k, r and c are Gamma(2, 1)
and b is uniform, all drawn from hashes of (k, i). With t = floor(ln(weight) / r + b) and
ln(a) = ln(c) - r * (t - b) - r, the word of least a and its t are the i-th entry. Two documents agree in an entry with
a probability equal to the sum of minima over the sum of maxima of their weights (generalised Jaccard similarity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.llm.common import ascii_lower, doc_rows, shuffle_width

SAMPLES = 24
_LOW21, _LOW32 = (1 << 21) - 1, (1 << 32) - 1
#: ln(a) as a fixed-point number of 31 bits: ln(a) lies well within 128 of zero.
_SHIFT, _SCALE, _TOP = 128.0, float(1 << 22), (1 << 31) - 1


def word_hashes(text: Column) -> Column:
    """The hashes of all words, sorted."""
    words = F.filter(F.split(ascii_lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def with_terms(df: DataFrame, text_col: str) -> DataFrame:
    """Rows of df with (term, weight) exploded; texts without words keep one row with nulls."""
    df = df.withColumn("_s", word_hashes(F.col(text_col)))
    n = F.size("_s")
    at = F.sequence(F.lit(0), n - 1)
    first = lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))
    df = df.withColumn("_starts", F.when(n > 0, F.filter(at, first)).otherwise(F.array().cast("array<int>")))
    pairs = F.transform("_starts", lambda i, j: F.struct(F.get("_s", i).alias("term"), (F.coalesce(F.get("_starts", j + 1), n) - i).alias("weight")))
    return df.withColumn("_t", F.explode_outer(pairs)).withColumns({"term": F.col("_t.term"), "weight": F.col("_t.weight")}).drop("_s", "_starts", "_t")


def _sample(term: Column, log_weight: Column, i: int) -> Column:
    """ln(a) in the upper bits, the hash of (term, t) in the lower 32: the minimum is the i-th entry of a signature."""
    z1, z2 = F.xxhash64(term, F.lit(2 * i)), F.xxhash64(term, F.lit(2 * i + 1))
    unit = lambda bits, n: (bits + F.lit(0.5)) / F.lit(float(1 << n))
    u1, u2, b = (unit(F.shiftrightunsigned(z1, s).bitwiseAND(F.lit(_LOW21)), 21) for s in (0, 21, 42))
    u3, u4 = (unit(F.shiftrightunsigned(z2, s).bitwiseAND(F.lit(_LOW32)), 32) for s in (0, 32))
    r, c = -F.ln(u1 * u2), -F.ln(u3 * u4)
    t = F.floor(log_weight / r + b)
    log_a = F.ln(c) - r * (t - b) - r
    fixed = F.greatest(F.lit(0), F.least(F.lit(_TOP), F.floor((log_a + F.lit(_SHIFT)) * F.lit(_SCALE)))).cast("long")
    return F.shiftleft(fixed, 32).bitwiseOR(F.hash(term, t).cast("long").bitwiseAND(F.lit(_LOW32)))


def signatures(df: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """keys and sig (array of `samples` longs); texts without words have zeros. keys must tell the rows apart."""
    terms = with_terms(df, text_col).withColumn("_lw", F.ln(F.col("weight").cast("double")))
    mins = [F.min(_sample(F.col("term"), F.col("_lw"), i)).alias(f"_m{i}") for i in range(samples)]
    low = [F.coalesce(F.col(f"_m{i}").bitwiseAND(F.lit(_LOW32)), F.lit(0)) for i in range(samples)]
    return terms.groupBy(*keys).agg(*mins).select(*keys, F.array(*low).alias("sig"))


def fingerprint_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The fraction of equal entries: estimates generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below value, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < value))
    literal = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    row = below(literal([r[-1] for r in rows]))
    return F.coalesce(row * step + below(F.coalesce(F.get(F.array(*[literal(r) for r in rows]), row), literal([]))), F.lit(0))


def neighbours(docs: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """_bucket, _rn, _edge, doc_id, text, next_text: the text of the next document in descending doc_id, cyclic.

    Documents are dealt by ranges of doc_id of about rows_each rows; each range also gets a copy of the last document of the
    range below it (_edge), so no window spans the table. Equal ids are ordered by their text's hash; rows without doc_id
    come after all others and are dealt by ranges of that hash; a document alone is its own next.
    """
    spark = docs.sparkSession
    size, unnamed = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts, own = max(shuffle_width(spark), size // rows_each), 1 + unnamed // rows_each
    bounds = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    spot = F.floor((F.col("_k2") / F.lit(2.0**64) + 0.5) * own).cast("int")  # 0 to own: ranges of the hash
    docs = docs.withColumns({"_k1": F.coalesce("doc_id", F.lit(-(1 << 63))), "_k2": F.xxhash64("text")})
    docs = docs.withColumn("_bucket", F.when(F.col("doc_id").isNull(), spot - (own + 1)).otherwise(_bucket(F.col("doc_id"), sorted(set(bounds or [])))))
    found = docs.groupBy("_bucket").agg(F.max(F.struct("_k1", "_k2")).alias("m")).collect()  # a row for each range
    last = sorted((r["_bucket"], *r["m"]) for r in found)
    edges = spark.createDataFrame([(k1, k2, last[(k + 1) % len(last)][0]) for k, (_, k1, k2) in enumerate(last)], "_k1 long, _k2 long, _to int")
    # a number of rows of three numbers
    edges = docs.join(F.broadcast(edges), ["_k1", "_k2"]).groupBy("_to").agg(F.max(F.struct("doc_id", "text", "_k2")).alias("m"))
    edges = edges.select("m.doc_id", "m.text", "m._k2", F.col("_to").alias("_bucket"), F.lit(0).alias("_order"))
    both = docs.select("doc_id", "text", "_k2", "_bucket", F.lit(1).alias("_order")).unionByName(edges)
    w = Window.partitionBy("_bucket").orderBy("_order", "doc_id", "_k2")
    return both.select("_bucket", F.row_number().over(w).alias("_rn"), (F.col("_order") == 0).alias("_edge"), "doc_id", "text", F.coalesce(F.lag("text").over(w), "text").alias("next_text"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text, and how alike these and the next document's are.

    Null texts are empty; texts without words share one fingerprint of zeros; very long texts are read whole. Repeated rows
    are documents of their own, next to each other. An empty table gives no rows; other columns of docs don't matter.
    """
    rows = neighbours(doc_rows(docs))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = rows.withColumns({"n_chars": n.cast("long"), "_edited": edited})
    keys = ["_bucket", "_rn", "_edge", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    rows = rows.select(*keys, F.posexplode(F.array("text", "_edited")).alias("_which", "_text"))
    sig = signatures(rows, [*keys, "_which"], "_text", samples)
    both = sig.groupBy(*keys).agg(*[F.max(F.when(F.col("_which") == k, F.col("sig"))).alias(c) for k, c in enumerate(("sig", "edited_sig"))])
    w = Window.partitionBy("_bucket").orderBy("_rn")
    both = both.withColumn("next_sig", F.coalesce(F.lag("sig").over(w), "sig")).where(~F.col("_edge"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints of all documents; null, empty, long and repeated texts as there."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
