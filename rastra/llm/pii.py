"""Personal data by weak supervision (DataFrame functions only).

Two regex labelers propose spans: the strict patterns of the contract (always kept) and looser ones (obfuscated mail
addresses, IPv6, bare digit runs, telephone numbers without a plus or glued to other digits). On every proposed span five
labelers vote yes, no or abstain: pattern, check digits, gazetteer, context words before it, and its edges.
Expectation-maximisation over the counts of vote patterns estimates how each labeler votes on true and on false spans;
the posteriors are the soft labels from which a logistic classifier over the spans' features is fitted. Votes and
features are categorical, so one groupBy turns the whole corpus into a table whose size does not depend on it (at most
some thousand rows), which is all that reaches the driver. The classifier goes back as a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import boxed, with_text

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns. Possessive quantifiers and the run-start test change no match: each run's end is fixed by its
#: character class, and a later start in the same run fails where the first one failed. They keep the search linear.
STRICT = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
LOOSE = [
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[a-z]{2,24}(?![a-z0-9])",
    r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
]
#: A cheap test for what any match of the pattern must hold.
STRICT_NEEDS = [r"@", r"[0-9]\.[0-9]", r"[0-9][0-9\x20-]{12}", r"\+[0-9]"]
LOOSE_NEEDS = [r"(?i)at[)\x20\]]", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"[0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{4}"]
#: Gazetteers of top-level domains, telephone country codes and card issuer prefixes.
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pt|mx|br|ar|jp|cn|in|ru|pl|se|no|dk|fi"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[05-8][0-9]|9[679][0-9]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[0689]|6011|64|65|62|35"
CUES = [r"mail|contact|write|address|kontakt|correo|courriel", r"\bip\b|host|server|address|adresse", r"card|visa|master|amex|credit|karte|carte|tarjeta", r"tel|phone|call|fax|mobil|contact|anruf|llam"]
NEGATIVE_CUES = r"order|invoice|version|isbn|serial|token|password|hash|sha|uuid|ticket|release"
VOTERS = ["v_pattern", "v_check", "v_gazetteer", "v_context", "v_edge"]
FEATURES = ["kind", "v_check", "v_gazetteer", "v_context", "v_edge", "digits", "separators"]

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,v_pattern:int,v_check:int,v_gazetteer:int,v_context:int,v_edge:int,digits:int,separators:int>>"


def running_sum(x: Column, block: int = 256) -> Column:
    """Running sums of an array of numbers; blocks keep the cost near linear. x should be a plain column."""

    def scan(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
        step = lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"] + v)).alias("a"))
        return F.aggregate(a, zero, step)["a"]

    def joined(parts: Column) -> Column:
        totals = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, totals, lambda p, t: F.transform(p, lambda v: v + t - F.element_at(p, -1))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block)), lambda b: F.slice(x, (b * block + 1).cast("int"), block))
    let = F.transform(F.array(F.transform(blocks, scan)), joined)
    return F.when(F.size(x) > 0, F.get(let, F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(match: Column) -> Column:
    small = lambda p: (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substr(p, F.lit(1), F.lit(3))).cast("int") <= 255)
    return F.forall(F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0"))), small)


def _check(kind: int, match: Column) -> Column:
    """The contract's test of a strict match; also the check-digit labeler."""
    d = F.length(_digits(match))
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return _octets(match)
    if kind == 2:
        return F.when(d.between(14, 19), _luhn(_digits(match))).otherwise(False)
    return d.between(10, 15)


def _gazetteer(kind: int, match: Column) -> Column:
    if kind == 0:
        return F.when(match.rlike(rf"(?i)[.\x20\])](?:{TOP_LEVEL})$"), 1).otherwise(-1)
    if kind == 1:
        return F.when(match.rlike(r"^(?:0|127|255)\."), -1).when(match.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), 0).otherwise(1)
    if kind == 2:
        return F.when(_digits(match).rlike(f"^(?:{ISSUERS})"), 1).otherwise(-1)
    return F.when(match.rlike(rf"^\+(?:{COUNTRY_CODES})"), 1).when(match.startswith("+"), -1).otherwise(0)


def _span(kind: int, strict: bool, m: Column, before: Column, after: Column, end: Column) -> Column:
    d = F.length(_digits(m))
    context = F.when(before.rlike(f"(?i){NEGATIVE_CUES}"), -1).when(before.rlike(f"(?i){CUES[kind]}"), 1).otherwise(0)
    edge = F.when(before.rlike(r"[0-9A-Za-z_]$") | after.rlike(r"^[0-9A-Za-z_]"), -1).otherwise(1)
    ok = _check(kind, m)
    return F.struct(
        (end - F.length(m)).alias("start"),
        F.lit(kind).alias("kind"),
        end.alias("end"),
        (F.lit(strict) & ok).alias("base"),
        F.lit(1 if strict else -1).alias("v_pattern"),
        F.when(ok, 1 if kind else 0).otherwise(-1).alias("v_check"),
        _gazetteer(kind, m).alias("v_gazetteer"),
        context.alias("v_context"),
        edge.alias("v_edge"),
        F.least(F.floor(d / 3), F.lit(7)).cast("int").alias("digits"),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(5)).alias("separators"),
    )


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs (from boxed) with _spans: all strict spans, and the loose ones that overlap none of them."""
    sources = [(k, s, p, n) for s, ps, ns in ((True, STRICT, STRICT_NEEDS), (False, LOOSE, LOOSE_NEEDS)) for k, (p, n) in enumerate(zip(ps, ns))]
    none, text = F.array().cast("array<string>"), F.col("text")
    found = {f"_m{i}": F.when(text.rlike(n), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for i, (_, _, p, n) in enumerate(sources)}
    docs = docs.withColumns(found)
    docs = docs.withColumns({f"_p{i}": F.when(F.size(f"_m{i}") > 0, F.split(text, p, -1)).otherwise(none) for i, (_, _, p, _) in enumerate(sources)})
    steps = {f"_x{i}": F.zip_with(F.slice(f"_p{i}", F.lit(1), F.size(f"_m{i}")), f"_m{i}", lambda a, b: (F.length(a) + F.length(b)).cast("long")) for i in range(len(sources))}
    docs = docs.withColumns(steps)
    docs = docs.withColumns({f"_e{i}": running_sum(F.col(f"_x{i}")) for i in range(len(sources))})
    spans = {}

    def built(i: int, kind: int, strict: bool) -> Column:
        def build(m: Column, j: Column) -> Column:
            before, after = F.right(F.get(f"_p{i}", j), F.lit(40)), F.substr(F.get(f"_p{i}", j + 1), F.lit(1), F.lit(1))
            return _span(kind, strict, m, before, after, F.get(f"_e{i}", j))

        return F.transform(f"_m{i}", build)

    for i, (kind, strict, _, _) in enumerate(sources):
        spans[f"_s{i}"] = F.when(F.size(f"_m{i}") > 0, built(i, kind, strict)).otherwise(F.array().cast(_SPAN)).cast(_SPAN)
    docs = docs.withColumns(spans)
    strict = F.filter(F.concat(*[F.col(f"_s{i}") for i in range(4)]), lambda s: s["base"])
    docs = docs.withColumn("_base", strict).withColumn("_loose", F.concat(*[F.col(f"_s{i}") for i in range(4, 8)]))
    free = F.filter("_loose", lambda s: ~F.exists("_base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    docs = docs.withColumn("_spans", F.when(F.size("_loose") > 0, F.concat("_base", free)).otherwise(F.col("_base")))
    return docs.drop(*[f"_{c}{i}" for c in "mpxes" for i in range(len(sources))], "_base", "_loose")


@dataclass
class SpanModel:
    """reliability[voter][y][vote]; weights[feature][value] and bias of the final classifier."""

    prior: list[float] = field(default_factory=lambda: [0.5] * len(KINDS))
    reliability: dict[str, list[dict[int, float]]] = field(default_factory=dict)
    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    bias: float = -1.0

    def logit(self, span: Column) -> Column:
        out = F.lit(self.bias)
        for feature, values in self.weights.items():
            if values:
                pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
                out = out + F.coalesce(F.try_element_at(F.create_map(*pairs), span[feature]), F.lit(0.0))
        return out


def fit(rows: list[dict], rounds: int = 30, steps: int = 300, rate: float = 0.5) -> SpanModel:
    """rows: counts `n` of each combination of votes and features (a table of bounded size)."""
    model = SpanModel()
    if not rows:
        return model
    total = float(sum(r["n"] for r in rows))
    post = [1 / (1 + math.exp(-sum(r[v] for v in VOTERS))) for r in rows]
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = [(p, r["n"]) for p, r in zip(post, rows) if r["kind"] == k]
            model.prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for v in VOTERS:
            model.reliability[v] = []
            for y in (0, 1):
                mass = {a: 1.0 for a in (-1, 0, 1)}
                for p, r in zip(post, rows):
                    mass[r[v]] += r["n"] * (p if y else 1 - p)
                model.reliability[v].append({a: m / sum(mass.values()) for a, m in mass.items()})
        for i, r in enumerate(rows):
            odds = math.log(model.prior[r["kind"]]) - math.log(1 - model.prior[r["kind"]])
            odds += sum(math.log(model.reliability[v][1][r[v]]) - math.log(model.reliability[v][0][r[v]]) for v in VOTERS)
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    model.weights, model.bias = {f: {r[f]: 0.0 for r in rows} for f in FEATURES}, 0.0
    for _ in range(steps):
        grad, gb = {f: dict.fromkeys(w, 0.0) for f, w in model.weights.items()}, 0.0
        for p, r in zip(post, rows):
            z = model.bias + sum(w[r[f]] for f, w in model.weights.items())
            g = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * r["n"] / total
            gb += g
            for f in FEATURES:
                grad[f][r[f]] += g
        model.bias += rate * gb
        for f, w in model.weights.items():
            for value in w:
                w[value] += rate * (grad[f][value] - 1e-4 * w[value])
    return model


def train(candidates: DataFrame) -> SpanModel:
    # explode_outer, as explode adds a filter on the array's size, for which the array is computed once more
    spans = candidates.select(F.explode_outer("_spans").alias("s")).where("s is not null").select(*[F.col("s")[c].alias(c) for c in dict.fromkeys(VOTERS + FEATURES)])
    counts = spans.groupBy(*spans.columns).agg(F.count("*").alias("n"))
    return fit(sorted((r.asDict() for r in counts.collect()), key=lambda r: sorted(r.items())))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """row (all columns of docs), doc_id, text (null: empty) and personal_data: array of (start, kind, end, base) by start,
    then kind; code points, end exclusive.

    Without a model one is trained on all of docs. Null and empty texts have no spans; rows are judged one by one, so
    repeated rows get equal spans; very long texts are searched whole; an empty table trains a model that adds nothing.
    """
    found = with_candidates(boxed(docs, id_col, text_col))
    model = model or train(found.select("_spans"))
    chosen = F.filter("_spans", lambda s: s["base"] | (model.logit(s) > 0))
    slim = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select("row", "doc_id", "text", F.array_sort(slim).alias("personal_data"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def mask(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans become one mask."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.get(names, s["kind"])).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    rest = lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """docs, same columns, with the personal data in text masked. Null texts stay null and empty ones empty; repeated rows are masked
    alike; an empty table stays one."""
    found = find_personal_data(docs)
    masked = F.when(F.size("personal_data") > 0, mask(F.col("text"), F.col("personal_data"))).otherwise(F.col("row.text"))
    return with_text(found, docs, masked)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_personal_data in all documents, as counts and digests; null, empty, long and repeated texts as there."""
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = out.withColumn("base", F.filter("personal_data", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("personal_data")).alias("spans"))
