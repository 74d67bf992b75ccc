"""Similarity audits of a candidate layer against a registry of layers: overlap, Jaccard, certificates, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.operators.stencil import disk_offsets, spread

_CELL = ["row", "col"]


def _near(layers: DataFrame, radius: float) -> DataFrame:
    """layer, row, col: every cell within a closed radius of a cell of the layer."""
    return spread(layers.select("layer", *_CELL), disk_offsets(radius)).select("layer", *_CELL).distinct()


def overlap(candidate: DataFrame, layers: DataFrame, radius: float = 3.0) -> DataFrame:
    """layer, overlap: the share of candidate cells within radius of the layer, 0 for layers that reach none."""
    size = candidate.agg(F.count("*").alias("_n"))
    hits = candidate.select(*_CELL).join(_near(layers, radius), _CELL).groupBy("layer").agg(F.count("*").alias("_h"))
    out = layers.select("layer").distinct().join(hits, "layer", "left").join(F.broadcast(size))
    return out.select("layer", F.when(F.col("_n") > 0, F.coalesce("_h", F.lit(0)) / F.col("_n")).otherwise(0.0).alias("overlap"))


def reverse_overlap(candidate: DataFrame, layers: DataFrame, radius: float = 3.0) -> DataFrame:
    """layer, reverse_overlap: the share of the layer's cells within radius of the candidate."""
    near = spread(candidate.select(*_CELL), disk_offsets(radius)).select(*_CELL).distinct().withColumn("_in", F.lit(1))
    return layers.join(near, _CELL, "left").groupBy("layer").agg((F.count("_in") / F.count("*")).alias("reverse_overlap"))


def jaccard(candidate: DataFrame, layers: DataFrame) -> DataFrame:
    """layer, n, shared, jaccard: shared cells over cells in either."""
    mine = candidate.select(*_CELL).withColumn("_in", F.lit(1))
    size = candidate.agg(F.count("*").alias("_n"))
    out = layers.join(mine, _CELL, "left").groupBy("layer").agg(F.count("*").alias("n"), F.count("_in").alias("shared")).join(F.broadcast(size))
    return out.select("layer", "n", "shared", (F.col("shared") / (F.col("n") + F.col("_n") - F.col("shared"))).alias("jaccard"))


def certificate(allowed: DataFrame, layers: DataFrame, radius: float = 3.0) -> DataFrame:
    """layer, uncovered, saturated: allowed cells out of the layer's reach; a layer that reaches all of them saturates."""
    total = allowed.agg(F.count("*").alias("_n"))
    covered = allowed.select(*_CELL).join(_near(layers, radius), _CELL).groupBy("layer").agg(F.count("*").alias("_c"))
    out = layers.select("layer").distinct().join(covered, "layer", "left").join(F.broadcast(total))
    left = F.col("_n") - F.coalesce("_c", F.lit(0))
    return out.select("layer", left.alias("uncovered"), (left == 0).alias("saturated"))


def audit(candidate: DataFrame, layers: DataFrame, radius: float = 3.0, limit: float = 0.7) -> DataFrame:
    """layer, overlap, reverse_overlap, jaccard, duplicate (strictly over the limit either way)."""
    out = overlap(candidate, layers, radius).join(reverse_overlap(candidate, layers, radius), "layer").join(jaccard(candidate, layers), "layer")
    flag = F.greatest("overlap", "reverse_overlap") > limit
    return out.select("layer", "overlap", "reverse_overlap", "jaccard", flag.alias("duplicate"))


def audit_summary(audited: DataFrame, complete: bool) -> DataFrame:
    """One row: n, worst_layer, worst_overlap, duplicates, unique. Fails closed: an incomplete registry is never unique."""
    worst = F.max(F.struct("overlap", (-F.col("layer")).alias("m")))
    out = audited.agg(F.count("*").alias("n"), worst.alias("w"), F.sum(F.col("duplicate").cast("int")).alias("duplicates"))
    ok = F.lit(complete) & (F.col("n") > 0) & (F.coalesce("duplicates", F.lit(1)) == 0)
    return out.select("n", (-F.col("w.m")).alias("worst_layer"), F.col("w.overlap").alias("worst_overlap"), "duplicates", ok.alias("unique"))


def consensus(layers: DataFrame, least: int, radius: float = 3.0) -> DataFrame:
    """row, col, n_layers: cells that at least `least` layers come within radius of."""
    return _near(layers, radius).groupBy(*_CELL).agg(F.count("*").alias("n_layers")).where(F.col("n_layers") >= least)


def containment(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: removed (only in a), added (only in b), shared."""
    both = a.select(*_CELL).withColumn("_a", F.lit(1)).join(b.select(*_CELL).withColumn("_b", F.lit(1)), _CELL, "full")
    only = lambda x, y: F.count(F.when(F.col(x).isNotNull() & F.col(y).isNull(), 1))
    return both.agg(only("_a", "_b").alias("removed"), only("_b", "_a").alias("added"), F.count(F.col("_a") + F.col("_b")).alias("shared"))


def merge_aliases(files: DataFrame, key: str, content: str) -> DataFrame:
    """sha256, first_key, n_sources: equal contents are one entry. Sources are counted, not gathered."""
    return files.groupBy(F.sha2(F.coalesce(content, F.lit("")), 256).alias("sha256")).agg(F.min(key).alias("first_key"), F.count("*").alias("n_sources"))


def direct_coverage(allowed: DataFrame, layers: DataFrame) -> DataFrame:
    """layer, coverage: the share of allowed cells that are cells of the layer themselves."""
    total = allowed.agg(F.count("*").alias("_n"))
    hit = allowed.select(*_CELL).join(layers, _CELL).groupBy("layer").agg(F.count("*").alias("_h"))
    out = layers.select("layer").distinct().join(hit, "layer", "left").join(F.broadcast(total))
    return out.select("layer", F.when(F.col("_n") > 0, F.coalesce("_h", F.lit(0)) / F.col("_n")).otherwise(0.0).alias("coverage"))


def blanket(allowed: DataFrame, layers: DataFrame, radius: float = 3.0, least: float = 0.7) -> DataFrame:
    """layer, covered, blanket: layers whose reach covers at least a share of the allowed cells."""
    out = certificate(allowed, layers, radius).join(F.broadcast(allowed.agg(F.count("*").alias("_n"))))
    covered = 1 - F.col("uncovered") / F.greatest("_n", F.lit(1))
    return out.select("layer", covered.alias("covered"), (covered >= least).alias("blanket"))


def panel_overlap(panel: DataFrame, layers: DataFrame, radius: float = 3.0) -> DataFrame:
    """candidate, layer, overlap for all pairs of a panel of candidates (candidate, row, col) and the layers, in one pass."""
    sizes = panel.groupBy("candidate").agg(F.count("*").alias("_n"))
    hits = panel.join(_near(layers, radius), _CELL).groupBy("candidate", "layer").agg(F.count("*").alias("_h"))
    pairs = sizes.join(F.broadcast(layers.select("layer").distinct()))  # layers are few: a registry's list
    out = pairs.join(hits, ["candidate", "layer"], "left")
    return out.select("candidate", "layer", (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("overlap"))


def support_matched(candidate: DataFrame, audited: DataFrame, sizes: DataFrame, low: float = 1 / 3, high: float = 3.0) -> DataFrame:
    """audited rows (layer, overlap, jaccard ...) with n, matched (a size within low to high times the candidate's) and band:
    the tenth of overlap they fall into."""
    size = candidate.agg(F.count("*").alias("_n"))
    out = audited.join(sizes.groupBy("layer").agg(F.count("*").alias("n")), "layer").join(F.broadcast(size))
    inside = (F.col("n") >= low * F.col("_n")) & (F.col("n") <= high * F.col("_n"))
    return out.select(*audited.columns, "n", inside.alias("matched"), F.least(F.floor(F.col("overlap") * 10), F.lit(9)).cast("int").alias("band"))


def tied_spearman(candidate: DataFrame, layers: DataFrame, cells_of_grid: int) -> DataFrame:
    """layer, rho: Spearman's rho of two 0/1 layers over a whole grid, in closed form from counts: it is their Pearson
    correlation, as ranks of two tied values are an affine image of them."""
    out = jaccard(candidate, layers).join(F.broadcast(candidate.agg(F.count("*").alias("_a"))))
    a, b, both, g = F.col("_a"), F.col("n"), F.col("shared"), F.lit(float(cells_of_grid))
    scale = F.sqrt(a * (g - a)) * F.sqrt(b * (g - b))
    return out.select("layer", F.when(scale > 0, (g * both - a * b) / scale).alias("rho"))


def removed_distances(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """One row: removed, nearest and farthest distance from a cell that b lacks to b's nearest cell within radius, and how many
    have none there."""
    from rastra.operators.nearest import nearest_within

    removed = a.select(*_CELL).join(b.select(*_CELL), _CELL, "left_anti")
    near = nearest_within(removed, b, radius).select(F.sqrt(F.col("d2").cast("double")).alias("d"))
    out = near.agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"), F.count("*").alias("_k")).join(F.broadcast(removed.agg(F.count("*").alias("removed"))))
    return out.select("removed", "nearest", "farthest", (F.col("removed") - F.col("_k")).alias("beyond"))


def merge_rows(old: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """sha256, metrics and sources (sorted, united) of two audits; raises, when it is read, if one file has unlike metrics.

    sources: an array of names for each row, bounded by the registry's list of repositories."""
    both = old.select("sha256", *metrics, "sources").unionByName(new.select("sha256", *metrics, "sources"))
    unlike = F.lit(False)
    for m in metrics:
        unlike = unlike | (F.min(m) < F.max(m))
    out = both.groupBy("sha256").agg(*[F.max(m).alias(m) for m in metrics], F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), unlike.alias("_unlike"))
    checked = F.when(F.col("_unlike"), F.raise_error(F.lit("one file with unlike metrics")).cast("string")).otherwise(F.col("sha256"))
    return out.select(checked.alias("sha256"), *metrics, "sources")


def united_aliases(files: DataFrame, content: str, source: str) -> DataFrame:
    """sha256, sources: equal contents are one entry with all its sources, each once, in order (a bounded list: repositories)."""
    return files.groupBy(F.sha2(F.coalesce(content, F.lit("")), 256).alias("sha256")).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def without_own(priors: DataFrame, own: DataFrame) -> DataFrame:
    """priors less the files whose content is one of own's."""
    return priors.join(own.select("sha256").distinct(), "sha256", "left_anti")


def pinned(local: DataFrame, pins: DataFrame) -> DataFrame:
    """name, sha256, state of every pin: ok, changed (another content) or missing."""
    out = pins.select("name", "sha256").join(local.select("name", F.col("sha256").alias("_l")), "name", "left")
    state = F.when(F.col("_l").isNull(), "missing").when(F.col("_l") == F.col("sha256"), "ok").otherwise("changed")
    return out.select("name", "sha256", state.alias("state"))


def delta(before: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """key, change (added, removed, changed) of two listings; what is unlike in neither is left out."""
    both = before.select(key, F.col(version).alias("_b")).join(now.select(key, F.col(version).alias("_n")), key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_b") != F.col("_n"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def within_bytes(files: DataFrame, key: str, size: str, budget: int, cap: int) -> DataFrame:
    """key, size of the smallest files first whose sizes sum to no more than the budget; files over the cap never.

    Sizes are summed first within distinct sizes, so the window runs over these and, at the size where the budget ends,
    over keys alone."""
    fit = files.where(F.col(size) <= cap)
    sizes = fit.groupBy(size).agg(F.count("*").alias("_n"))
    run = F.coalesce(F.sum(F.col(size) * F.col("_n")).over(Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("_room", F.when(F.col(size) > 0, F.floor((F.lit(budget) - run) / F.col(size))).otherwise(F.lit(1 << 62))).where("_room > 0")
    whole = fit.join(room.where(F.col("_n") <= F.col("_room")), size).select(key, size)
    edge = fit.join(room.where(F.col("_n") > F.col("_room")), size)  # one size at most
    cut = edge.withColumn("_k", F.row_number().over(Window.partitionBy(size).orderBy(key))).where("_k <= _room")
    return whole.unionByName(cut.select(key, size))


#: Listed files of more bytes are not taken.
LARGEST = 100 * 1024 * 1024


def merged_state(state: DataFrame, listing: DataFrame, own: DataFrame, inputs: str | None = None, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """(state, log): a registry after a new listing, and what became of each listed file.

    state: sha256, sources (array), one row for each content. listing: source, sha256, bytes. own: sha256 of contents that are the
    candidate's own. A listed file is of one kind, the first that fits: own; input (its source matches the pattern); known (content
    and source are in the state); alias (a new source of a content that the state has); too_large; new. Contents of new files
    become rows of the state, aliases are added to the sources of theirs. Merging the same listing again finds own, input, known
    and too_large files alone and returns the same state.
    """
    have = state.select("sha256", F.lit(True).alias("_have"))
    named = state.select("sha256", F.explode("sources").alias("source")).withColumn("_named", F.lit(True))
    mine = own.select("sha256").distinct().withColumn("_own", F.lit(True))
    rows = listing.select("source", "sha256", "bytes").distinct()
    rows = rows.join(mine, "sha256", "left").join(have, "sha256", "left").join(named, ["sha256", "source"], "left")
    kind = (
        F.when(F.col("_own"), "own").when(F.col("source").rlike(inputs) if inputs else F.lit(False), "input").when(F.col("_named"), "known").when(F.col("_have"), "alias")
        .when(F.col("bytes") > largest, "too_large").otherwise("new")
    )
    log = rows.select("source", "sha256", "bytes", kind.alias("kind"))
    more = log.where("kind in ('alias', 'new')").select("sha256", "source")
    old = state.select("sha256", F.explode("sources").alias("source"))
    merged = old.unionByName(more).groupBy("sha256").agg(F.array_sort(F.collect_set("source")).alias("sources"))  # a content's own sources
    return merged, log


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a; reading it raises where a key is in one of both tables alone."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    odd = sides.agg(F.count_if(F.col("_a").isNull()).alias("_more"), F.count_if(F.col("_b").isNull()).alias("_less"))
    text = F.concat(F.lit("keys differ: "), F.col("_less"), F.lit(" are only in the first table, "), F.col("_more"), F.lit(" only in the second"))
    checked = odd.select(F.when((F.col("_more") > 0) | (F.col("_less") > 0), F.raise_error(text).cast("int")).otherwise(0).alias("_odd"))
    return a.join(F.broadcast(checked)).where("_odd = 0").drop("_odd")  # one row


def four_legs(audited: DataFrame, sizes: DataFrame, candidate: DataFrame, cells_of_grid: int, rho: float = 0.5, overlap_limit: float = 0.7, jaccard_limit: float = 0.5, dense_from: float = 0.5) -> DataFrame:
    """leg, peers, flags, worst (overlap), passed: one audit read in four ways. literal: overlap or rho over its limit; representation:
    the same among layers that cover no more than a share of the grid; scale_free: reverse overlap, Jaccard or rho, which do not rise
    with a peer's size; support_matched: any of them, among peers of a third to three times the candidate's size. A leg without
    peers passes with a null worst.

    audited: layer, overlap, reverse_overlap, jaccard, rho (null: no correlation, never a flag); sizes: layer, n."""
    mine = candidate.agg(F.count("*").alias("_mine"))
    rows = audited.join(sizes.select("layer", "n"), "layer").join(F.broadcast(mine))  # one row
    corr = F.coalesce(F.col("rho"), F.lit(0.0)) > rho
    far, back, shared = F.col("overlap") > overlap_limit, F.col("reverse_overlap") > overlap_limit, F.col("jaccard") > jaccard_limit
    some, all_ = F.col("n") <= dense_from * cells_of_grid, F.lit(True)
    matched = (F.col("n") * 3 >= F.col("_mine")) & (F.col("n") <= 3 * F.col("_mine"))
    legs = [("literal", all_, corr | far), ("representation", some, corr | far), ("scale_free", all_, back | shared | corr), ("support_matched", matched, far | back | shared | corr)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), peer.alias("peer"), (peer & flag).alias("flag")) for n, peer, flag in legs])).alias("l")
    out = rows.select("overlap", each).groupBy("l.leg").agg(F.count_if("l.peer").alias("peers"), F.count_if("l.flag").alias("flags"), F.max(F.when(F.col("l.peer"), F.col("overlap"))).alias("worst"))
    return out.withColumn("passed", F.col("flags") == 0)


def size_bands(audited: DataFrame, sizes: DataFrame, edges: list[int]) -> DataFrame:
    """low, high, peers, worst_overlap, worst_jaccard of the layers by size, right-open; bands without a layer are left out."""
    band = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in zip(edges, edges[1:])])).alias("b")
    rows = audited.join(sizes.select("layer", "n"), "layer").select("n", "overlap", "jaccard", band).where("n >= b.low and n < b.high")
    return rows.groupBy("b.low", "b.high").agg(F.count("*").alias("peers"), F.max("overlap").alias("worst_overlap"), F.max("jaccard").alias("worst_jaccard"))
