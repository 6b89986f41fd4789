"""Reports and selections over track and subject tables: each a grouped aggregation, a window or an equality join."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracklore.functions.scalar import group_in_name, middle_of, norm, safe_name
from tracklore.operators import stats as S
from tracklore.operators.lineage import kept, quantiles, sized
from tracklore.operators.tracks import KEY, by_time

#: Limits of the motility classes: fixed values.
STATIC_LENGTH, STATIC_PATH, STATIC_NET, STATIC_MOVING, MOTILE_PATH, MOTILE_MOVING = 5, 5.0, 3.0, 0.2, 10.0, 0.30


def motility(tracks: DataFrame, length: str, path: str, net: str, moving: str) -> DataFrame:
    """Tracks as too short to classify, static, motile or of low motility, with the reason of static ones."""
    p, n, m = F.col(path), F.col(net), F.col(moving)
    short = F.col(length).isNull() | (F.col(length) < STATIC_LENGTH)
    static = F.coalesce((p < STATIC_PATH) & (n < STATIC_NET) & (m < STATIC_MOVING), F.lit(False))
    fast = F.coalesce(p.isNotNull() & m.isNotNull() & ((p >= MOTILE_PATH) | (m >= MOTILE_MOVING)), F.lit(False))
    kind = F.when(short, "too_short_to_classify").when(static, "static_candidate").when(fast, "motile").otherwise("low_motility")
    why = F.when(kind == "static_candidate", F.lit(f"path<{STATIC_PATH}um; net<{STATIC_NET}um; moving_fraction<{STATIC_MOVING}")).otherwise("")
    return tracks.withColumns({"motility_class": kind, "static_exclude": kind == "static_candidate", "static_reason": why})


def exclusion(quality: DataFrame, strict: bool) -> DataFrame:
    """Whether a track's split and merge flags exclude it, and why: a volume jump alone does so only where strict."""
    spike, jump, cv, bright = (F.coalesce(F.col(c), F.lit(False)) for c in ("step_spike", "volume_jump", "high_volume_cv", "intensity_jump"))
    rules = [("volume_jump", jump), ("high_volume_cv", cv), ("intensity_jump", bright)] if strict else [("high_volume_cv", cv), ("intensity_jump", bright), ("volume_jump_with_step_spike", jump & spike)]
    why = F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in rules])
    return quality.withColumns({"step_spike_only": spike & ~jump & ~cv & ~bright, "exclusion_reason": why, "excluded": why != ""})


def reason_counts(rows: DataFrame, reason: str, sep: str = ";") -> DataFrame:
    """How often each single reason occurs in joined reason texts."""
    return rows.select(F.explode(F.split(reason, sep)).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


def features_over_time(tracks: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, median, spread, variation, change and slope of every feature over each track, in one aggregation."""
    aggs = []
    for f in features:
        v = F.col(f).cast("double")
        aggs += [F.avg(v).alias(f"{f}_mean"), F.median(v).alias(f"{f}_median"), F.stddev_pop(v).alias(f"{f}_sd"), F.when(F.avg(v) != 0, F.stddev_pop(v) / F.avg(v)).alias(f"{f}_cv"), (F.max_by(v, "time") - F.min_by(v, "time")).alias(f"{f}_change"), F.regr_slope(v, F.col("time").cast("double")).alias(f"{f}_slope")]
    return tracks.groupBy(*KEY).agg(*aggs)


def step_angles(tracks: DataFrame) -> DataFrame:
    """Circular mean and deviation, in degrees, of each track's step angles in the three planes.

    A mean sine or cosine below 1e-12 is zero: sums in another order must not turn half a circle to its negative.
    """
    w = by_time()
    s = tracks.withColumns({f"d{c}": F.col(f"centroid_{c}") - F.lag(f"centroid_{c}").over(w) for c in "zyx"})
    aggs, out = [], {}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        angle = F.when((F.col(f"d{a}") != 0) | (F.col(f"d{b}") != 0), F.atan2(f"d{b}", f"d{a}"))
        n = a + b
        aggs += [F.when(F.abs(v) < 1e-12, 0.0).otherwise(v).alias(k + n) for k, v in (("s", F.avg(F.sin(angle))), ("c", F.avg(F.cos(angle))))]
        r = F.sqrt(F.col(f"s{n}") * F.col(f"s{n}") + F.col(f"c{n}") * F.col(f"c{n}"))
        out |= {f"{n}_resultant": r, f"{n}_mean_deg": F.when(r > 1e-9, F.degrees(F.atan2(f"s{n}", f"c{n}"))), f"{n}_sd_deg": F.when(r > 1e-9, F.degrees(F.sqrt(-2 * F.ln(F.least(r, F.lit(1.0))))))}
    g = s.groupBy(*KEY).agg(*aggs)
    return g.withColumns(out).select(*KEY, *out)


def elapsed_msd(points: DataFrame, width: float, *group: str) -> DataFrame:
    """Squared displacement from each track's start by bins of elapsed time: mean, median, standard error, quartiles.

    points is (KEY, group, elapsed, x, y, z); tracks of one point are left out. Halves round to even.
    """
    w = W.partitionBy(*KEY).orderBy("elapsed")
    p = points.withColumns({f"_{c}": F.first(c).over(w) for c in "xyz"} | {"_n": F.count("*").over(W.partitionBy(*KEY))}).where("_n >= 2")
    p = p.withColumn("squared", sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"), F.lit(0.0))).withColumn("minutes", F.rint(F.col("elapsed") / width) * width)
    p = kept(p.select(*group, *[k for k in KEY if k not in group], "minutes", "squared"))
    keys = [*group, "minutes"]
    q = quantiles(p, keys, "squared", {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("n")
    g = p.groupBy(*keys).agg(F.avg("squared").alias("mean"), F.coalesce(F.stddev_samp("squared"), F.lit(0.0)).alias("_sd"), F.count("*").alias("n"), F.count_distinct(F.struct(*KEY)).alias("n_tracks"))
    return g.join(q.hint("merge"), keys).withColumn("sem", F.col("_sd") / F.sqrt("n")).select(*keys, "mean", "q25", "median", "q75", "n", "n_tracks", "sem")


def by_subject(msd: DataFrame, group: str, value: str = "mean") -> DataFrame:
    """A second level over subjects' own values: mean, standard error and subjects of each group and bin."""
    return msd.groupBy(group, "minutes").agg(F.avg(value).alias("mean"), (F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n_subjects"))


def durations(points: DataFrame, limits: Sequence[float], *group: str) -> DataFrame:
    """Tracks of each group by how long they last: counts over each limit, median and longest."""
    d = kept(points.groupBy(*group, *KEY).agg((F.max("elapsed") - F.min("elapsed")).alias("d")))
    counts = d.groupBy(*group).agg(F.count("*").alias("n_tracks"), F.max("d").alias("longest"), *[F.count_if(F.col("d") >= x).alias(f"n_{x:g}") for x in limits])
    middle = quantiles(d, list(group), "d", {"median": 0.5}).drop("n")
    return counts.join(middle.hint("merge"), list(group)) if group else counts.join(F.broadcast(middle))


def variance_partition(long: DataFrame, group: str, subject: str) -> DataFrame:
    """Shares of each feature's variance between groups, between subjects of a group, and within subjects."""
    v = long.where("value IS NOT NULL")
    cells = kept(v.groupBy("feature", group, subject).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("s")))
    groups = cells.groupBy("feature", group).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g")).groupBy("feature").agg(F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("between"))
    own = cells.groupBy("feature").agg(F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("subjects"), (F.sum(F.col("n") * F.col("s")) / (F.sum("n") - 1)).alias("residual"))
    j = own.join(groups.hint("merge"), "feature").withColumn("within", F.greatest(F.col("subjects") - F.col("between"), F.lit(0.0)))
    total = F.col("between") + F.col("within") + F.col("residual")
    return j.where(total > 0).select("feature", *[(F.col(c) / total).alias(f"{n}_fraction") for c, n in (("between", "group"), ("within", "subject"), ("residual", "cell"))])


def qc_sensitivity(normal: DataFrame, strict: DataFrame, a: str, b: str) -> DataFrame:
    """How a stricter filter moves each feature: rank correlation, changes, and the effect's size and direction.

    Both tables are (subject, genotype, feature, value), one value for each subject and feature.
    """
    j = kept(normal.join(strict.select("subject", "feature", F.col("value").alias("strict")).hint("merge"), ["subject", "feature"]).where("value IS NOT NULL AND strict IS NOT NULL"))
    for by, name in (("value", "rn"), ("strict", "rs")):
        j = j.join(S.average_ranks(j, ["feature"], by, name).hint("merge"), ["feature", by])
    change = F.abs(F.col("strict") - F.col("value"))
    g = j.groupBy("feature").agg(F.count("*").alias("n_shared"), F.corr("rn", "rs").alias("spearman"))
    moved = kept(j.select("feature", change.alias("change"), F.when(F.col("value") != 0, change / F.abs("value") * 100).alias("relative")))
    for column, name in (("change", "median_absolute_change"), ("relative", "median_relative_change_pct")):
        g = g.join(quantiles(moved, ["feature"], column, {name: 0.5}).drop("n").hint("merge"), "feature", "left")
    for table, name in ((normal, "normal"), (strict, "strict")):
        g = g.join(S.effect_sizes(table, a, b).select("feature", F.col("cliffs_delta").alias(f"{name}_delta")).hint("merge"), "feature", "left")
    return g.withColumns({"delta_change": F.abs(F.col("strict_delta") - F.col("normal_delta")), "same_direction": F.signum("strict_delta") == F.signum("normal_delta")})


def removal_fractions(tracks: DataFrame, removed: str, *group: str) -> DataFrame:
    return tracks.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col(removed)).alias("n_removed"), F.avg(F.col(removed).cast("int")).alias("fraction_removed"))


def transitions(states: DataFrame, start: str, end: str, *group: str) -> DataFrame:
    """Counts of tracks by their state at the start and at the end, and the share of each start's."""
    n = states.groupBy(*group, start, end).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*group, start)))


def condition_change(parts: DataFrame, condition: str, before: str, after: str, *keys: str) -> DataFrame:
    """Mean of value by keys under two conditions, and the difference: one aggregation."""
    of = lambda c: F.avg(F.when(F.col(condition) == c, F.col("value")))
    return parts.groupBy(*keys).agg(of(before).alias("before"), of(after).alias("after")).withColumn("change", F.col("after") - F.col("before"))


def signal_change(scores: DataFrame, condition: str, before: str, after: str, group: str, a: str, b: str, *keys: str) -> DataFrame:
    """How far groups a and b stand apart under two conditions, and whether the signal became clearer or fuzzier."""
    mean = lambda c, g: F.avg(F.when((F.col(condition) == c) & (F.col(group) == g), F.col("value")))
    g = scores.groupBy(*keys).agg((mean(before, b) - mean(before, a)).alias("before"), (mean(after, b) - mean(after, a)).alias("after"))
    change = F.abs("after") - F.abs("before")
    return g.withColumns({"change": change, "signal": F.when(change > 0, "clearer").when(change < 0, "fuzzier").otherwise("unchanged")})


def nearest_other(points: DataFrame, limit: float) -> DataFrame:
    """For each point (gt_id, block_name, time, y, x) the nearest other one of its frame within the limit.

    A point is met with the cells of three limits that its limit reaches, fewer than three of them on average.
    """
    cell = lambda c: F.floor(c / (3 * limit))
    reach = lambda c: F.explode(F.sequence(cell(F.col(c) - limit), cell(F.col(c) + limit)))
    p = points.select("gt_id", "block_name", "time", "y", "x", reach("y").alias("cy")).withColumn("cx", reach("x"))
    q = points.select("block_name", "time", F.col("gt_id").alias("other"), F.col("y").alias("oy"), F.col("x").alias("ox"), cell(F.col("y")).alias("cy"), cell(F.col("x")).alias("cx"))
    m = p.join(q.hint("merge"), ["block_name", "time", "cy", "cx"]).where("gt_id <> other").withColumn("distance", norm(F.col("y") - F.col("oy"), F.col("x") - F.col("ox"))).where(F.col("distance") <= limit)
    best = m.groupBy("gt_id", "block_name", "time").agg(F.min_by(F.struct("other", "distance"), F.struct("distance", "other")).alias("b")).select("gt_id", "block_name", "time", "b.*")
    return points.select("gt_id", "block_name", "time").join(best.hint("merge"), ["gt_id", "block_name", "time"], "left")


def availability(wide: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """For each wanted feature where it comes from (present, derived from another, missing), its values and distinct ones."""
    have = set(wide.columns)
    rows = []
    for name, source in wanted.items():
        status = "present" if name in have else "derived" if source in have else "missing"
        c = F.col(name if name in have else source) if status != "missing" else F.lit(None)
        rows += [(name, status, F.count(c), F.count_distinct(c))]
    one = wide.agg(*[x for k, (_, _, n, u) in enumerate(rows) for x in (n.alias(f"n{k}"), u.alias(f"u{k}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(status).alias("status"), F.col(f"n{k}").alias("n_nonmissing"), F.col(f"u{k}").alias("n_unique")) for k, (name, status, _, _) in enumerate(rows)])).alias("r")).select("r.*")


def block_audit(blocks: DataFrame, key: str, checks: dict[str, Column], skip: Column, strict: bool = False) -> DataFrame:
    """Each block as ok, skipped or failed with the first check that fails; if strict a failed one stops the job."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    out = blocks.select(key, F.when(skip, "skipped").when(error.isNotNull(), "failed").otherwise("ok").alias("status"), F.when(~skip, error).alias("error"))
    bad = out.where("status = 'failed'").limit(5).collect() if strict else []
    if bad:
        raise ValueError(f"blocks failed: {[(r[0], r[2]) for r in bad]}")
    return out


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[Column], needed: Sequence[str]) -> DataFrame:
    """Rows with all needed values, the first of each key."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.dropna(subset=list(needed)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fold_filter(long: DataFrame, fold: str, max_missing: float, threshold: float, order: Sequence[str]) -> DataFrame:
    """(fold, feature, kept, reason): per training fold, features with enough values that vary, less those that follow another.

    long is (fold, subject, feature, value), a row for each subject and feature. Rank correlations of all pairs are
    joined and summed by Spark; the greedy choice then runs over each fold's few features, in the given order: of two
    that go together the one with more missing values goes, or with less variance.
    """
    s = long.groupBy(fold, "feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.count_distinct("value").alias("unique"), F.var_samp("value").alias("variance"))
    s = s.withColumn("weak", F.when(F.col("missing") > max_missing, "missing").when(F.col("unique") < 2, "constant").when(F.coalesce(F.sqrt("variance") <= 1e-12, F.lit(True)), "constant"))
    good = kept(long.where("value IS NOT NULL").join(s.where("weak IS NULL").select(fold, "feature").hint("merge"), [fold, "feature"], "left_semi").select(fold, "subject", "feature", "value"))
    a, b = good.toDF(fold, "subject", "a", "va"), good.toDF(fold, "subject", "b", "vb")
    p = kept(a.join(b.hint("merge"), [fold, "subject"]).where("a < b"))
    for by, name in (("va", "ra"), ("vb", "rb")):
        p = p.join(S.average_ranks(p, [fold, "a", "b"], by, name).hint("merge"), [fold, "a", "b", by])
    tied = p.groupBy(fold, "a", "b").agg(F.abs(F.corr("ra", "rb")).alias("r")).where(F.col("r") >= threshold)
    tied = tied.groupBy(fold).agg(F.collect_list(F.array("a", "b")).alias("pairs"))
    rank = {f: k for k, f in enumerate(order)}

    def run(pdf):
        pairs = {frozenset(x) for x in (pdf["pairs"].iloc[0] if pdf["pairs"].iloc[0] is not None else ())}
        rows = {r.feature: r for r in pdf.itertuples()}
        live = sorted((f for f, r in rows.items() if r.weak is None), key=lambda f: rank.get(f, len(rank)))
        gone: dict[str, str] = {}
        for i, x in enumerate(live):
            for y in live[i + 1 :]:
                if x in gone:
                    break
                if y not in gone and frozenset((x, y)) in pairs:
                    worse = y if (rows[x].missing, -rows[x].variance) <= (rows[y].missing, -rows[y].variance) else x
                    gone[worse] = "follows " + (x if worse == y else y)
        why = [r.weak or gone.get(f) for f, r in rows.items()]
        return pdf[[fold, "feature"]].assign(kept=[w is None for w in why], reason=why)

    kind = dict(long.dtypes)[fold]
    return s.join(tied.hint("merge"), fold, "left").groupBy(fold).applyInPandas(run, f"{fold} {kind}, feature string, kept boolean, reason string")


def distribution(long: DataFrame, value: str, *group: str) -> DataFrame:
    """n, mean, median, quartiles and 90 % quantile of a value in each group, from counts of its distinct values."""
    q = quantiles(long, list(group), value, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9})
    mean = long.groupBy(*group).agg(F.avg(value).alias("mean"))
    return q.join(mean.hint("merge"), list(group)) if group else q.withColumn("mean", F.lit(mean.first()[0]))


def histogram(rows: DataFrame, value: str, bins: int, top: float, *group: str) -> DataFrame:
    """Density of a value in equal bins between its least and a top quantile of all rows; larger values are left out."""
    lo = rows.agg(F.min(value)).first()[0]
    hi = quantiles(rows, [], value, {"top": top}).first()["top"]
    width = (hi - lo) / bins if hi > lo else 1.0
    r = rows.where(F.col(value).between(lo, hi)).withColumn("bin", F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int"))
    n = r.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(*group)) / F.lit(width))


def start_and_end(tracks: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Median of each feature at the first and the last observation of tracks, by group."""
    g = tracks.groupBy(group, *KEY).agg(*[f(c, "time").alias(f"{n}_{c}") for c in features for f, n in ((F.min_by, "start"), (F.max_by, "end"))])
    names = [f"{n}_{c}" for c in features for n in ("start", "end")]
    g = kept(g.select(group, *[F.col(n).cast("double").alias(n) for n in names]))
    middle = quantiles(g.unpivot(group, names, "_name", "_value"), [group, "_name"], "_value", {"_median": 0.5})
    wide = middle.groupBy(group).pivot("_name", names).agg(F.first("_median"))
    return g.groupBy(group).agg(F.count("*").alias("n_tracks")).join(wide.hint("merge"), group)


def retained(tracks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tracks of each block of the metadata and its frame interval; blocks without tracks have none."""
    n = tracks.groupBy("block_name").agg(F.count_distinct("track_id").alias("n_tracks"))
    return metadata.select("block_name", "time_interval_seconds").join(n.hint("merge"), "block_name", "left").fillna(0, ["n_tracks"])


def top_variance(long: DataFrame, k: int, chosen: DataFrame) -> DataFrame:
    """The k features of largest variance that are not chosen yet, ties by name."""
    g = long.join(F.broadcast(chosen.select("feature").limit(10_000)), "feature", "left_anti") if chosen.limit(10_001).count() <= 10_000 else long.join(chosen.select("feature"), "feature", "left_anti")
    g = g.groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return g.orderBy(F.desc("variance"), "feature").limit(k)


def sample_each(rows: DataFrame, group: Sequence[str], ids: Sequence[str], n: int, seed: int) -> DataFrame:
    """n rows of each group, those of least hash of their id and the seed."""
    w = W.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", *ids, F.lit(seed))), *ids)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def spread(rows: DataFrame, group: Sequence[str], by: str, each: int, trim: int = 0) -> DataFrame:
    """each positions from every third of a group's ordered rows, evenly spaced; trim rows at either end are left out."""
    w = W.partitionBy(*group).orderBy(by)
    r = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(*group))}).where((F.col("_i") >= trim) & (F.col("_i") < F.col("_n") - trim))
    r = r.withColumns({"_i": F.col("_i") - trim, "_n": F.col("_n") - 2 * trim})
    picks = []
    for third in range(3):
        lo, hi = F.floor(F.col("_n") * third / 3), F.floor(F.col("_n") * (third + 1) / 3) - 1
        at = [F.rint(lo + (hi - lo) * (k / (each - 1) if each > 1 else 0.5)) for k in range(each)]
        picks.append(F.when((F.col("_i") >= lo) & (F.col("_i") <= hi) & F.array_contains(F.array(*at), F.col("_i").cast("double")), third))
    return r.withColumn("third", F.coalesce(*picks)).where("third IS NOT NULL").drop("_i", "_n")


def worklist(a: DataFrame, b: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Keys that either table has, less the excluded ones."""
    return a.select(key).unionAll(b.select(key)).distinct().join(excluded.select(key), key, "left_anti")


def chosen_union(selection: DataFrame) -> DataFrame:
    """Features that any fold chose, in order of how many did, then by name."""
    g = selection.where("coefficient <> 0").groupBy("feature").agg(F.count_distinct("fold").alias("n_folds"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_folds"), "feature")))


def named_order(c: str, values: Sequence[str]) -> Column:
    """The place of a column's value in a named order, to sort by; values that are not named come last."""
    rank = F.lit(len(values))
    for k, v in enumerate(values):
        rank = F.when(F.col(c) == v, k).otherwise(rank)
    return rank


def in_order(rows: DataFrame, **orders: Sequence[str]) -> DataFrame:
    """Rows by named orders of their columns' values, then by name."""
    return rows.orderBy(*[k for c, values in orders.items() for k in (named_order(c, values), F.col(c))])


def feret_proxies(rows: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """Largest, middle and least of three lengths."""
    three = [F.col(x) for x in (a, b, c)]
    return rows.withColumns({"feret_max": F.greatest(*three), "feret_median": middle_of(*three), "feret_min": F.least(*three)})


def without_subjects(rows: DataFrame, subject: str, names: Sequence[str]) -> DataFrame:
    """Rows with a subject that is none of the named."""
    return rows.where(F.col(subject).isNotNull() & ~F.col(subject).isin(*names))


def outer_chain(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables on a key, their other columns kept apart by the caller's prefixes."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.hint("merge"), key, "full_outer")
    return out


def replaced(rows: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with columns recomputed: those of fresh replace their own, null where fresh has no row."""
    new = [c for c in fresh.columns if c not in key]
    return rows.drop(*new).join(fresh.hint("merge"), list(key), "left")


def time_offset(rows: DataFrame, time: str, frames: int) -> Column:
    """What to take off frame numbers that may start at 0 or 1, from the least and the greatest of them."""
    lo, hi = rows.agg(F.min(time), F.max(time)).first()
    if lo is None:
        return F.lit(0)
    if lo >= 1 and hi == frames:
        return F.lit(1)
    if lo >= 0 and hi <= frames - 1:
        return F.lit(0)
    raise ValueError(f"frames {lo} to {hi} don't fit {frames} of them")


def label_column(rows: DataFrame, candidates: Sequence[str], labels: DataFrame, key: Sequence[str], label: str, least: float = 0.5) -> DataFrame:
    """(column, n, matched, share) of candidate columns by how many of their values are labels of the row's frame, best first.

    A best share under least is an error.
    """
    long = rows.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("_label")) for c in candidates])).alias("c")).select(*key, "c.*").where("_label IS NOT NULL")
    known = labels.select(*key, F.col(label).cast("long").alias("_label")).distinct().withColumn("_hit", F.lit(1))
    g = long.join(known.hint("merge"), [*key, "_label"], "left").groupBy("column").agg(F.count("*").alias("n"), F.count("_hit").alias("matched"))
    g = kept(g.withColumn("share", F.col("matched") / F.col("n")))
    best = g.agg(F.max("share")).first()[0]
    if best is None or best < least:
        raise ValueError(f"no column matches the labels: {best}")
    return g


def numeric_candidates(df: DataFrame, excluded: Sequence[tuple[str, str]]) -> DataFrame:
    """(feature, candidate, reason) of df's columns: numeric ones whose name no excluding pattern (kind, regex) meets."""
    import re

    rows = []
    for name, kind in df.dtypes:
        why = next((k for k, pattern in excluded if re.search(pattern, name, re.I)), None) or (None if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else "not numeric")
        rows.append((name, why is None, why))
    return df.sparkSession.createDataFrame(rows, "feature string, candidate boolean, reason string")


def share_text(part: Column, whole: Column, digits: int = 1) -> Column:
    """'a / b (p %)', or 'a / b' where b is 0."""
    text = F.format_string("%d / %d", part.cast("long"), whole.cast("long"))
    return F.when(whole > 0, F.concat(text, F.format_string(f" (%.{digits}f %%)", F.round(100.0 * part / whole, digits)))).otherwise(text)


def name_parts(path: Column) -> dict[str, Column]:
    """Subject, safe name, date and acquisition number of a file name, and the genotype that its text tells."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    found = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return {"subject": found(r"(?i)(fish[_-]?\d+)"), "safe_name": safe_name(name), "date": found(r"(\d{8})"), "acquisition": found(r"(?i)block[_-]?(\d+)").try_cast("int"), "genotype": group_in_name(path)}


def metadata_template(files: DataFrame, block: str) -> DataFrame:
    """A row for each block found, its group and subject to be filled in."""
    return files.select(block).distinct().select(block, F.lit(None).cast("string").alias("genotype"), F.lit(None).cast("string").alias("fish_id"))


def harvest(spark, folder: str, pattern: str) -> DataFrame:
    """All result files below a folder whose path tells (method, model, dataset), as one table."""
    r = spark.read.option("recursiveFileLookup", True).option("header", True).option("inferSchema", True).csv(folder)
    path = F.col("_metadata.file_path")
    return r.select(*[F.regexp_extract(path, pattern, k).alias(n) for k, n in ((1, "method"), (2, "model"), (3, "dataset"))], "*")




def choose_features(df: DataFrame, priority: Sequence[str], ids: Sequence[str], most: int) -> list[str]:
    """Up to most features: those of the priority list that are there, then the other numeric columns but ids."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in ids]
    return [*(c for c in priority if c in numeric), *(c for c in numeric if c not in priority)][:most]


def inventory(files: DataFrame, path: str, excluded: DataFrame) -> DataFrame:
    """Files with the date and acquisition of their names, what is wrong with each, and whether its date and acquisition are excluded.

    excluded is (date, acquisition), a null acquisition standing for all of its date.
    """
    parts = name_parts(F.col(path))
    f = files.select(path, parts["date"].alias("date"), parts["acquisition"].alias("acquisition"))
    e = excluded.groupBy("date").agg(F.bool_or(F.col("acquisition").isNull()).alias("_all"), F.collect_set("acquisition").alias("_some"))
    f = f.join(e.hint("merge"), "date", "left")
    error = F.when(F.col("date").isNull(), "no date").when(F.col("acquisition").isNull(), "no acquisition")
    return f.select(path, "date", "acquisition", error.alias("error"), F.coalesce(F.col("_all") | F.array_contains("_some", F.col("acquisition")), F.lit(False)).alias("excluded"))


def track_lengths(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, median and largest of each length over each track, and its change from the first to the last time."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.max(c).alias(f"{c}_max"), (F.max_by(c, "time") - F.min_by(c, "time")).alias(f"{c}_change"))]
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *aggs)


def subject_medians(long: DataFrame, subject: str, low: float, high: float) -> DataFrame:
    """Median and IQR of each feature in each subject, and the feature's limits of display over all rows."""
    own = quantiles(long, [subject, "feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    every = quantiles(long, ["feature"], "value", {"low": low, "high": high}).drop("n")
    return own.join(sized(every), "feature").select(subject, "feature", "n", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "low", "high")


def separation(points: DataFrame, subject: str, group: str, x: str, y: str) -> DataFrame:
    """How far two groups of a cohort stand apart in a plane: distance of centres, scatter within, their ratio, silhouette.

    Distances of subjects are those of a cohort's few rows, joined block by block.
    """
    g = points.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = points.join(sized(g), group).withColumn("d", norm(F.col(x) - F.col("mx"), F.col(y) - F.col("my")))
    c = d.groupBy(group).agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.avg("d").alias("scatter"))
    ends = c.agg(F.min_by(F.struct("mx", "my"), group).alias("a"), F.max_by(F.struct("mx", "my"), group).alias("b"), F.avg("scatter").alias("within"))
    ends = ends.select(norm(F.col("a.mx") - F.col("b.mx"), F.col("a.my") - F.col("b.my")).alias("between"), "within").first()
    long = points.select(F.col(subject).alias("subject"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("z")) for n in (x, y)])).alias("v")).select("subject", "v.*")
    pairs = S.subject_distances(long)
    both = pairs.select("a", "b", "distance").unionAll(pairs.select("b", "a", "distance"))
    kind = points.select(F.col(subject).alias("a"), F.col(group).alias("ga"))
    both = both.join(sized(kind), "a").join(sized(kind.toDF("b", "gb")), "b")
    s = both.groupBy("a").agg(F.avg(F.when(F.col("ga") == F.col("gb"), F.col("distance"))).alias("own"), F.avg(F.when(F.col("ga") != F.col("gb"), F.col("distance"))).alias("other"))
    silhouette = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return s.agg(F.lit(ends["between"]).alias("between"), F.lit(ends["within"]).alias("within"), F.lit(ends["between"] / ends["within"]).alias("ratio"), F.avg(silhouette).alias("silhouette"))


def frozen_projection(long: DataFrame, train: Column, loadings: DataFrame) -> DataFrame:
    """Scores of all subjects on frozen axes: medians, means and scales come from the training subjects alone.

    long is (subject, feature, value), a row for each; loadings is (axis, feature, loading).
    """
    fitted = quantiles(long.where(train), ["feature"], "value", {"median": 0.5}).drop("n")
    filled = long.join(sized(fitted), "feature").withColumn("value", F.coalesce("value", "median"))
    scale = filled.where(train).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = filled.join(sized(scale), "feature").withColumn("z", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return z.join(sized(loadings), "feature").groupBy("subject", "axis").agg(F.sum(F.col("z") * F.col("loading")).alias("score"))
