"""Factor models from mergeable moments: every fold of a walk-forward is fitted from one pass over the panel.

Features are z-scored by date; one that is missing or flat on its date is 0, the mean. A date's rows leave two small tables: the sums, products and
label products of each group's features, and by feature and bin the count and label sum. Both merge by addition, so a fold's
fit is a sum of the dates in its window, whatever the number of folds, groups and models, and no model object exists: a fitted
model is a row of coefficients that joins the panel, so scoring is one projection.

``linear`` solves the ridge equations of a group's features. ``split`` cuts the rows at the bin border of one feature that
reduces the label's variance most (ties: first feature by name, lowest border) and predicts the means of both sides. Tables of dates, folds and
coefficients are bounded by the calendar and the number of folds; only they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.rounding import snap
from quantloom.operators.evaluation import correlation
from quantloom.operators.panel import Panel

C = F.col

MODELS = ("linear", "split")
RIDGE = 0.01
#: Bins of a z-score: so many of equal width between -REACH and REACH, the outer ones open.
BINS, REACH = 16, 3.0

Groups = dict[str, list[str]]


def names(groups: Groups) -> list[str]:
    """The features of all groups, each once, in order."""
    return list(dict.fromkeys(f for fs in groups.values() for f in fs))


def standardised(panel: DataFrame, features: list[str]) -> DataFrame:
    """The panel with ``ord``, the number of its session, and a column z_<feature> for each feature."""
    each = [x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"))]
    # numbered after the aggregate, which has one row a session: the panel's source is not read again for its dates
    stats = panel.groupBy("date").agg(*each).withColumn("ord", F.row_number().over(Window.orderBy("date")))
    rows = panel.join(F.broadcast(stats), "date")
    z = {f"z_{f}": F.coalesce(snap(F.try_divide(C(f) - C(f"m_{f}"), C(f"s_{f}"))), F.lit(0.0)) for f in features}
    return rows.withColumns(z).drop(*[f"{k}_{f}" for f in features for k in "ms"])


def bin_of(z: Column) -> Column:
    place = F.floor((z + REACH) * (BINS / (2 * REACH)))
    return F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int")


def date_moments(rows: DataFrame, groups: Groups, label: str) -> DataFrame:
    """One row a session: n, y, and for each group's features the sums z, zy and the products zz of each pair."""
    features, pairs = names(groups), sorted({(a, b) for fs in groups.values() for i, a in enumerate(fs) for b in fs[i:]})
    made = [F.count(F.lit(1)).alias("n"), F.sum(label).alias("y")]
    made += [F.sum(f"z_{f}").alias(f"z_{f}") for f in features] + [F.sum(C(f"z_{f}") * C(label)).alias(f"zy_{f}") for f in features]
    made += [F.sum(C(f"z_{a}") * C(f"z_{b}")).alias(f"zz_{a}_{b}") for a, b in pairs]
    return rows.where(C(label).isNotNull()).groupBy("ord").agg(*made)


def date_bins(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """(ord, feature, bin, n, y): rows and label sums, by session, feature and bin."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(C(f"z_{f}")).alias("bin")) for f in features])).alias("cell")
    long = rows.where(C(label).isNotNull()).select("ord", C(label).alias("label"), cells)
    return long.groupBy("ord", "cell.feature", "cell.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))


def _within(dated: DataFrame, windows: DataFrame) -> DataFrame:
    return dated.join(F.broadcast(windows.select("fold", "fit_lo", "fit_hi")), C("ord").between(C("fit_lo"), C("fit_hi")))


def linear_fits(moments: DataFrame, windows: DataFrame, groups: Groups) -> DataFrame:
    """One row a fold: the ridge coefficients b_<group>_<feature> and intercepts b_<group>."""
    sums = [c for c in moments.columns if c != "ord"]
    df = _within(moments, windows).groupBy("fold").agg(*[F.sum(c).alias(c) for c in sums])
    kept = ["fold"]
    for g, fs in groups.items():
        k = len(fs)
        mean = lambda c: F.try_divide(C(c), C("n"))
        pair = lambda a, b: f"zz_{a}_{b}" if f"zz_{a}_{b}" in moments.columns else f"zz_{b}_{a}"
        start = {f"a{i}_{j}": mean(pair(fs[i], fs[j])) - mean(f"z_{fs[i]}") * mean(f"z_{fs[j]}") + (RIDGE if i == j else 0.0) for i in range(k) for j in range(k)}
        df = df.withColumns(start | {f"a{i}_{k}": mean(f"zy_{fs[i]}") - mean(f"z_{fs[i]}") * mean("y") for i in range(k)})
        for p in range(k):  # elimination; the ridge keeps every pivot positive
            df = df.withColumns({f"a{i}_{j}": C(f"a{i}_{j}") - C(f"a{i}_{p}") / C(f"a{p}_{p}") * C(f"a{p}_{j}") for i in range(p + 1, k) for j in range(p, k + 1)})
        for i in reversed(range(k)):
            known = sum((C(f"a{i}_{j}") * C(f"b_{g}_{fs[j]}") for j in range(i + 1, k)), F.lit(0.0))
            df = df.withColumn(f"b_{g}_{fs[i]}", (C(f"a{i}_{k}") - known) / C(f"a{i}_{i}"))
        df = df.withColumn(f"b_{g}", mean("y") - sum((C(f"b_{g}_{f}") * mean(f"z_{f}") for f in fs), F.lit(0.0)))
        kept += [f"b_{g}", *[f"b_{g}_{f}" for f in fs]]
    return df.select(*kept)


def split_gains(bins: DataFrame, windows: DataFrame) -> DataFrame:
    """(fold, feature, bin, gain, low, high): what a cut behind each bin takes off the label's squared deviations, and the means of both sides."""
    cells = _within(bins, windows).groupBy("fold", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    every = Window.partitionBy("fold", "feature")
    so_far = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = cells.select("fold", "feature", "bin", *[F.sum(c).over(so_far).alias(f"{c}_low") for c in "ny"], *[F.sum(c).over(every).alias(c) for c in "ny"])
    cut = cut.withColumns({"n_high": C("n") - C("n_low"), "y_high": C("y") - C("y_low")}).where("n_high > 0")
    gain = C("y_low") * C("y_low") / C("n_low") + C("y_high") * C("y_high") / C("n_high") - C("y") * C("y") / C("n")
    return cut.select("fold", "feature", "bin", snap(gain).alias("gain"), (C("y_low") / C("n_low")).alias("low"), (C("y_high") / C("n_high")).alias("high"))


def split_fits(bins: DataFrame, windows: DataFrame, groups: Groups) -> DataFrame:
    """One row a fold: the best cut of each group as a struct c_<group>."""
    gains = split_gains(bins, windows)
    order, cut = F.struct(-C("gain"), "feature", "bin"), F.struct("feature", "bin", "low", "high")
    return gains.groupBy("fold").agg(*[F.min_by(F.when(C("feature").isin(fs), cut), F.when(C("feature").isin(fs), order)).alias(f"c_{g}") for g, fs in groups.items()])


def fits(rows: DataFrame, windows: DataFrame, groups: Groups, label: str) -> DataFrame:
    """One row a fold with the coefficients of all groups and models."""
    linear = linear_fits(date_moments(rows, groups, label), windows, groups)
    return linear.join(split_fits(date_bins(rows, names(groups), label), windows, groups), "fold", "left")


def predictions(rows: DataFrame, fitted: DataFrame, windows: DataFrame, part: str, groups: Groups) -> DataFrame:
    """The rows of each fold's sessions <part>_lo to <part>_hi, with a column p_<group>_<model> for each model."""
    spans = windows.select("fold", C(f"{part}_lo").alias("lo"), C(f"{part}_hi").alias("hi")).join(fitted, "fold")
    made = rows.join(F.broadcast(spans), C("ord").between(C("lo"), C("hi")))
    p = {}
    for g, fs in groups.items():
        p[f"p_{g}_linear"] = snap(C(f"b_{g}") + sum((C(f"b_{g}_{f}") * C(f"z_{f}") for f in fs), F.lit(0.0)))
        at = F.coalesce(*[F.when(C(f"c_{g}.feature") == f, bin_of(C(f"z_{f}"))) for f in fs])
        p[f"p_{g}_split"] = snap(F.when(C(f"c_{g}").isNull(), C(f"b_{g}")).when(at <= C(f"c_{g}.bin"), C(f"c_{g}.low")).otherwise(C(f"c_{g}.high")))
    return made.withColumns(p).drop("lo", "hi", *[c for c in fitted.columns if c != "fold"])


def _ics(made: DataFrame, columns: dict[str, tuple], label: str, min_names: int, max_rows, keys: list[str]) -> DataFrame:
    """Mean daily rank IC of every column, as rows (fold, *keys, ic); a column without a day has a null one.

    The label is ranked once for all columns: each of them is null in every row of a fold or in none, as features never are.
    """
    p = Panel(made.where(C(label).isNotNull()).select("fold", "date", label, *columns), max_rows)
    target = p.rank(C(label), by=["fold"])
    ranks = {c: p.rank(C(c), by=["fold"]) for c in columns}
    wide = p.df.groupBy("fold", "date").agg(*[F.struct(correlation(ranks[c], target).alias("ic"), F.count(c).alias("n")).alias(c) for c in columns])
    named = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, key)], C(f"{c}.ic"), C(f"{c}.n")) for c, key in columns.items()])).alias("s")
    daily = wide.select("fold", "date", named).select("fold", "date", "s.*").where((C("n") >= min_names) & C("ic").isNotNull())
    mean = daily.groupBy("fold", *keys).agg(F.avg("ic").alias("ic"))
    wanted = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, key)]) for key in columns.values()])).alias("s")
    every = made.select("fold").distinct().select("fold", wanted).select("fold", "s.*")
    return every.join(mean, ["fold", *keys], "left")


def model_weights(checked: DataFrame, groups: Groups, label: str, min_names: int, max_rows=None) -> DataFrame:
    """(fold, factor_group, model, ic, weight): weights by positive IC within a group, equal when none is positive."""
    ics = _ics(checked, {f"p_{g}_{m}": (g, m) for g in groups for m in MODELS}, label, min_names, max_rows, ["factor_group", "model"])
    good = F.coalesce(F.greatest(C("ic"), F.lit(0.0)), F.lit(0.0))
    total = F.sum(good).over(Window.partitionBy("fold", "factor_group"))
    return ics.withColumn("weight", F.when(total > 0, good / total).otherwise(1.0 / len(MODELS)))


def _mixed(made: DataFrame, weights: DataFrame, groups: Groups) -> DataFrame:
    """A column g_<group> with the weighted mean of the group's models."""
    wide = weights.groupBy("fold").agg(*[F.max(F.when((C("factor_group") == g) & (C("model") == m), C("weight"))).alias(f"w_{g}_{m}") for g in groups for m in MODELS])
    mix = {f"g_{g}": snap(sum((C(f"p_{g}_{m}") * C(f"w_{g}_{m}") for m in MODELS), F.lit(0.0))) for g in groups}
    return made.join(F.broadcast(wide), "fold").withColumns(mix).drop(*[c for c in wide.columns if c != "fold"])


def group_weights(checked: DataFrame, weights: DataFrame, groups: Groups, label: str, min_names: int, max_rows=None) -> DataFrame:
    """(fold, factor_group, factor_ic, blend): blend by the root of the mixed models' positive IC, equal when none is positive."""
    ics = _ics(_mixed(checked, weights, groups), {f"g_{g}": (g,) for g in groups}, label, min_names, max_rows, ["factor_group"])
    raw = F.sqrt(F.coalesce(F.greatest(C("ic"), F.lit(0.0)), F.lit(0.0)))
    total = F.sum(raw).over(Window.partitionBy("fold"))
    return ics.select("fold", "factor_group", C("ic").alias("factor_ic"), F.when(total > 0, raw / total).otherwise(1.0 / len(groups)).alias("blend"))


def blended(made: DataFrame, weights: DataFrame, blend: DataFrame, groups: Groups) -> DataFrame:
    """factor_<group>, the mixed models z-scored by date (0 where flat), and ``pred``, their blend."""
    mixed = _mixed(made, weights, groups)
    stats = mixed.groupBy("fold", "date").agg(*[x for g in groups for x in (F.avg(f"g_{g}").alias(f"m_{g}"), F.stddev_samp(f"g_{g}").alias(f"s_{g}"))])
    wide = blend.groupBy("fold").agg(*[F.max(F.when(C("factor_group") == g, C("blend"))).alias(f"v_{g}") for g in groups])
    df = mixed.join(F.broadcast(stats), ["fold", "date"]).join(F.broadcast(wide), "fold")
    df = df.withColumns({f"factor_{g}": F.coalesce(snap(F.try_divide(C(f"g_{g}") - C(f"m_{g}"), C(f"s_{g}"))), F.lit(0.0)) for g in groups})
    df = df.withColumn("pred", snap(sum((C(f"factor_{g}") * C(f"v_{g}") for g in groups), F.lit(0.0))))
    return df.drop(*[f"{k}_{g}" for g in groups for k in "gmsv"], *[f"p_{g}_{m}" for g in groups for m in MODELS])


def inner_windows(folds: DataFrame, share: float = 0.85, purge: int = 6) -> DataFrame:
    """Sessions to fit, to weigh and to score, from ``folds(fold, first, last, out_lo, out_hi)``: ordinals, ends included.

    The last part of each training span measures the models; ``purge`` sessions before it are left out of the fit.
    """
    cut = F.floor((C("last") - C("first") + 1) * share).cast("int")
    return folds.select(
        "fold", C("first").alias("fit_lo"), (C("first") + F.greatest(cut - purge, F.lit(0)) - 1).alias("fit_hi"),
        (C("first") + cut).alias("val_lo"), C("last").alias("val_hi"), "out_lo", "out_hi",
    )


def ensembles(rows: DataFrame, windows: DataFrame, groups: Groups, label: str, min_names: int, max_rows=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coefficients, model weights and blend weights of every fold; ``rows`` come from ``standardised``."""
    fitted = fits(rows, windows, groups, label)
    checked = predictions(rows, fitted, windows, "val", groups)
    weights = model_weights(checked, groups, label, min_names, max_rows)
    return fitted, weights, group_weights(checked, weights, groups, label, min_names, max_rows)


def feature_votes(rows: DataFrame, features: list[str], label: str, keep: int) -> DataFrame:
    """(feature, linear, split, votes): the ``keep`` features with the best ranks in both models' importances.

    ``linear`` is the size of the ridge coefficient of all features together, ``split`` the largest variance reduction of one cut
    as a share of all features' largest; equal importances share a rank, equal votes go by name.
    """
    last = rows.agg(F.max("ord")).select(F.lit(0).alias("fold"), F.lit(1).alias("fit_lo"), C("max(ord)").alias("fit_hi"))
    one = linear_fits(date_moments(rows, {"all": features}, label), last, {"all": features})
    sizes = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), snap(F.abs(f"b_all_{f}")).alias("linear")) for f in features])).alias("s")).select("s.*")
    best = split_gains(date_bins(rows, features, label), last).groupBy("feature").agg(F.max("gain").alias("gain"))
    both = sizes.join(best, "feature", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    share = snap(F.try_divide(C("gain"), F.sum("gain").over(Window.partitionBy())))
    both = both.select("feature", "linear", share.alias("split"))
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    return both.withColumn("votes", place("linear") + place("split")).orderBy("votes", "feature").limit(keep)
