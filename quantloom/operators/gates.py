"""Adoption gates over tables of per-tier statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.normal import onesided_p
from quantloom.functions.rounding import snap
from quantloom.operators.evaluation import bh_flags, summarize_ic
from quantloom.session import cut

C = F.col


def admissible(min_t: float, min_coverage: float, max_corr: float, min_residual_t: float) -> Column:
    """First reason to refuse a pool candidate, or "admitted"."""
    return (
        F.when(C("error"), "error")
        .when(C("quarantined"), "quarantined")
        .when(C("duplicate"), "duplicate")
        .when(C("signed_t") < min_t, "signed dev t below bar")
        .when(C("coverage").isNull() | (C("coverage") < min_coverage), "coverage below bar")
        .when(C("incumbent_hit"), "redundant with incumbent")
        .when(F.abs("incumbent_corr") >= max_corr, "corr with incumbent")
        .when(F.abs("pool_corr") >= max_corr, "corr with pool member")
        .when(C("residual_t") < min_residual_t, "residual t below bar")
        .otherwise("admitted")
    )


def gate_literature(tiers: DataFrame, key: str, bar: float, negative: float, fresh_min: int) -> DataFrame:
    """PASS when the holdout t reaches the bar and no tier is significantly negative (a short fresh tier has no veto)."""
    veto = (C("t_stat") <= negative) & ((C("tier") != "fresh") | (C("n_days") >= fresh_min))
    g = tiers.groupBy(key).agg(
        F.coalesce(F.max(F.when(C("tier") == "holdout", C("t_stat"))), F.lit(0.0)).alias("holdout_t"),
        F.count_if(veto).alias("_neg"),
    )
    verdict = F.when((C("holdout_t") >= bar) & (C("_neg") == 0), "PASS").otherwise("FAIL")
    return g.select(key, "holdout_t", verdict.alias("verdict"))


def gate_mined(
    ic: DataFrame, direction: Column, gain: Column, q: float, holdout_min: int, fresh_min: int, negative: float,
    structural_min: float,
) -> DataFrame:
    """Structural or probation adoption of candidates from their daily ICs, one Benjamini-Hochberg family.

    ``ic`` has (cand, date, tier, ic). Unseen tiers are virgin_early, holdout and fresh; the recent ones
    are the last two. Both p-values of every candidate enter the family. A candidate without unseen rows has no
    p-values and is not adopted.
    """
    by_tier = summarize_ic(ic, 0, by=["cand", "tier"])
    available = C("n_days") >= F.when(C("tier") == "fresh", fresh_min).otherwise(1)
    per = by_tier.withColumn("_sign", direction)
    veto = (C("_sign") * C("t_stat") <= negative) & ((C("tier") != "fresh") | (C("n_days") >= fresh_min))
    signed = C("_sign") * C("ic_mean")
    in_tier = lambda n: F.max(F.when((C("tier") == n) & available, signed))
    wide = per.groupBy("cand").agg(
        F.coalesce(F.max(F.when(C("tier") == "holdout", C("n_days"))), F.lit(0)).alias("_ho_n"),
        F.count_if(veto).alias("_neg"),
        in_tier("virgin_early").alias("_ve"),
        in_tier("holdout").alias("_ho"),
        in_tier("fresh").alias("_fr"),
    )
    pooled = summarize_ic(ic.where(C("tier") != "seen_dev"), 0, by=["cand"])
    recent = summarize_ic(ic.where(C("tier").isin("holdout", "fresh")), 0, by=["cand"])
    rows = (
        wide.join(pooled.select("cand", C("t_stat").alias("_pt")), "cand", "left")
        .join(recent.select("cand", C("t_stat").alias("_rt"), C("ic_mean").alias("_ric")), "cand", "left")
        .withColumn("_sign", direction)
    )
    rows = cut(
        rows.withColumns(
            {"pooled_p": snap(onesided_p(C("_pt"), C("_sign"))), "recent_p": snap(onesided_p(C("_rt"), C("_sign")))}
        )
    )
    family = rows.select(F.explode(F.array("pooled_p", "recent_p")).alias("p")).where(C("p").isNotNull())
    flagged = bh_flags(family, "p", q)
    level = flagged.agg(F.coalesce(F.max(F.when(C("rejected") == 1, C("p"))), F.lit(-1.0))).scalar()
    tiers = [C("_ve"), C("_ho"), C("_fr")]
    count = lambda conds: sum((F.coalesce(c, F.lit(False)).cast("int") for c in conds), F.lit(0))
    avail, positive = count([x.isNotNull() for x in tiers]), count([x > 0 for x in tiers])
    refused = (C("_ho_n") < holdout_min) | (gain <= 0) | (C("_neg") > 0)
    structural = (
        (C("pooled_p") <= level) & (C("_sign") * C("_pt") >= structural_min)
        & (positive >= F.least(F.lit(2), avail)) & (C("_sign") * C("_ric") >= 0)
    )
    not_bad = lambda x: F.coalesce(x > 0, F.lit(True))
    probation = (C("recent_p") <= level) & not_bad(C("_ho")) & not_bad(C("_fr"))
    adoption = F.when(refused, "").when(structural, "structural").when(probation, "probation").otherwise("")
    return rows.select("cand", "pooled_p", "recent_p", adoption.alias("adoption"))
