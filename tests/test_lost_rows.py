"""Rows that an inner join or a loose group key would lose or add."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quantloom.operators.gates import gate_mined
from quantloom.operators.portfolio import risk_rows
from quantloom.sources.files import json_facts


def test_candidates_without_unseen_rows_are_refused(spark):
    day = dt.date(2020, 1, 1)
    rows = [("seen", day + dt.timedelta(i), "seen_dev", 0.1 + i % 3) for i in range(30)]
    rows += [("new", day + dt.timedelta(i), "holdout", 0.1 + i % 3) for i in range(30)]
    ic = spark.createDataFrame(rows, "cand string, date date, tier string, ic double")
    got = gate_mined(ic, F.lit(1), F.lit(1.0), q=0.5, holdout_min=20, fresh_min=60, negative=-2.0, structural_min=0.5)
    found = {r["cand"]: r for r in got.collect()}
    assert set(found) == {"seen", "new"}
    assert found["seen"]["adoption"] == "" and found["seen"]["pooled_p"] is None
    assert found["new"]["adoption"] == "structural" and found["new"]["pooled_p"] < 0.01


def test_fallback_tag_is_dropped_for_a_filing_that_has_the_first_one(spark):
    fact = lambda end, filed, val: {"end": end, "filed": filed, "val": val}
    both = {"P": [fact("2020-03-31", "2020-05-01", 1)], "Q": [fact("2020-04-30", "2020-05-01", 2), fact("2020-06-30", "2020-08-01", 3)]}
    doc = json.dumps({"dei": {tag: {"units": {"shares": facts}} for tag, facts in both.items()}})
    got = json_facts(spark.createDataFrame([(1, doc)], "id long, doc string"), "id", "doc", "dei", ["P", "Q"], "shares")
    assert sorted((str(r["filed"]), r["tag"], r["val"]) for r in got.collect()) == [("2020-05-01", "P", 1), ("2020-08-01", "Q", 3)]


def test_names_without_a_sector_stay_in_the_risk_model(spark):
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(i), 100.0 + i * (k + 1) % 7, "A" if s == "x" else None) for k, s in enumerate("xyz") for i in range(30)]
    got = risk_rows(spark.createDataFrame(rows, "symbol string, date date, close double, sector string"), 20, 5).toPandas()
    assert len(got) == 3 * 29 and set(got.sector) == {"A", "Unknown"}
    whole = got.beta * got.market + got.sector_ret + got.eps
    assert (whole - got.r).abs().max() < 1e-12
