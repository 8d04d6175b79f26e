"""Formulas too long for the JVM's compiler must not run interpreted."""

from quantloom.plans.registry import Tables
from quantloom.session import HUGE_METHOD


def test_limit_is_set_unless_chosen(spark):
    before = spark.conf.get(HUGE_METHOD)
    try:
        spark.conf.unset(HUGE_METHOD)
        Tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(HUGE_METHOD) == "8000"
        spark.conf.set(HUGE_METHOD, "4000")
        Tables(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(HUGE_METHOD) == "4000"
    finally:
        spark.conf.set(HUGE_METHOD, before)
