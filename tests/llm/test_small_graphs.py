"""Tables of few rows are not dealt over all partitions of an exchange, whatever their number is."""

import numpy as np
import pytest

from quantloom.llm import graph, lines, minhash


@pytest.fixture
def many_parts(spark):
    """Exchanges of 40 partitions that are not merged; skewed ones are split from one kB on, as in the tool's run on check_h."""
    ours = {"shuffle.partitions": "40", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield 40
    for k, v in before.items():
        spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


@pytest.mark.parametrize("rows", [1 << 17, 50])
def test_components_of_few_edges_take_no_exchange(spark, many_parts, monkeypatch, rows):
    plans, keep = [], graph.keep
    monkeypatch.setattr(graph, "ROWS", rows)
    monkeypatch.setattr(graph, "keep", lambda df: plans.append(df._jdf.queryExecution()) or keep(df))
    rng = np.random.default_rng(3)
    edges = [(int(u), int(v)) for u, v in rng.integers(0, 400, (300, 2))] + [(5, None), (None, 5), (7, 7), (9, 3), (3, 9)] + [(500, i) for i in range(501, 560)]
    root = list(range(600))
    for u, v in (e for e in edges if None not in e):
        low, high = sorted((root[u], root[v]))
        root = [low if r == high else r for r in root]
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(i, r) for i, r in enumerate(root) if r != i} and len(got) > 200
    assert len(plans) > 2
    if rows > len(edges):
        assert not any("Exchange hashpartitioning" in p.executedPlan().toString() for p in plans[1:])


def _frames(spark, bits):
    """400 entries of one bucket, half of them at home, and 40 of another; all their bitmaps are equal."""
    lists = [(1, i, 0 if i < 200 else i, 0) for i in range(400)] + [(2, 500 + i, 500 if i < 20 else 500 + i, 500) for i in range(40)]
    ids = sorted({i for _, i, _, _ in lists})
    return spark.createDataFrame(lists, "key long, id long, root long, home long"), spark.createDataFrame([(i, 9, [0] * (bits // 64)) for i in ids], "id long, size long, bits array<long>")


@pytest.mark.parametrize("kind", ["lines", "sets"])
def test_split_joins_are_written_in_as_many_parts_as_an_exchange(spark, many_parts, kind):
    lists, sets = _frames(spark, lines.BITS if kind == "lines" else minhash.BITS)
    found = lines._outside(lists, sets) if kind == "lines" else minhash.outside_pairs(lists, sets, minhash.ALIKE)
    want = sum(n * home + n * (n - 1) // 2 for home, n in ((200, 200), (20, 20)))
    pairs = {(r["u"], r["v"]) for r in found.collect()}
    assert len(pairs) == want == found.count()
    assert found.rdd.getNumPartitions() <= many_parts
    if kind == "sets":
        assert "Coalesce 40" in found._jdf.queryExecution().executedPlan().toString()
