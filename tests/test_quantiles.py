"""Exact quantiles by histograms between bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewgraph.functions import quantiles as Q
from reviewgraph.operators import validation as V

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def groups(seed):
    """Values of very different shapes, with ties and far ends."""
    rng = random.Random(seed)
    return {"even": [i / 7 for i in range(900)],
            "tied": [rng.choice([1.5, 2.0, -3.0]) for _ in range(400)],
            "steep": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(700)],
            "one": [4.25], "two": [2.0, 5.0], None: [rng.gauss(0, 1) for _ in range(300)],
            "far": [-1.7e308, 1.7e308, 0.0] + [rng.random() for _ in range(200)]}


def frame(spark, by_group, weight=1):
    rows = [(g, v, weight) for g, values in by_group.items() for v in values]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double, w int").repartition(5)


def check(got, by_group):
    assert {r["g"] for r in got} == set(by_group) and len(got) == len(by_group)
    for r in got:
        values = sorted(by_group[r["g"]])
        assert (r["n"], r["low"], r["high"]) == (len(values), values[0], values[-1])
        for share, point in zip(SHARES, r["points"]):
            place = share * (len(values) - 1)
            a, b = values[int(np.floor(place))], values[int(np.ceil(place))]
            assert point == a + (b - a) * (place - np.floor(place))


@pytest.mark.parametrize("bins, ordered", [(256, 4096), (16, 3)])
def test_all_groups_match_sorting(spark, monkeypatch, bins, ordered):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "ORDERED", ordered)
    by_group = groups(1)
    if bins < 256:
        del by_group["steep"], by_group["far"]  # some hundred rounds with so few bins
    check(Q.exact_quantiles(frame(spark, by_group), "v", ("g",), SHARES).collect(), by_group)


def test_steep_values_take_histograms_and_no_group_is_gathered(spark, monkeypatch):
    monkeypatch.setattr(Q, "ORDERED", 20)
    widths = []
    real = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda values, wide: widths.append(
        wide.agg(F.max("distinct")).first()[0]) or real(values, wide))
    by_group = {g: groups(2)[g] for g in ("even", "steep")}
    check(Q.exact_quantiles(frame(spark, by_group), "v", ("g",), SHARES).collect(), by_group)
    assert widths and widths == sorted(widths, reverse=True)


def test_weights_missing_values_and_no_groups(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", None, 9), ("a", 9.0, 0), ("b", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = Q.exact_quantiles(df, "v", ("g",), (0.5, 0.9), F.col("w")).collect()
    assert [(r["g"], r["n"], r["low"], r["high"]) for r in got] == [("a", 4, 1.0, 2.0)]
    assert got[0]["points"] == [1.0, pytest.approx(1.7)]
    whole = Q.exact_quantiles(df, "v", (), (0.5,)).collect()
    assert [(r["n"], r["points"]) for r in whole] == [(3, [2.0])]
    assert Q.exact_quantiles(df.limit(0), "v", ("g",), (0.5,)).collect() == []


def test_a_hot_group_equals_the_built_in_percentile(spark):
    df = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50))
        .alias("lmu"), (F.xxhash64("id") % 100_000 / 7).alias("match"))
    got = {r["lmu"]: r for r in V.quartiles(df, "match").collect()}
    want = df.groupBy("lmu").agg(F.percentile("match", F.array(*map(F.lit, V.QUARTILES))).alias(
        "q")).collect()
    assert len(got) == len(want)
    for r in want:
        own = got[r["lmu"]]
        assert [own["q1"], own["median"], own["q3"]] == pytest.approx(r["q"], abs=1e-6)
