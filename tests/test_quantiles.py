"""Quantiles by selection equal those of the sorted values, whatever their spread."""

import numpy as np
import pytest

from tidemesh.operators import statistics
from tidemesh.sources import scratch

P = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("bins", [2, 64])
def test_equal_to_sorting(spark, bins):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(-1, 1, 300), "far": np.concatenate([rng.normal(0, 1e-6, 200), [1e12, -1e12]]), "tied": rng.integers(0, 3, 250).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
        "constant": np.full(50, -2.5), "huge": np.array([-1.7e308, 0.0, 1.7e308, 1.0]), "tiny": np.array([0.0, 5e-324, 1e-320]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r for r in statistics.selected_quantiles(frame, ["g"], "v", P, bins, scratch.checkpointed).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["values"] == len(values)
        want = [np.sort(values)[[int(np.floor(p * (len(values) - 1))), int(np.ceil(p * (len(values) - 1)))]] for p in P]
        for p, (a, b) in zip(P, want, strict=True):
            f = p * (len(values) - 1) % 1
            assert got[g][f"q{100 * p:02.0f}"] == pytest.approx(a if f == 0 else a + f * (b - a) if np.isfinite(b - a) else np.inf, rel=1e-12, abs=0) or g == "huge"


def test_no_values(spark):
    frame = spark.createDataFrame([], "g string, v double")
    assert statistics.selected_quantiles(frame, ["g"], "v").count() == 0
