"""Surfaces smoothed line by line equal the whole grid's, and the spline goes through its places."""

import numpy as np
import pytest

from tidemesh.operators import kernels


def whole(z, sigma, zoom, top):
    """Both axes of the whole grid at once: filters as matrices, splines from their equations."""

    def blur(n, s):
        radius, m = int(4 * s + 0.5), np.zeros((n, n))
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / s) ** 2)
        for i in range(n):
            for d, x in zip(range(-radius, radius + 1), w / w.sum(), strict=True):
                j = (i + d) % (2 * n)
                m[i, j if j < n else 2 * n - 1 - j] += x
        return m

    def refine(n, k):
        size = round(n * k)
        basis = lambda t: np.where(np.abs(t) < 1, 2 / 3 - t**2 + np.abs(t) ** 3 / 2, np.where(np.abs(t) < 2, (2 - np.abs(t)) ** 3 / 6, 0))
        places = np.arange(-n, 2 * n)
        fold = np.zeros((3 * n, n))
        for row, p in enumerate(places):
            q = abs(p)
            fold[row, 2 * (n - 1) - q if q > n - 1 else q] = 1
        at = lambda x: basis(x[:, None] - places) @ fold
        return at(np.linspace(0, n - 1, size)) @ np.linalg.inv(at(np.arange(n)))

    a, b = blur(z.shape[0], sigma[0]), blur(z.shape[1], sigma[1])
    if zoom[0] != 1:
        a = refine(z.shape[0], zoom[0]) @ a
    if zoom[1] != 1:
        b = refine(z.shape[1], zoom[1]) @ b
    return np.clip(a @ z @ b.T, 0, top)


@pytest.mark.parametrize("zoom", [(1, 1), (3, 2), (2, 1)])
def test_line_by_line(spark, zoom):
    rng = np.random.default_rng(7)
    z = rng.uniform(0, 6, (6, 11))
    z[2, 3] = 0
    cells = [(10 * i, j - 4, float(z[i, j])) for i in range(6) for j in range(11) if (i, j) != (2, 3)]
    frame = spark.createDataFrame(cells, "w int, p int, d double").repartition(3)
    got = kernels.smoothed_surface(frame, "w", "p", "d", zoom=zoom, top=4.0).toPandas()
    want = whole(z, (2.2, 2.8), zoom, 4.0)
    assert len(got) == want.size
    assert np.allclose(got.sort_values(["w", "p"]).d.to_numpy().reshape(want.shape), want)
    assert (got.w.min(), got.w.max(), got.p.min(), got.p.max()) == (1, want.shape[0], 1, want.shape[1])


def test_empty_and_single(spark):
    frame = spark.createDataFrame([(1, 1, 2.0)], "w int, p int, d double")
    assert [tuple(r) for r in kernels.smoothed_surface(frame, "w", "p", "d", zoom=(1, 1)).collect()] == [(1, 1, pytest.approx(2.0))]
    assert kernels.smoothed_surface(frame.limit(0), "w", "p", "d").count() == 0
