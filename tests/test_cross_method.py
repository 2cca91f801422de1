from tidemesh.operators import kernels


def test_ten_groups_are_found_unless_the_figure_asks_for_eight(spark):
    names = [f"g{g}_{k}" for g in range(10) for k in range(2)]
    rows = [(1, a, b, 0.95 if a[:2] == b[:2] else 0.0) for a in names for b in names if a < b]
    pairs = spark.createDataFrame(rows, "window_id int, asset_1 string, asset_2 string, rho double")
    assert {r["best_k"] for r in kernels.cross_method(pairs).collect()} == {10}
    assert max(r["best_k"] for r in kernels.cross_method(pairs, 8).collect()) == 8
