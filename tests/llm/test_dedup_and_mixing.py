import hashlib
import math
import re
import statistics
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import content_dedup, mixing, queries, sharding, simhash_bk

TEXTS = [
    (1, "a  b"), (2, "ab "), (3, "a b\n"), (4, None), (5, ""), (6, " \t\r\n\x0b\x0c"), (7, "ab "), (8, "long " * 30_000), (9, "x"), (9, "x"), (9, "y"), (None, "x"), (10, "ab"), (11, "é b"), (12, "éb"),
]
SCHEMA = "doc_id bigint, text string, source string, kept string, keep_id int, _t int"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None if i is None or i % 3 == 0 else f"s{i % 3}", "k", 0, 1) for i, t in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups_against_brute_force(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in content_dedup.exact_groups(frame(spark)).collect())
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for k, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            want.append((m[1], m[2], hashlib.sha256(k.encode()).hexdigest(), members[0][3], len(members), n == 0))
    assert got == sorted(want)


def test_exact_groups_hot_group_and_salts(spark):
    rows = [(k, "same text") for k in range(3000)] + [(5000 + k, f"t{k}") for k in range(50)]
    out = content_dedup.exact_groups(frame(spark, rows)).toPandas()
    hot = out[out.doc_id < 5000]
    assert set(hot.group_size) == {3000} and set(hot.keep_id) == {0} and hot.kept.sum() == 1
    assert out.kept.sum() == 51


def test_drop_exact_keeps_rows_and_columns(spark):
    df = frame(spark)
    out = content_dedup.drop_exact(df)
    assert out.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(rows) == len({norm(t) for _, t in TEXTS})
    assert Counter(rows)[(9, "x")] == 1 and (9, "y") in rows and (6, TEXTS[5][1]) in rows


def test_empty_tables(spark):
    df = frame(spark, [])
    assert content_dedup.exact_groups(df).count() == 0
    assert content_dedup.drop_exact(df).count() == 0
    assert mixing.mix_sizes(df).count() == 0
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == 0
    assert sharding.place(df).count() == 0


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target string")


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k * 7919 % 97), ["a", "b", "c", None][min(k % 10, 3)], 0, "") for k in range(2000)]
    out = mixing.mix_sizes(mixed(spark, rows)).toPandas()
    src = {r[0]: r[2] or "" for r in rows}
    out["src"] = out.doc_id.map(src)
    total = out["size"].sum()
    weights = {"a": 5, "b": 2, "c": 1, "": 5}
    sizes = out.groupby("src")["size"].sum()
    # Water-filling by bisection.
    lo, hi = 0.0, total
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * sizes[s], mid * weights[s]) for s in weights) < total else (lo, mid)
    for s, g in out.groupby("src"):
        assert g.target.iloc[0] == pytest.approx(min(3 * sizes[s], lo * weights[s]))
        assert g.taken.sum() == pytest.approx(g.target.iloc[0], rel=0.01)
        assert g.source_size.iloc[0] == sizes[s]
    assert (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    again = mixing.mix_sizes(mixed(spark, rows)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(out.doc_id, out.taken))
    emitted = Counter(r["doc_id"] for r in mixing.mix(mixed(spark, rows)).collect())
    assert all(emitted.get(i, 0) == n for i, n in zip(out.doc_id, out.copies))


def test_mixing_edge_cases(spark):
    none = mixing.mix_sizes(mixed(spark, [(1, None, "a", 0, ""), (2, "", None, 0, ""), (None, " ", "b", 0, "")])).collect()
    assert len(none) == 3 and all(r["size"] == 0 and r["taken"] == 0 and r["target"] == 0 for r in none)
    one = mixing.mix_sizes(mixed(spark, [(1, "x y z", "a", 0, "")])).first()
    assert (one["size"], one["target"], one["taken"]) == (3, 3.0, 3)
    twice = mixing.mix_sizes(mixed(spark, [(1, "x y", "a", 0, ""), (1, "x y", "a", 0, ""), (None, "u", None, 0, "")])).collect()
    assert len(twice) == 3


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, d).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        key = list(got.columns)
        assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True)), name


def test_lookup_table_is_balanced_and_stable():
    a = sharding.lookup_table([f"s{k}" for k in range(20)], 2003)
    counts = Counter(a)
    assert set(counts) == set(range(20)) and max(counts.values()) - min(counts.values()) <= 1
    b = sharding.lookup_table([f"s{k}" for k in range(19)], 2003)
    moved = sum(x != y for x, y in zip(a, b) if x != 19)
    assert moved < 0.15 * 2003
    # Each slot belongs to the shard whose turn reached it first: replay by brute force.
    for bad in ([], ["x", "x"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["x"], 8)


def test_place(spark):
    df = spark.createDataFrame([(k, "t", "old") for k in range(5000)] + [(None, "t", "old"), (7, "t", "old")], "doc_id bigint, text string, shard string")
    out = sharding.place(df, shards=8, slots=1009)
    rows = out.collect()
    assert len(rows) == 5002 and set(out.columns) == {"doc_id", "text", "shard", "slot"}
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(8)], 1009)
    assert all(table[r["slot"]] == r["shard"] for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) < 1.4 * min(counts.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_write_shards(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), shards=4, slots=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_shared_ids_are_drawn_one_by_one(spark):
    """A third of all rows without an id, and one row repeated often: the words still come near each target."""
    rows = [(None, f"w{k} " * 10, "a", k, "") for k in range(200)] + [(5, "same text here " * 4, "b", 0, "x")] * 300 + [(1000 + k, "v " * 6, "c", 0, "") for k in range(100)]
    df = mixed(spark, rows)
    out = mixing.mix_sizes(df).withColumn("source", F.when(F.col("doc_id").isNull(), "a").when(F.col("doc_id") == 5, "b").otherwise("c")).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.12 * g.target.iloc[0]
    got = Counter(r["source"] for r in mixing.mix(df.repartition(3)).collect())
    assert got == Counter({s: int(g.copies.sum()) for s, g in out.groupby("source")})


def test_chance_of_a_copy_is_the_fraction(spark):
    """Over seeds each document, whatever its size, is copied as often as its rate says, and one size tells nothing of another."""
    rows = [(0, "w " * 9000, "a", 0, "")] + [(k, "w " * 10, "a", 0, "") for k in range(1, 101)] + [(200 + k, "v " * (20 + k % 5 * 9), "b", 0, "") for k in range(40)]
    df, seeds = mixed(spark, rows).coalesce(1).cache(), 400
    # The plan by definition, as 400 Spark runs would take long; one seed in fifty is run.
    text = {r[0]: r[1] for r in rows}
    first = mixing.mix_sizes(df).toPandas()
    rate = {i: t / n for i, t, n in zip(first.doc_id, first.target, first.source_size)}
    times, drawn = Counter(), defaultdict(list)

    def unit(key):
        return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)

    for seed in range(seeds):
        got = {}
        for source in "ab":
            f = rate[0 if source == "a" else 200] % 1
            cells = defaultdict(list)
            for r in rows:
                if r[2] == source:
                    n, u = len(r[1].split()), unit(f"{seed}:{r[0]}:{hashlib.md5(text[r[0]].encode()).hexdigest()}:0")
                    b = n.bit_length()
                    cells[-(b * 4 + (n * 4 >> b - 1) - 4), u].append(r[0])
            before, begin = 0, unit(f"{seed}:start:{source}") / 2**32
            for _, held in sorted(cells.items()):
                for i in held:
                    got[i] = int(rate[i]) + ((before * f + begin) % 1 < f)
                before += len(held)
        times.update(got)
        for k in range(101):
            drawn[k].append(got[k])
        if seed % 50 == 42:
            assert {r["doc_id"]: r["copies"] for r in mixing.mix_sizes(df, seed=seed).collect()} == got
    for i, r in rate.items():
        assert abs(times[i] / seeds - r) <= 4 * math.sqrt(r % 1 * (1 - r % 1) / seeds) + 1e-9
    # What the long document gets decides nothing for any short one, though of all together the fraction has a copy, up to one.
    assert max(abs(statistics.correlation(drawn[0], drawn[k])) for k in range(1, 101)) < 0.25
    assert max(abs(sum(c) - 101 * rate[0]) for c in zip(*drawn.values())) < 1 + 1e-9


@pytest.mark.parametrize("listed", [4096, 10])
def test_large_plans_are_joined_by_a_shuffle(spark, monkeypatch, listed):
    monkeypatch.setattr(mixing, "LISTED", listed)
    rows = [(k, "w " * (k * 37 % 90), ["a", "b", None, ""][k % 4], 0, "") for k in range(400)]
    df = mixed(spark, rows)
    one = sorted((r["doc_id"], r["copies"]) for r in mixing.mix_sizes(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert one == sorted((r["doc_id"], r["copies"]) for r in mixing.mix_sizes(df).collect())
    emitted = Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert emitted == Counter({i: n for i, n in one if n})


def test_clashing_names_and_no_row_lost(spark):
    df = spark.createDataFrame([(1, "a b", "g", "h", "d", "r", 1, "k"), (2, "ab", "G", "H", "D", "R", 2, "K"), (None, "c", "g", "h", "d", "r", 3, "k")], "doc_id bigint, text string, _tm_g string, _tm_h string, _tm_digest string, _row string, _slot int, _shard string")
    for out in (content_dedup.drop_exact(df), simhash_bk.drop_near(df, width=1), sharding.place(df)):
        names = [c for c in out.columns if c in df.columns]
        rows = {tuple(r) for r in out.select(*names).collect()}
        assert names == df.columns and rows <= {tuple(r) for r in df.collect()}
    assert sharding.place(df).count() == 3 and content_dedup.drop_exact(df).count() == 2


def test_hot_texts_in_runs(spark, monkeypatch):
    monkeypatch.setattr(content_dedup, "HOT", 20)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "the  same" if k % 2 else "the same", "s", "k", 0, 1) for k in range(900)] + [(5000 + k, f"t{k}", "s", "k", 0, 1) for k in range(40)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = content_dedup.drop_exact(df).collect()
    assert len(out) == 41
    kept = [r for r in out if r["doc_id"] is None or r["doc_id"] < 5000]
    assert [(r["doc_id"], r["text"]) for r in kept] == [(5, "the  same")]


def test_place_by_brute_force(spark):
    """Shards take turns, each claiming the first free slot of its order: replayed slot by slot."""
    names, slots = [f"s{k}" for k in range(7)], 101
    free, owner = set(range(slots)), {}
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        first, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:16], "little") % (slots - 1) + 1
        orders.append([(first + j * skip) % slots for j in range(slots)])
    turn = 0
    while free:
        slot = next(s for s in orders[turn % 7] if s in free)
        free.remove(slot)
        owner[slot] = turn % 7
        turn += 1
    assert sharding.lookup_table(names, slots) == [owner[s] for s in range(slots)]
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, None, 2**60)], "doc_id bigint")
    keys = df.select("doc_id", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))), F.lit(slots)).alias("at")).collect()
    want = {(r["doc_id"], r["at"], owner[r["at"]]) for r in keys}
    assert {(r["doc_id"], r["slot"], r["shard"]) for r in sharding.place(df, shards=names, slots=slots).collect()} == want
