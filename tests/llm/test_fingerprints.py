import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemesh.llm import cws, simhash_bk
from tidemesh.llm.components import connected_components
from tidemesh.llm.simhash_bk import BKTree, shard_links, simhash


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(60):
        a = Counter(rng.integers(0, 30, 80).tolist())
        b = Counter(rng.integers(k // 4, 30 + k // 4, 60).tolist())
        rows += [(2 * k, " ".join(f"p{k}w{x}" for x in a.elements())), (2 * k + 1, " ".join(f"p{k}w{x}" for x in b.elements()))]
        want.append(jaccard(a, b))
    prints = dict((r["doc_id"], r["fingerprint"]) for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], samples=96).collect())
    parts = {i: [f[4 * k : 4 * k + 4] for k in range(96)] for i, f in prints.items()}
    got = [np.mean([x == y for x, y in zip(parts[2 * k], parts[2 * k + 1])]) for k in range(60)]
    assert abs(np.mean(np.array(got) - want)) < 0.012
    assert np.sqrt(np.mean((np.array(got) - want) ** 2)) < 0.07


DOCS = [(5, "b c d e f g"), (1, None), (2, "a a b\tc d"), (3, "日本語 テキスト x y"), (8, "w " * 20_000), (9, ""), (9, "zz zz"), (9, "zz zz"), (None, "last one")]


def test_edited_fingerprints_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in DOCS], "doc_id bigint, text string, fingerprint string, near_next double")
    out = cws.edited_fingerprints(df).collect()
    assert len(out) == len(DOCS)
    distinct = sorted({(i is None, i or 0, t or "") for i, t in DOCS}, key=lambda x: x[:2])
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    assert len(by[9, 5]) == 2
    # Where ids are unique the next document is certain.
    order = [x for x in distinct if x[1] != 9 or x[0]]
    ids = [(None if n else i, t) for n, i, t in order]
    for (i, t), (_, nxt) in zip(ids[:-1], ids[1:], strict=True):
        if i == 8 or (i, len(t)) not in by:
            continue
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert by[i, len(t)][0]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    last = by[None, 8][0]
    assert last["edited_sha256"] == hashlib.sha256(b"last").hexdigest()  # the first document is empty
    assert by[1, 0][0]["fingerprint"] == "0000" * cws.SAMPLES == by[9, 0][0]["fingerprint"]
    assert by[1, 0][0]["near_edited"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_edited_lone_and_empty(spark):
    schema = "doc_id bigint, text string"
    one = cws.edited_fingerprints(spark.createDataFrame([(1, "a b c")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"a ba ").hexdigest() and one["near_next"] == 1.0
    assert cws.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0


def test_native_plans(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = cws.fingerprints(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_simhash(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@pytest.mark.parametrize("text", ["", " \n", "one", "One TWO", "a b c", "É b c d e", "x y " * 50, "a b c d"])
def test_simhash_equals_definition(text):
    assert simhash(text.encode()) == brute_simhash(text)


def test_simhash_of_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{k * k % 911}" for k in range(5000))
    whole = simhash(text.encode())
    monkeypatch.setattr(simhash_bk, "_CHUNK", 97)
    assert simhash(text.encode()) == whole == brute_simhash(text)


def components_of(fps, radius=3):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 12))):
            out.append(base)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))).tolist():
                base ^= 1 << b
    return list(dict.fromkeys(out[:n]))


@pytest.mark.parametrize("seed", range(6))
def test_bk_tree_connects_what_brute_force_does(seed):
    fps = clustered(300, seed)
    tree, root = BKTree(), list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    n = 0
    for f in fps:
        for a, b in tree.add(f):
            assert (fps[a] ^ fps[b]).bit_count() <= 3
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            n += 1
    assert [find(k) for k in range(len(fps))] == components_of(fps) and n < len(fps)
    assert len(list(shard_links(fps, list(range(len(fps)))))) == n


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_by_shards_lose_none(spark, blocks):
    fps = clustered(400, 11) + [0, 1, (1 << 64) - 1, (1 << 64) - 8]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node bigint, _fp bigint")
    got = {r["node"]: r["component"] for r in connected_components(simhash_bk.links(nodes, blocks=blocks)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == components_of(fps)


def test_near_duplicates_against_brute_force(spark):
    base = " ".join(f"word{k}" for k in range(400))
    texts = [base, base + " tail", base.replace("word7 ", "other "), None, "", " ", "short one", "short one", "Short ONE", "a b c d", "z" * 100_000]
    rows = [(100 - k, t, "c") for k, t in enumerate(texts)] + [(100, base, "c")]
    out = simhash_bk.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")).collect()
    want_fp = {i: brute_simhash(t) for i, t, _ in rows}
    ids = sorted(want_fp)
    comp = components_of([want_fp[i] for i in ids])
    want = {i: ids[c] for i, c in zip(ids, comp, strict=True)}
    assert len(out) == len(rows)
    for r in out:
        assert r["fingerprint"] == f"{want_fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_drop_near(spark):
    rows = [(3, "a b c d e", "x"), (2, "a b c d e", "x"), (2, "a b c d e", "x"), (7, "something else now", "x"), (8, None, "x"), (9, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _fp string")
    out = simhash_bk.drop_near(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(2, "a b c d e"), (7, "something else now"), (8, None)]
    assert simhash_bk.drop_near(df.limit(0)).count() == 0
    assert simhash_bk.near_duplicates(df.limit(0)).count() == 0


def test_drop_near_without_ids_and_with_repeated_ids(spark):
    far = [f"t{k} alone {k * k} words here" for k in range(4)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (5, far[2]), (5, far[3]), (2, far[3]), (None, far[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"]) for r in simhash_bk.drop_near(df).collect()]
    assert sorted(got, key=str) == sorted([(None, far[0]), (None, far[1]), (5, far[2]), (2, far[3])], key=str)
    of = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_bk.near_duplicates(df).collect()}
    prints = [f"{brute_simhash(t):016x}" for t in far]
    assert of == {(None, prints[0]): None, (None, prints[1]): None, (5, prints[2]): 5, (5, prints[3]): 2, (2, prints[3]): 2, (None, prints[3]): 2}


def test_components_of_long_chain_and_star(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    edges = spark.createDataFrame(chain + star + [(5, 5)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(301)) and all(got[1000 + k] == 1000 for k in range(400))
    assert len(got) == 301 + 400


def test_hot_shards_by_broadcast_trees(spark, monkeypatch):
    """All fingerprints share a block, so one shard holds them; its pieces' trees are broadcast and no link is lost."""
    fps = list(dict.fromkeys((f & ((1 << 48) - 1)) | (0xABCD << 48) for f in clustered(400, 3)))
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)], "node bigint, _fp bigint")
    monkeypatch.setattr(simhash_bk, "HOT_SHARD", 100)
    monkeypatch.setattr(simhash_bk, "ROUND", 150)
    got = {r["node"]: r["component"] for r in connected_components(simhash_bk.links(nodes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == components_of(fps)


def test_ids_that_are_text(spark):
    df = spark.createDataFrame([("b", "x y z w"), ("a", "x y z w"), (None, "q"), ("c", None)], "doc_id string, text string")
    out = simhash_bk.near_duplicates(df)
    assert dict(out.dtypes)["doc_id"] == "string" == dict(out.dtypes)["component_id"]
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {("a", "a"), ("b", "a"), (None, None), ("c", "c")}
    assert {r["doc_id"] for r in simhash_bk.drop_near(df).collect()} == {"a", None, "c"}


def test_a_third_of_all_rows_repeats_one(spark):
    rows = [(None, "same words here")] * 60 + [(7, "same words here")] * 60 + [(k, f"other {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    out = simhash_bk.near_duplicates(df)
    assert out.count() == 180 and out.filter("component_id = 7").count() == 121  # and the document of that id
    prints = cws.edited_fingerprints(df).collect()
    assert len(prints) == 180 and sum(r["doc_id"] is None for r in prints) == 60


def test_signature_samples_by_brute_force(spark):
    """The sample's law: t = floor(ln S / r + b), ln y = r (t - b), ln a = ln c - ln y - r, least a wins, over the operator's own draws."""
    terms = spark.createDataFrame([(g, int(h), int(w)) for g in range(4) for h, w in zip((11, -5, 2**40, 77, 9), (1, 2, 5, 1 + g, 30))], "g bigint, _term bigint, w bigint")
    got = {r["g"]: r["_fp_w"] for r in cws.signatures(terms, ["g"], ["w"], 8).collect()}
    drawn = terms.select("g", "_term", "w", F.lit(0).alias("_part"), *[c for k in range(8) for c in cws._draws(k, "0")]).collect()
    for g in range(4):
        for k in range(8):
            best = None
            for r in drawn:
                if r["g"] == g:
                    t = np.floor(np.log(r["w"]) / r[f"r{k}"] + r[f"b{k}"])
                    a = r[f"c{k}"] - r[f"r{k}"] * (t - r[f"b{k}"]) - r[f"r{k}"]
                    best = min(best or (9e9, 0), (a, (int(r[f"h{k}"]) + int(t) * 40503) & 65535))
            assert got[g][k] == best[1]


def test_likeness_error_at_the_production_setting(spark):
    """Root mean square error against exact generalised Jaccard, over the sample table's documents and their edited texts."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    ids = sorted(texts)
    off = []
    out = {r["doc_id"]: r for r in cws.edited_fingerprints(df).collect()}
    for i, n in zip(ids, ids[1:] + ids[:1]):
        h = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - h] + texts[n][:h]
        off.append(out[i]["near_edited"] - jaccard(Counter(words(texts[i])), Counter(words(edited))))
    assert np.sqrt(np.mean(np.square(off))) < 0.07 and abs(np.mean(off)) < 0.01
