import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemesh.llm import bt_quality, chat_hmm, kn_toxicity, packing, queries, warc_merkle
from tidemesh.llm.packing import CAPACITY, Packer, cuts, padding

D = "/root/testdata/sf0.01"


def held_out(out, label):
    labels = duckdb.sql(f"select doc_id, {label} as y from '{D}/labels.parquet'").df()
    m = out.merge(labels, on="doc_id")
    return m[m.held_out]


def test_quality_on_held_out_rows(spark):
    out = queries.op1_bradley_terry_quality(spark, D).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out.doc_id, out.held_out))
    m = held_out(out, "quality")
    assert (m.predicted == m.y).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    out = queries.op10_kneser_ney_toxicity(spark, D).toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    m = held_out(out, "toxic")
    assert (m.predicted == m.y).mean() > 0.9


def test_ranking_recovers_preferences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x @ [2.0, -1.0, 0, 0] > 0.3).astype(int)
    model = bt_quality.rank(x, y)
    s = model.scores(x)
    assert ((s >= 0.7) == (y == 1)).mean() > 0.97
    # The loss' gradient on feature differences vanishes at the fit: a plain descent finds the same direction.
    w = model.weights / np.linalg.norm(model.weights)
    assert abs(w[0]) > abs(w[1]) > 5 * max(abs(w[2]), abs(w[3]))


DOCS = "doc_id bigint, text string, score double, held_out string"


def test_classifiers_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.0, ""), (2, "", 0.0, ""), (None, "x " * 50_000, 0.0, ""), (4, "a", 0.0, ""), (4, "a", 0.0, "")], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    a = bt_quality.classify(docs, bt_quality.fit(docs, none)).toPandas()
    assert len(a) == 5 and set(a.predicted) == {1} and list(a.columns) == ["doc_id", "held_out", "score", "predicted"]
    b = kn_toxicity.classify(docs, kn_toxicity.fit(docs, none)).toPandas()
    assert len(b) == 5 and set(b.predicted) == {0} and not b.held_out[b.doc_id.isna()].any()
    bad = spark.createDataFrame([(4, None, None), (None, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert bt_quality.classify(docs, bt_quality.fit(docs, bad)).count() == 5
    model = bt_quality.rank(np.array([bt_quality.features(t) for t in (b"a b c", b"!! !! !!") * 20]), np.array([1, 0] * 20))
    empty = docs.filter("doc_id < 0")
    assert bt_quality.classify(empty, model).count() == 0 and bt_quality.keep_good(docs, model).columns == docs.columns
    assert bt_quality.classify(docs, model).filter("score is null").count() == 0


def top_of(texts):
    out = {}
    for t in texts:
        for w in kn_toxicity.words_of(t):
            for g in kn_toxicity.grams(w):
                out[g] = out.get(g, 0) + 1
    return out


def test_kneser_ney_probabilities_sum_to_one():
    top = {0: top_of(["the cat sat", "on the mat"]), 1: top_of(["the bad idiot", "idiots sat"])}
    model = kn_toxicity.Model(top)
    assert model.word("idiot") > 1 > model.word("cat")
    assert model.word("idiotic") > 0.5  # not seen, but its parts are
    assert abs(model.word("qzxw")) < 0.1  # nothing of it was seen: only its contexts' spreads differ
    # Over all letters that follow a context, each class' probabilities sum to one; check through the ratio's definition.
    letters = {g[-1] for c in top.values() for g in c}
    ctx = "^t"
    p = {}
    for c in (0, 1):
        n = sum(v for g, v in top[c].items() if g[:-1] == ctx)
        kinds = sum(1 for g in top[c] if g[:-1] == ctx)
        assert n >= 0 and kinds <= len(letters)
        p[c] = (sum(max(v - kn_toxicity.DISCOUNT, 0) for g, v in top[c].items() if g[:-1] == ctx) / n if n else 0) + (kn_toxicity.DISCOUNT * kinds / n if n else 1)
        assert p[c] == pytest.approx(1.0)


def test_cuts_fill_classes():
    for rest in [1, 2, 63, 64, 65, 100, 1365, 1366, 2048, 2049, 3000, 4095]:
        parts = list(cuts(rest))
        assert sum(n for _, n in parts) == rest
        for m, n in parts:
            assert n <= CAPACITY // m and n * 64 >= (CAPACITY // m) * 63 - 64


def test_packer_round_trip_and_padding():
    rng = np.random.default_rng(5)
    docs = {k: np.arange(int(n), dtype="<u4") + 7 * k for k, n in enumerate(np.r_[1, 4096, 4097, 20_000, rng.lognormal(5, 1.5, 500).astype(int) + 1])}
    packer, closed = Packer(), []
    for k, ids in docs.items():
        closed += packer.add(k, ids.tobytes())
    full = len(closed)
    closed += packer.rest()
    assert full and not packer.open
    seen = {k: {} for k in docs}
    pad = total = 0
    for pieces in closed:
        used = sum(len(p[2]) // 4 for p in pieces)
        assert 0 < used <= CAPACITY
        pad, total = pad + padding(used), total + used
        for doc, start, ids, n in pieces:
            assert n == len(docs[doc])
            seen[doc][start] = ids
    for k, ids in docs.items():
        assert b"".join(seen[k][s] for s in sorted(seen[k])) == ids.tobytes()
    assert pad / total < 0.02


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello, world!  it's 2024", "a\x1eb \x1e c", "<|endoftext|> x<|endoftext|>y", "é́ \u0085nbsp x \x1c y", "don't " * 9000, "same", "same"]
    df = spark.createDataFrame([(None if k == 7 else k, t, 5) for k, t in enumerate(texts)], "doc_id bigint, text string, length int")
    out = packing.pack(df, queries.tokenizer_path()).toPandas()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for k, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        g = (out[out.doc_id.isna()] if k == 7 else out[out.doc_id == k]).sort_values("start")
        assert b"".join(g.ids) == ids.tobytes() and set(g.doc_tokens) == {len(ids)}
        assert (g.start == np.r_[0, np.cumsum(g.length)[:-1]]).all()
    seq = out.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    assert packing.pack(df.limit(0), queries.tokenizer_path()).count() == 0


def test_word_cache_starts_anew(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    js = open(queries.tokenizer_path(), encoding="utf-8").read()
    words = packing.WordIds(js)
    text = " ".join(f"word{k} x{k % 7}" for k in range(200))
    want = np.array(Tokenizer.from_str(js).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert (words.ids([text.encode(), b"", text.encode()])) == [want, b"", want]


# Chat.


def model_of(seed=3):
    rng = np.random.default_rng(seed)
    k = chat_hmm.STATES
    return chat_hmm.Model.of_counts(rng.integers(1, 9, k), rng.integers(1, 9, (k, k)), rng.integers(0, 9, (k, chat_hmm.SYMBOLS)))


def test_blockwise_viterbi_equals_one_pass(spark):
    model = model_of()
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for conv in range(8):
        n = int(rng.integers(1, 60))
        sym = rng.integers(0, chat_hmm.SYMBOLS, n)
        # Brute force by the usual recursion over the whole sequence.
        score = model.start + model.emit[:, sym[0]]
        back = []
        for x in sym[1:]:
            ways = score[:, None] + model.step
            back.append(ways.argmax(0))
            score = ways.max(0) + model.emit[:, x]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        want[str(conv)] = path[::-1]
        rows += [(str(conv), k // 7, k, int(x)) for k, x in enumerate(sym)]
    seen = spark.createDataFrame(rows, "_conv string, _block bigint, _pos bigint, _symbol int")
    got = chat_hmm.decode(seen, model).toPandas().sort_values(["_conv", "_pos"])
    for conv, g in got.groupby("_conv"):
        assert g._state.tolist() == want[conv]


def test_roles_are_recovered_on_held_out_conversations(spark):
    conv = spark.read.parquet(f"{D}/conversations.parquet")
    out = chat_hmm.format_conversations(conv).toPandas()
    truth = conv.toPandas()
    m = truth.merge(out, left_on=["conv_id", "turn"], right_on=["conv_id", "first_turn"], how="left")
    m = m[[zlib.crc32(str(i).encode()) % chat_hmm.FOLDS == chat_hmm.HELD_OUT for i in m.conv_id]]
    assert len(m) > 50 and (m.role_x == m.role_y).mean() > 0.95
    assert out.rendered.str.startswith("<|").all() and out.rendered.str.endswith("<|end|>\n").all()
    assert (m.text_x.str.split().str.join(" ") == m.text_y.str.split().str.join(" ")).mean() > 0.95


def test_chat_edge_cases(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, rendered int"
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", None, 0), (1, 2, None, "", 0), (None, None, "user", "lost <|user|> mark", 0), (2, 0, "user", "twice", 0), (2, 0, "user", "twice", 0), (3, 0, "system", "line\n" * 5000, 0)]
    out = chat_hmm.format_conversations(spark.createDataFrame(rows, schema)).toPandas()
    assert out[out.conv_id.isna()].shape[0] == 1 and "<user>" in out[out.conv_id.isna()].rendered.iloc[0]
    assert out[out.conv_id == 1].sort_values("first_turn").text.tolist()[0] == "hi"
    assert chat_hmm.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_plain_transcripts(spark):
    conv = spark.read.parquet(f"{D}/conversations.parquet")
    model = chat_hmm.fit(conv)
    text = "User: How are you?\n\nAssistant: Fine.\nAnd you?\n\nHuman: Well\n" + "Assistant: ok\n\nUser: next\n\n" * 400
    out = chat_hmm.format_transcripts(spark.createDataFrame([("a", text), ("b", None)], "k string, t string"), model, "k", "t").toPandas().sort_values("first_line")
    assert out.role.tolist()[:3] == ["user", "assistant", "user"] and out.text.tolist()[:3] == ["How are you?", "Fine.\nAnd you?", "Well"]
    assert len(out) == 803


# WARC.


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, offset string")


def test_records_parse_back(spark):
    rec = warc_merkle.records(pages(spark, [(1, "http://a/\nb", "<p>é</p>"), (2, None, None)])).toPandas()
    head, body = bytes(rec.record[0]).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1") and b"Content-Length: 9" in head and body == "<p>é</p>".encode() + b"\r\n\r\n"
    assert b"http://a/ b" in head


def test_audit_finds_damage_and_only_that(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(700)] + [(None, "u", "h"), (3, "again", "h"), (3, "again", "h")]
    df = pages(spark, rows)
    damaged = {5, 77, 699}
    rows2 = [(i, u, (h + "!") if i in damaged else h) for i, u, h in rows if i != 400]
    out = warc_merkle.fixity(df, pages(spark, rows2)).toPandas()
    assert len(out) == len(rows)
    assert set(out[~out.intact].page_id) == damaged | {400} and (~out.intact).sum() == 4
    assert out[out.page_id == 400].replica_sha256.isna().all()
    for f, g in out.sort_values("record_index").groupby("warc_file"):
        assert (g.record_index == range(len(g))).all() and (g.offset == np.r_[0, np.cumsum(g.length)[:-1]]).all()
    rec = warc_merkle.records(df).toPandas()
    want = {hashlib.sha256(bytes(r)).hexdigest() for r in rec.record}
    assert set(out.record_sha256) == want
    assert warc_merkle.fixity(df, df).filter("not intact").count() == 0
    assert warc_merkle.fixity(df.limit(0), df.limit(0)).count() == 0


def test_tree_root_against_brute_force(spark):
    leaves = warc_merkle.files(warc_merkle.records(pages(spark, [(k, "u", str(k)) for k in range(300)])), count=1)
    nodes = warc_merkle.tree(leaves).toPandas()
    layer = [bytes(h) for h in nodes[nodes._level == 0].sort_values("_at")._hash]
    level = 0
    while len(layer) > 1:
        layer = [hashlib.sha256(b"".join(layer[k : k + 16])).digest() for k in range(0, len(layer), 16)]
        level += 1
        assert [bytes(h) for h in nodes[nodes._level == level].sort_values("_at")._hash] == layer
    top = nodes[nodes._level == level]
    assert len(top) == 1 and top._offset.iloc[0] == 0 and top._length.iloc[0] == nodes[nodes._level == 0]._length.sum()


def test_whole_ranges_missing(spark):
    rows = [(k, "u", str(k)) for k in range(100)]
    out = warc_merkle.fixity(pages(spark, rows), pages(spark, rows[:50])).toPandas()
    assert set(out[~out.intact].page_id) == set(range(50, 100)) and isinstance(out, pd.DataFrame)


def test_brute_force_ranking():
    """Newton's weights are those of a plain descent on the same pairs, and the threshold is the best of all quantiles."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=80) > 0).astype(int)
    model = bt_quality.rank(x, y, pairs=500)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    draw = np.random.default_rng(42)
    i, j = draw.choice(np.flatnonzero(y == 1), 500), draw.choice(np.flatnonzero(y == 0), 500)
    sign = draw.integers(0, 2, 500) * 2 - 1
    d, t = (z[i] - z[j]) * sign[:, None], (sign > 0).astype(float)
    w = np.zeros(3)
    for _ in range(20_000):
        w -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ w)) - t) / 500 + 1e-3 * w)
    assert np.allclose(w, model.weights, atol=1e-5)
    s = z @ model.weights

    def right(level):
        return (s[y == 1] >= level).mean() + (s[y == 0] < level).mean()

    assert right(model.threshold) >= max(right(q) for q in np.quantile(s, np.linspace(0, 1, 2001))) - 1e-12
    assert ((model.scores(x) >= bt_quality.CUT) == (s >= model.threshold)).all()


def brute_kneser_ney(top, order, discount):
    """P_c(x | ctx) written out from the definition, by recursion."""
    letters = {g for t in top.values() for g in t}
    levels = {order: {g for g in letters if len(g) == order}}
    types = Counter()
    for length in range(order, 1, -1):
        here = {g for g in letters if len(g) == length} | levels.get(length, set())
        for g in here:
            types[g[1:]] += 1
            levels.setdefault(length - 1, set()).add(g[1:])
    alphabet = len({g for g in types if len(g) == 1}) + 1

    def shared(g):
        if not g:
            return 1 / alphabet
        same = {h: n for h, n in types.items() if len(h) == len(g) and h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return shared(g[1:])
        return max(types.get(g, 0) - discount, 0) / total + discount * len(same) / total * shared(g[1:])

    def of(c, g):
        same = {h: n for h, n in top[c].items() if len(h) == len(g) and h[:-1] == g[:-1]}
        total = sum(same.values())
        low = shared(g[1:])
        return low if not total else max(top[c].get(g, 0) - discount, 0) / total + discount * len(same) / total * low

    return of


def test_kneser_ney_against_its_definition():
    top = {0: Counter(top_of(["the cat sat", "on the mat"])), 1: Counter(top_of(["the bad idiot", "idiots sat"]))}
    model = kn_toxicity.Model(top)
    of = brute_kneser_ney(top, kn_toxicity.ORDER, kn_toxicity.DISCOUNT)
    for word in ("the", "idiot", "idiotic", "mats", "qzx", "a"):
        want = [sum(np.log(of(c, g)) for g in kn_toxicity.grams(word)) for c in (0, 1)]
        plain, ratio = model.both(word)
        assert plain == pytest.approx(want[0]) and plain + ratio == pytest.approx(want[1])


def test_counts_cover_all_labelled_texts(spark):
    """Against plain counting: every labelled text counts, whatever the sample; other texts, null ids and held-out rows don't."""
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["old", "dump", "Lake", "the", "qzx"], size=rng.integers(0, 9))) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (7, "one id twice"), (None, "no id"), (99, None)], "doc_id bigint, text string")
    marks = {i: int(i % 2) for i in range(0, 60, 3)} | {99: 1}
    labels = spark.createDataFrame([*marks.items(), (6, 1), (None, 1), (3, None), (4, 7), (500, 0)], "doc_id bigint, toxic int")
    allowed = F.col("_id") % 5 != 0
    rows = kn_toxicity.labelled_texts(docs, labels, "toxic", allowed, "doc_id", "text")
    want = sorted((i, marks[i], texts.get(i, "")) for i in marks if i % 5)
    assert sorted(map(tuple, rows.select("_id", "_label", "_text").collect())) == want
    counts = kn_toxicity.counted(rows.withColumn("fold", F.col("_id").cast("int") % 2))
    grams = kn_toxicity.letter_grams(counts)
    for y in (0, 1):
        got = {r["gram"]: r[f"n0{y}"] + r[f"n1{y}"] for r in grams.collect() if r[f"n0{y}"] + r[f"n1{y}"]}
        assert got == top_of([t for _, label, t in want if label == y])
    words = [kn_toxicity.words_of(t) for _, label, t in want if label]
    pairs = Counter(" ".join(p) for w in words for p in zip(w, w[1:]))
    assert {r["gram"]: r["n01"] + r["n11"] for r in counts.filter(F.col("gram").rlike(". .")).collect()} == pairs
    top = [top_of([t for _, label, t in want if label == y]) for y in (0, 1)]
    whole, core = kn_toxicity.Model(dict(enumerate(top))), kn_toxicity.core_of(grams)
    for part in ("ol", "^", "um"):
        some = kn_toxicity.Model({y: {g: n for g, n in top[y].items() if g[-3:-1] == part} for y in (0, 1)}, core=core)
        for g in {g for w in ("old", "dump", "lake", "zold", "qum") for g in kn_toxicity.grams(w) if g[-3:-1] == part}:
            assert some.letter(g) == pytest.approx(whole.letter(g))


def test_parts_say_what_one_model_says(spark, monkeypatch):
    """With parts of few n-grams and pairs every text scores as with one model of all: nothing is cut."""
    rng = np.random.default_rng(5)
    common = ["the", "old", "lake", "house", "été", "jump", "in", "water", "x1", "go"]
    texts = [(k, " ".join([*rng.choice(common, size=rng.integers(0, 40)), *(["you", "utter", "fool"] if k % 3 == 0 else ["you", "dear"]) * int(rng.integers(1, 3))])) for k in range(240)]
    docs = spark.createDataFrame([*texts, (None, None), (1000, "")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in texts], "doc_id bigint, toxic int")

    def scores():
        model = kn_toxicity.fit(docs, labels)
        rows = kn_toxicity.classify(docs, model).collect()
        return model, {r["doc_id"]: (r["score"], r["toxic_loglik"], r["ordinary_loglik"]) for r in rows}

    one, want = scores()
    assert isinstance(one.model, kn_toxicity.Model) and one.model.behind
    monkeypatch.setattr(kn_toxicity, "MODEL_GRAMS", 25)
    monkeypatch.setattr(kn_toxicity, "MODEL_PAIRS", 1)
    monkeypatch.setattr(kn_toxicity, "FILL", 2000)
    monkeypatch.setattr(kn_toxicity, "REMEMBERED", 15)
    many, got = scores()
    assert len(many.model.models) > 2 and len(many.model.pairs) > 1
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7)


def test_letters_in_arrays_say_what_the_model_says():
    """Seen and unseen n-grams, words and pairs, of letters of one to four bytes: many at once as one by one."""
    top = {0: top_of(["the cat sat", "on the mat", "été 東京都 𐐨𐐩𐐪"]), 1: top_of(["the bad idiot", "idiots sat 東京"])}
    for model in (kn_toxicity.Model(top, {("the", "bad"): (0, 4), ("bad", "idiot"): (1, 5)}, {"the": (9, 9), "bad": (2, 6)}), kn_toxicity.Model({0: {}, 1: {}})):
        words = ["the", "idiot", "idiotic", "mats", "qzx", "a", "été", "東京都", "東", "𐐨𐐩", "𐐪𐐪𐐪𐐪𐐪𐐪𐐪𐐪"]
        packed, _, word = kn_toxicity.packed_grams(words)
        split = [g for w in words for g in kn_toxicity.grams(w)]
        assert len(split) == len(word) and packed[2].tolist() == [len(g) for g in split]
        for got, want in zip(zip(*kn_toxicity.Letters(model)(*packed)), map(model.letter, split), strict=True):
            assert got == pytest.approx(want, abs=1e-12)
        ids = kn_toxicity.Ids()
        texts = [t.split() for t in ("the bad idiot sat", "", "bad", "the", "bad idiot the bad the")]
        flat, sizes = ids.of(texts)
        plain, ratio = np.array([model.both(w) for w in ids]).T
        at, p, r = (tails := kn_toxicity.Tails(model.behind))(tails.known(ids), flat, (np.cumsum(sizes) - sizes)[sizes > 0], plain, ratio)
        want, place = {}, 0
        for t in texts:
            for n, w in enumerate(t):
                if n and t[n - 1] in model.behind:
                    want[place] = model.after(t[n - 1], w, *model.both(w))
                place += 1
        assert dict(zip(at.tolist(), zip(p.tolist(), r.tolist()))) == {k: pytest.approx(v) for k, v in want.items()}


def test_labels_reach_texts_by_bitmaps(spark, monkeypatch):
    """Where ids share bits, as with bitmaps of 16 bits, the labels decide; else no text is shuffled."""
    docs = spark.createDataFrame([*((k, f"text {k}") for k in range(90)), (7, "again"), (None, "no id")], "doc_id bigint, text string")
    labels = spark.createDataFrame([*((k, k % 2) for k in range(0, 120, 3)), (6, 1), (None, 1)], "doc_id bigint, toxic int")
    want = sorted((k, k % 2, f"text {k}") for k in range(0, 90, 3))
    for bits in (8, 32768):
        monkeypatch.setattr(kn_toxicity, "BITMAP_ROWS", 2)
        monkeypatch.setattr(kn_toxicity, "_BITS", bits)
        rows = kn_toxicity.labelled_texts(docs, labels, "toxic", F.lit(True), "doc_id", "text")
        assert sorted(map(tuple, rows.select("_id", "_label", "_text").collect())) == want
    sure = rows._jdf.queryExecution().optimizedPlan().children().head().toString()
    joins = [line for line in sure.splitlines() if "Join" in line]
    assert len(joins) == 1 and "_row" in joins[0] and "broadcast" in joins[0]


def test_pairs_are_counted_in_a_fixed_number_of_readings(spark, monkeypatch):
    """Against plain counting; however many pairs are frequent, the texts are read ROUNDS times."""
    rng = np.random.default_rng(8)
    rows = [(int(k % 3 == 0), int(y), " ".join(rng.choice([f"w{n}" for n in range(12)] + ["you", "fool"] * int(1 + 4 * y), size=30))) for k in range(120) for y in [k % 4 == 0]]
    labelled = spark.createDataFrame(rows, "fold int, _label int, _text string").repartition(3)
    counts = kn_toxicity.counted(labelled).localCheckpoint()
    readings, summed = [], kn_toxicity._summed
    monkeypatch.setattr(kn_toxicity, "_summed", lambda r: readings.append(1) or summed(r))
    monkeypatch.setattr(kn_toxicity, "MODEL_PAIRS", 1)
    found = kn_toxicity.telling_pairs(labelled, counts)
    assert len(readings) <= kn_toxicity.ROUNDS and len(found) > 1
    pairs, heads, total = Counter(), Counter(), Counter()
    for fold, y, text in rows:
        words = text.split()
        pairs.update((p, fold, y) for p in map(" ".join, zip(words, words[1:])))
        heads.update((w + " ", fold, y) for w in words[:-1])
        total[y] += len(words) - 1
    of = lambda c, g, y: c[g, 0, y] + c[g, 1, y]
    kept = {p for p, _, _ in pairs if of(pairs, p, 1) >= kn_toxicity.PAIR_COUNT and of(pairs, p, 1) * total[0] >= (of(pairs, p, 0) + 1) * kn_toxicity.PAIR_RATE * total[1]}
    assert kept
    for n, (c, names) in enumerate([(pairs, kept), (heads, {p.split(" ")[0] + " " for p in kept})]):
        got = [r for part in found for r in part[n].to_pylist()]
        assert {r.pop("gram"): r for r in got} == {g: {f"n{f}{y}": c[g, f, y] for f in (0, 1) for y in (0, 1)} for g in names} and len(got) == len(names)


def test_texts_that_tell_nothing_are_ordinary(spark):
    docs = spark.createDataFrame([(k, "..") for k in range(30)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, toxic int")
    out = kn_toxicity.classify(docs, kn_toxicity.fit(docs, labels)).collect()
    assert len(out) == 30 and {(r["score"], r["predicted"]) for r in out} == {(0.0, 0)}


def test_expressions_of_several_words():
    """Words that are ordinary alone and toxic together: the pair's own counts tell, and a word's chances behind another sum to one."""
    top = {0: top_of(["go to the old dump", "jump in the lake"] * 9), 1: top_of(["go to the old dump", "jump in the lake"] * 9)}
    model = kn_toxicity.Model(top, {("old", "dump"): (0, 6)}, {"old": (9, 9)})
    a, b, tails = model.behind["old"]
    assert a + sum(x for x, _ in tails.values()) == pytest.approx(1) and b + sum(y for _, y in tails.values()) == pytest.approx(1)
    c = kn_toxicity.Classifier(model)
    ordinary, toxic = c.likelihoods("the old dump")
    assert toxic > ordinary and c.ratio("the dump old") == pytest.approx(0, abs=1e-9)
    # Behind "old" the toxic model has what (6 - D) / 9 leaves for any other word, the ordinary one all of it.
    left = 1 - (6 - kn_toxicity.DISCOUNT) / 9
    assert c.ratio("dump old the") == pytest.approx(np.log1p(kn_toxicity.SHARE * (left - 1)) / 3)
    assert c.likelihoods("") == (0.0, 0.0)


def test_sample_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(2000)] + [(2, "b"), (3, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    rows = bt_quality.labelled_sample(docs, labels, "quality", F.lit(True), "doc_id", "text", 10).collect()
    assert sorted(r["_id"] for r in rows) == [1, 2, 3]


def test_no_name_is_lost_by_the_quality_filter(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.1, "r", 7)], "doc_id bigint, text string, _tm_score double, _row string, _score int")
    assert [tuple(r) for r in bt_quality.keep_good(docs, 1.0).collect()] == [(1, "a b c", 0.1, "r", 7)]


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_paragraphs_code_and_other_roles_stay(spark):
    rows = []
    for k in range(40):
        rows += [(k, 0, "user", "para one\n\n  code\n\npara two"), (k, 1, "tool", "result 5"), (k, 2, "assistant", "Answer: 42\nis it\n\n\nyes"), (k, 3, "narrator", "x y")]
    out = chat_hmm.format_conversations(spark.createDataFrame(rows, CHAT)).toPandas()
    truth = {(c, t): (r if r in chat_hmm.ROLES else "user", x) for c, t, r, x in rows}
    same = [truth[r.conv_id, r.first_turn] == (r.role, r.text) for r in out.itertuples()]
    assert np.mean(same) > 0.9
    first = out[out.first_turn == 0]
    assert len(first) == 40 and (first.text.str.startswith("para one\n\n  code\n\npara two")).all()
    assert set(out[out.first_turn == 1].role) == {"tool"} and set(out[out.first_turn == 1].text) == {"result 5"}


def test_any_turn_number_and_rows_without_ids(spark):
    rows = [(k, t, r, f"words {k}") for k in range(30) for t, r in ((-7, "user"), (2**40, "assistant"))] + [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (None, None, "assistant", "other")]
    out = chat_hmm.format_conversations(spark.createDataFrame(rows, CHAT)).toPandas()
    assert (out.first_turn == -7).sum() == 30 and out.first_turn.max() == 2**40
    alone = out[out.conv_id.isna()]
    assert sorted(zip(alone.role, alone.text)) == [("assistant", "other"), ("user", "alone"), ("user", "alone")]


def test_gaps_across_blocks(spark):
    text = "User: a\n\n\nb\n" + "\n" * 1100 + "Assistant: ok\n" + "line\n" * 600 + "end"
    conv = spark.createDataFrame([(k, t, r, "one\n\ntwo" + "\nmore" * 30) for k in range(40) for t, r in ((0, "user"), (1, "assistant"))], CHAT)
    got = chat_hmm.format_transcripts(spark.createDataFrame([("t", text)], "k string, t string"), chat_hmm.fit(conv), "k", "t").toPandas().sort_values("first_line")
    assert got.text.tolist() == ["a\n\n\nb", "ok\n" + "line\n" * 600 + "end"] and got.first_line.tolist() == [0, 1104]


def test_written_files_have_the_offsets_of_the_plan(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>\r\n\r\n" * (k % 5)) for k in range(50)] + [(None, None, None)]
    df = pages(spark, rows)
    rec = warc_merkle.records(df)
    warc_merkle.write_warc(rec, str(tmp_path / "a"), 3)
    got = warc_merkle.read_warc(spark, str(tmp_path / "a")).toPandas().sort_values(["_file", "_at"])
    want = warc_merkle.files(rec, 3).toPandas().sort_values(["_file", "_at"])
    for c in ("_file", "_at", "_offset", "_length"):
        assert got[c].tolist() == want[c].tolist()
    assert [bytes(x) for x in got._hash] == [bytes(x) for x in want._hash]
    assert warc_merkle.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 0
    file = next((tmp_path / "a" / "_file=1").glob("part-*"))
    raw = bytearray(file.read_bytes())
    raw[-6] ^= 1  # one byte within the last record
    other = tmp_path / "b" / "_file=1"
    other.mkdir(parents=True)
    (other / "part-0.txt").write_bytes(raw)
    for n in (0, 2):
        (tmp_path / "b" / f"_file={n}").mkdir()
        (tmp_path / "b" / f"_file={n}" / "part-0.txt").write_bytes(next((tmp_path / "a" / f"_file={n}").glob("part-*")).read_bytes())
    bad = warc_merkle.audit_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    last = want[want._file == 1].iloc[-1]
    assert [(r["_file"], r["_at"], r["_offset"]) for r in bad] == [(1, last._at, last._offset)]


def test_shifts_show_and_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (1, "u", "c"), (2, "u", "x"), (None, "u", "q")]
    other = [(1, "u", "a"), (1, "u", "B"), (1, "u", "c"), (9, "z", "new"), (None, "u", "q")]
    out = warc_merkle.fixity(pages(spark, rows), pages(spark, other)).toPandas()
    ours = out[out.record_sha256.notna()]
    assert len(ours) == 5 and ours.intact.sum() == 3 and len(out) == 6
    assert out[out.record_sha256.isna()].page_id.tolist() == [9] and out[out.page_id == 2].replica_sha256.isna().all()
    # A record that grew moves those behind it: their bytes are intact, the trees of both differ there.
    rows = [(k, "u", "same") for k in range(64)]
    grown = [(k, "u", "same!" if k == 10 else "same") for k in range(64)]
    a, b = [warc_merkle.tree(warc_merkle.files(warc_merkle.records(pages(spark, x)), 1)) for x in (rows, grown)]
    assert warc_merkle.audit(a, b).count() == 54
    out = warc_merkle.fixity(pages(spark, rows), pages(spark, grown)).toPandas()
    assert out[~out.intact].page_id.tolist() == [10] and (out.replica_offset - out.offset)[out.page_id > 10].eq(1).all()


def test_carriage_returns_stay(spark):
    texts = ["one\r\ntwo", "ends so\r", "a question?\r\nand a line", "x\r\n\r\ny", "no\rbreak", "plain\nlines"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", texts[(c + t) % len(texts)]) for c in range(12) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.first_turn): (r.role, r.text) for r in chat_hmm.format_conversations(df).collect()}
    assert got == {(c, t): (role, text.replace("\r\n\r\n", "\r\n\n")) for c, t, role, text in rows}
    model = chat_hmm.fit(df)
    plain = spark.createDataFrame([("t", "User: one\r\ntwo\r\nAssistant: three\r\n")], "id string, text string")
    found = [(r.role, r.text) for r in chat_hmm.format_transcripts(plain, model, "id", "text").orderBy("first_line").collect()]
    assert found == [("user", "one\r\ntwo\r"), ("assistant", "three\r")]
