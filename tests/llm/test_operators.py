"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

from slidemill.llm import ann, bpe, common, fingerprint, language, licenses, minhash, mixing, quality, repeats, toxicity

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, score string, spans string, node string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def invented(n, rng, vocabulary=400):
    made = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(made) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = invented(220, rng).split()
    out = [None, "", "  ", "!!!", "one", "One  two\tTHREE", "é ß 中文 \U0001f600", "x" * 3000, invented(3000, rng), " ".join(base), " ".join(base)]
    for k in range(40):  # near copies, of which some are only near each other
        copy = list(base)
        for _ in range(1 + k % 7):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(1000)}"
        out.append(" ".join(copy))
    passage = invented(90, rng)
    for k in range(12):
        out.append(f"{invented(20 + k, rng)} {passage} {invented(15, rng)}")
    return out + ["Released under the MIT License.", "gnu GENERAL public license; Apache-License, mit license mit license"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 3}", "a", "b", "c") for k, t in enumerate(texts)]
    rows += [rows[9], (None, texts[9], None, None, None, None, None)]  # a row again, and one without an id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1


def brute(rows, queries, top):
    out = {}
    for q, a in queries:
        s = sorted((-sum(float(x) * float(y) for x, y in zip(a, b)), i) for i, b in rows if i != q)[:top]
        out[q] = [(i, -v) for v, i in s]
    return out


def test_ann_finds_the_nearest_and_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24)).astype(np.float32)
    v[200:] = v[200]  # many equal ones
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [float("inf")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [1.0] * 3), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(table, table.filter("vec_id % 20 = 0"), top=7).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 7)
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in sorted(found[q], key=lambda x: (-x[1], x[0]))]
        assert np.allclose([s for _, s in found[q]], [dict(want[q]).get(i, s) for i, s in found[q]])


def test_ann_with_few_rows_and_with_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table, table.filter("vec_id % 20 = 0"), top=5).collect())
    assert got == [(0, 1, 20), (0, 2, 20), (20, 1, 0), (20, 1, 0)]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_estimates_and_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    turn = ann.rotation(64)
    codes = ann.encode(v, turn)
    assert codes[0].shape == (ann.CODE // 64, 2000) and np.allclose(codes[1], np.linalg.norm(v, axis=1))
    ones = np.bitwise_count(codes[0]).sum(axis=0).astype(float)
    off, near = [], []
    for x in q:
        guess, error = ann.estimates(codes, ones, x, turn)
        off.append(np.abs(guess - v @ x) <= error)
        near.append((guess - v @ x) / error)
    assert np.mean(off) > 0.999 and abs(np.mean(near)) < 0.02  # unbiased


def test_ann_codes_select_few_of_more_rows_than_the_sample(monkeypatch):
    rng = np.random.default_rng(3)
    n, dim = 3 * ann.SAMPLE, 64
    turn = ann.rotation(dim)

    def share(v, centroids):
        own = ann.nearest(v, centroids)
        best = ann.Best(100, 20)
        q_ids = np.arange(0, 100 * 100, 100)
        for k in range(len(centroids)):
            ids = np.flatnonzero(own == k)
            for i in range(0, len(ids), ann.ROWS):
                some = ids[i : i + ann.ROWS]
                best.meet(v[q_ids], q_ids, turn, some, v[some], ann.encode(v[some] - centroids[k], turn), centroids[k])
        scores = v[q_ids] @ v.T
        scores[np.arange(100), q_ids] = -np.inf
        want = np.argsort(-scores, axis=1)[:, :20]
        hits = sum(len(set(best.ids[best.query == i]) & set(want[i])) for i in range(100))
        return hits / 2000, best.scored / best.seen

    plain = rng.standard_normal((n, dim))
    plain /= np.linalg.norm(plain, axis=1)[:, None]
    recall, scored = share(plain, ann.fitted(plain[: ann.SAMPLE]))
    assert recall > 0.99 and scored < 0.05, (recall, scored)
    centers = rng.standard_normal((20, dim))
    grouped = centers[rng.integers(0, 20, n)] + 0.2 * rng.standard_normal((n, dim))
    recall, scored = share(grouped, ann.fitted(grouped[: ann.SAMPLE]))
    assert recall > 0.99 and scored < 0.05, (recall, scored)


def test_ann_ignores_columns_of_its_own_names(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], 1, "a", 2, 3) for i, v in enumerate(rng.standard_normal((50, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, list string, query_id int, id int")
    got = ann.search(table, table.filter("vec_id % 10 = 0"), top=3)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 15


# ---- 2


@pytest.fixture(scope="module")
def coder():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_columns(spark, docs, empty, reference):
    args = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for r in bpe.encode(docs, *args, ["doc_id", "score", "text"]).collect():
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode(empty, *args, ["doc_id"]).count() == 0


def test_bpe_of_random_text(coder, reference):
    rng = random.Random(0)
    for k in range(3000):
        most = rng.choice([0x80, 0x250, 0x3000, 0x110000])
        text = "".join(chr(c) for c in (rng.randrange(1, most) for _ in range(rng.randrange(30))) if not 0xD800 <= c < 0xE000)
        if k % 3 == 0:
            text = "".join(rng.choice(["'s", "'re", " ", "\n", "a", "the", "1", "\t", " é", "'", "r", "e", "\x1c", "\x85", "　"]) for _ in range(rng.randrange(40)))
        assert coder.encode(text) == reference.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_bpe_edits(coder, reference):
    rng = random.Random(1)
    for _ in range(200):
        made = bpe.EditableText(coder, "".join(rng.choice("the ing'sre \n12é") for _ in range(80)))
        for _ in range(5):
            i = rng.randrange(len(made.text) + 1)
            made.edit(i, min(len(made.text), i + rng.randrange(4)), "".join(rng.choice("'sre ab\n1!") for _ in range(rng.randrange(5))))
            assert made.ids() == reference.encode_ordinary(made.text)
        table = bpe.PrefixTable(coder.vocabulary, "".join(rng.choice("abdeing") for _ in range(300)).encode())
        n = table.edit(20, 22, b"ing")
        assert table.last == bpe.PrefixTable(coder.vocabulary, table.piece).last and n < 250
        table.cut(50)
        table.append(b"ed")
        assert table.ids() == bpe.PrefixTable(coder.vocabulary, table.piece).ids()


# ---- 3


def test_mixing_reaches_the_targets(spark, empty):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randint(1, 400), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b"]), "", "", "") for k in range(4000)]
    table = spark.createDataFrame(rows, SCHEMA)
    shown = mixing.with_margins(table)
    cells = shown.groupBy("__source", "__lang", "__topic").agg({"__tokens": "sum"}).withColumnRenamed("sum(__tokens)", "tokens")
    raked = mixing.rake(cells, rounds=8).toPandas()
    for name in ("source", "lang"):
        share = raked.groupby(f"__{name}").w.sum() / raked.w.sum()
        want = raked.groupby(f"__{name}")[f"share_{name}"].first()
        assert np.allclose(share, want, atol=1e-6)
    drawn = mixing.mix(table).toPandas()
    got = drawn.groupby("__source").__tokens.sum() / drawn.__tokens.sum()
    want = raked.groupby("__source").share_source.first()
    assert np.allclose(got, want, atol=0.03) and 0 < len(drawn) < 4000
    assert mixing.mix(empty).count() == 0
    given = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("none", 0.9)], "category string, share double")
    raked = mixing.rake(cells, {"source": given}, rounds=8).toPandas()
    assert np.allclose(raked.groupby("__source").w.sum() / raked.w.sum(), [0.5, 0.5], atol=1e-6)


def test_mixing_keeps_its_share_beside_one_odd_document(spark):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(200, 400), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "b"]), "", "", "") for k in range(4000)]
    odd = (-1, "y" * 400, "xx", "odd", "", "", "")
    for table in (rows, [*rows, odd]):
        shown = mixing.mix(spark.createDataFrame(table, SCHEMA), kept=0.5).toPandas()
        total = sum(max(1, -(-len(r[1]) // 4)) for r in table)
        assert abs(shown.__tokens.sum() / total - 0.5) < 0.03 and set(shown.doc_id) <= {r[0] for r in table}
    assert -1 in set(shown.doc_id)


def test_mixing_takes_nulls_repeats_and_clashing_names(spark, texts):
    rows = [(k, t, "en", None, "a", "b", "c") for k, t in enumerate(texts)] + [(None, None, None, None, None, None, None), (9, texts[9], "en", None, "a", "b", "c"), (7777, "mit license; see http://x @y", "de", "s", "", "", "")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("__probability", F.lit("z")).withColumn("__topic", F.lit("z"))
    got = mixing.mix(table, kept=1.0).collect()
    assert len(got) == len(rows) and {r["__source"] for r in got} == {"", "s"} and {r["__probability"] for r in got} == {1.0}
    by = {r["doc_id"]: r for r in got}
    assert by[7777]["__topic"] == "contact" and by[None]["__tokens"] == 1 and by[None]["__topic"] == "prose"
    given = mixing.mix(table, kept=1.0, topics=F.col("lang")).filter("doc_id = 7777").first()
    assert given["__topic"] == "de"
    few = mixing.mix(table, kept=0.5).groupBy("doc_id").count().filter("count > 1").collect()
    assert [r["doc_id"] for r in few] in ([], [9])  # repeated rows are drawn or not together


def test_mixing_scale_and_margins(spark):
    cells = [("a", "x", "t", 1000, 0.5), ("a", "y", "t", 10, 0.2), ("b", "x", "t", 100, 0.3), ("c", "x", "t", 50, 0.0)]
    table = spark.createDataFrame(cells, "__source string, __lang string, __topic string, tokens long, w double")
    for kept in (0.01, 0.1, 0.5, 0.9):
        c = mixing.scale(table, kept)
        assert abs(sum(min(r[3], c * r[4]) for r in cells) - kept * 1160) < 1e-6
    assert mixing.scale(table, 1.0) == float("inf") and mixing.scale(table.limit(0), 0.5) == 0.0
    p = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(mixing.scale(table, 0.5)) / F.col("tokens"))).otherwise(0.0)
    got = {(r["margin"], r["category"]): r for r in mixing.margins(table.withColumns({"__probability": p, "share_source": F.lit(0.5), "share_lang": F.lit(0.5), "share_topic": F.lit(1.0)})).collect()}
    assert len(got) == 6 and abs(got["source", "a"]["expected"] - 480 / 580) < 1e-9 and abs(got["lang", "y"]["expected"] - 10 / 580) < 1e-9 and got["source", "a"]["wanted"] == 0.5


# ---- 4


def test_licenses_base_places(docs, empty, texts):
    got = {(r["doc_id"]): r for r in licenses.scan(docs).filter("doc_id IS NOT NULL").collect()}
    assert licenses.scan(docs).count() == len(texts) + 2
    for k, t in enumerate(texts):
        w, places, labels = words(t), [], set()
        for p in licenses.PHRASES:
            p_words = p.text.split()
            at = [i for i in range(len(w)) if w[i : i + len(p_words)] == p_words]
            places += at
            labels |= {p.label} if at else set()
        base = [s for s in got[k]["spans"] if s["phrase"]]
        assert got[k]["n_words"] == len(w) and sorted(s["start"] for s in base) == sorted(places) and {s["label"] for s in base} == labels
    assert licenses.scan(empty).count() == 0


def test_licenses_notices_with_words_put_in_and_left_out(spark):
    notice = licenses.NOTICES[6].text.split()
    changed = notice[:20] + ["very"] + notice[20:40] + notice[42:]
    table = spark.createDataFrame([(1, "Foreword. " + " ".join(changed).upper()), (2, " ".join(notice[:20])), (3, "to the of the and the")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in licenses.scan(table).collect()}
    assert [(s["label"], s["start"]) for s in got[1]] == [("mit", 1)] and got[1][0]["cover"] > 0.9
    assert got[2] == [] and got[3] == []


# ---- 5


def test_fingerprints_estimate_and_merge(spark, docs, empty, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint(docs, ["doc_id", "score"]).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k]["n_distinct"] - len(bag(t))) <= 0.35 * len(bag(t))
    a, b = (fingerprint.unpack(got[k]["fingerprint"]) for k in (9, 12))
    x, y = set(bag(texts[9])), set(bag(texts[12]))
    assert abs(fingerprint.resemblance(a, b) - len(x & y) / len(x | y)) < 0.15
    assert abs(fingerprint.containment(a, b) - len(x & y) / len(x)) < 0.2
    assert got[9]["fingerprint"] == got[10]["fingerprint"] and got[0]["fingerprint"] == got[3]["fingerprint"] == ""
    parts = spark.createDataFrame([("k", got[9]["fingerprint"]), ("k", got[12]["fingerprint"]), ("k", None), (None, got[8]["fingerprint"])], "g string, fingerprint string").repartition(3)
    whole = {r["g"]: r["fingerprint"] for r in fingerprint.merge(parts, "g").collect()}
    assert whole["k"] == fingerprint.pack(fingerprint.merged([a, b])) and whole[None] == got[8]["fingerprint"]
    assert fingerprint.fingerprint(empty, ["doc_id"]).count() == 0


def test_every_row_meets_the_next(spark, docs, empty, texts):
    rows = fingerprint.in_order(docs, "doc_id").collect()
    ids = sorted([r["doc_id"] for r in docs.collect()], key=lambda x: -1 if x is None else x)
    seen = {}
    for a, b in zip(rows, rows[1:]):
        if not a["__after"] and a["__run"] == b["__run"]:
            seen.setdefault(a["doc_id"], []).append(b["doc_id"])
    want = {}
    for a, b in zip(ids, ids[1:] + ids[:1]):
        want.setdefault(a, []).append(b)
    assert {k: sorted(v, key=str) for k, v in seen.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert fingerprint.in_order(empty, "doc_id").count() == 0


# ---- 6, 7, 10


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(900):
        en = k % 2 == 0
        text = " ".join("".join(rng.choice("tehaonris" if en else "eéuxàoiq") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 120)))
        bad, rude = k % 5 == 0, k % 7 == 0
        if bad:
            text = " ".join(f"{w}!!" for w in text.upper().split())
        if rude:
            text += rng.choice([" you nasty fool", " such a nasty creature", " fool"]) * rng.randint(1, 3)
        rows.append((k, text, "en" if en else "fr", "s", "", "", ""))
        labels.append((k, int(not bad), int(rude)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns(spark, learnable, docs, empty):
    rows, labels = learnable
    model = quality.train(common.labelled(spark, rows, labels, "quality", 4, 2, 500))
    assert 0 < len(model.rules) < 200
    got = quality.score(rows, model, ["doc_id"]).join(labels, "doc_id").filter(common.fold_of(F.col("doc_id"), 4) == 2).collect()
    assert len(got) > 150 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert quality.score(docs, model, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    assert quality.train(common.labelled(spark, rows, labels.limit(0), "quality", 4, 2, 500)).rules == []


def test_quality_rules_are_those_of_the_trees():
    tree = """DecisionTreeClassificationModel
  If (feature 2 <= 0.5)
   If (feature 0 <= 1.5)
    Predict: 0.0
   Else (feature 0 > 1.5)
    Predict: 1.0
  Else (feature 2 > 0.5)
   Predict: 1.0
"""
    a, b = quality.STATISTICS[2], quality.STATISTICS[0]
    assert quality.rules_of(tree) == [((a, True, 0.5),), tuple(sorted([(a, True, 0.5), (b, True, 1.5)])), tuple(sorted([(a, True, 0.5), (b, False, 1.5)])), ((a, False, 0.5),)]


def test_toxicity_learns(spark, learnable, docs, empty):
    rows, labels = learnable
    model = toxicity.train(common.labelled(spark, rows, labels, "toxic", 5, 0, 500))
    got = toxicity.score(spark, rows, model, ["doc_id"]).join(labels, "doc_id").filter(common.fold_of(F.col("doc_id"), 5) == 0).collect()
    assert len(got) > 150 and np.mean([(r["score"] >= 0.5) == r["toxic"] for r in got]) > 0.95
    assert toxicity.score(spark, docs, model, ["doc_id"]).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score(spark, empty, model, ["doc_id"]).count() == 0
    none = toxicity.train(common.labelled(spark, rows, labels.limit(0), "toxic", 5, 0, 500))
    assert {r["score"] for r in toxicity.score(spark, docs, none, ["doc_id"]).collect()} == {0.0}


def test_toxicity_by_joins_is_that_by_arrays(spark, learnable, docs, monkeypatch):
    rows, labels = learnable
    given = toxicity.marked(rows, labels)
    texts = docs.withColumn("score", F.lit("given")).withColumn("a", F.lit("given"))
    near = {r["doc_id"]: r["score"] for r in toxicity.score(spark, rows, toxicity.train(given), ["doc_id"]).collect()}
    monkeypatch.setattr(toxicity, "SMALL", 0)
    model = toxicity.train(toxicity.marked(rows, labels))
    assert model.ratios is None
    far = {r["doc_id"]: r["score"] for r in toxicity.score(spark, rows, model, ["doc_id"]).collect()}
    assert near.keys() == far.keys() and max(abs(near[k] - far[k]) for k in near) < 1e-3
    got = toxicity.score(spark, texts, model, ["doc_id", "a", "score"])
    assert got.columns == ["doc_id", "a", "score"] and got.filter("a = 'given' AND score BETWEEN 0 AND 1").count() == docs.count()


def test_toxicity_pairs_meet_in_buckets(spark, learnable, docs, monkeypatch):
    """Pairs too many for an array are packed and looked up by buckets: evidence is that by arrays of all, texts keep what they carry, and a pair takes few bytes."""
    rows, labels = learnable
    near = toxicity.train(toxicity.marked(rows, labels))
    assert near.rest is None
    expected = {r["doc_id"]: r for r in toxicity._evidence(rows, near, ["doc_id"]).collect()}
    few = near.word.count() + near.stem.count()
    monkeypatch.setattr(toxicity, "SMALL", few)
    monkeypatch.setattr(toxicity, "CHUNK", 5000)
    monkeypatch.setattr(toxicity, "OFTEN", 0)
    joined = toxicity.train(toxicity.marked(rows, labels))
    assert joined.rest is None and joined.ratios is not None and joined.pair.count() == len(near.ratios.pair[0])
    monkeypatch.setattr(toxicity, "OFTEN", 1 << 20)
    far = toxicity.train(toxicity.marked(rows, labels))
    assert far.rest is not None and far.pair is None and far.ratios.pair is None and 0 < len(far.ratios.often[0]) < len(near.ratios.pair[0])
    held = sum(len(toxicity._sums(r["number"])) for r in far.rest.collect())
    assert held + len(far.ratios.often[0]) == len(near.ratios.pair[0])
    for model in (joined, far):
        got = {r["doc_id"]: r for r in toxicity._evidence(rows, model, ["doc_id"]).collect()}
        assert got.keys() == expected.keys() and max(abs(got[k][x] - expected[k][x]) for k in expected for x in "abcde") < 1e-3
    texts = docs.withColumn("score", F.lit("given")).withColumn("a", F.lit("given"))
    got = toxicity.score(spark, texts, far, ["doc_id", "a", "score"])
    assert got.columns == ["doc_id", "a", "score"] and got.filter("a = 'given' AND score BETWEEN 0 AND 1").count() == docs.count()


def test_toxicity_packed_numbers():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.uint64), np.zeros(9, np.uint64), np.array([(1 << 64) - 1, 0, 7], np.uint64), rng.integers(0, 300, 1000).astype(np.uint64)):
        assert (toxicity._unpacked(toxicity._packed(x)) == x).all()
        assert (toxicity._sums(toxicity._gaps(np.sort(x))) == np.sort(x)).all()
    assert len(toxicity._gaps(np.sort(rng.integers(0, 1 << 38, 1 << 20).astype(np.uint64)))) < 3 << 20


def test_toxicity_sketches(spark):
    for n in (0, 1, 4, 60, 5000):
        x = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(n << 20))
        bits = [np.bitwise_or.reduce(toxicity._bits(toxicity._code(x), half)).astype(np.uint64).view(np.int64) for half in (0, 1)]
        got = spark.createDataFrame([(int(bits[0]), int(bits[1]))], "a long, b long").select(toxicity.distinct("a", "b")).first()[0]
        assert abs(got - n) <= max(2, 0.9 * n), (n, got)


def test_toxicity_is_that_of_counts_by_hand(spark, learnable):
    """Kneser-Ney ratios from plain dictionaries, with exact numbers of neighbours: scores of documents agree but for the sketches' error."""
    rows, labels = learnable
    given = toxicity.marked(rows, labels).withColumn("part", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(toxicity.CURVE))).collect()
    n, c, two, of_stem, size = (collections.Counter() for _ in range(5))
    before, after, begun, stems, kinds = (collections.defaultdict(set) for _ in range(5))
    stem = lambda w: w.encode()[: toxicity.STEM]
    for r in given:
        held = words(r["text"])
        y = r["y"] if r["part"] != 0 else None
        for v, w in zip(["^", *held], held):
            before[w].add(v)
            begun[stem(w)].add((v, w))
            if y is not None:
                n[y, w] += 1
                c[y, v] += 1
                two[y, v, w] += 1
                of_stem[y, stem(w)] += 1
                after[y, v].add(w)
                stems[y].add(stem(w))
                kinds[y].add(w)
                size[y] += 1
    d = toxicity.DISCOUNT
    wide = sum(len(x) for x in before.values())
    rest = [d * len(kinds[y]) / size[y] for y in (0, 1)]
    first = [d * len(stems[y]) / size[y] for y in (0, 1)]
    new = np.log(rest[1] / rest[0]) + np.log(first[1] / first[0])
    seen = lambda x, *k: x[(1, *k)] > 0 and x[(0, *k)] + x[(1, *k)] > 1
    s = lambda y, k: max(of_stem[y, k] - d, 0) / size[y] + first[y] * len(begun[k]) / wide
    p = lambda y, w: max(n[y, w] - d, 0) / size[y] + rest[y] * s(y, stem(w)) * len(before[w]) / len(begun[stem(w)])
    back = lambda y, v: d * len(after[y, v]) / c[y, v] if c[y, v] else 1.0
    q = lambda y, v, w: max(two[y, v, w] - d, 0) / max(c[y, v], 1) + back(y, v) * p(y, w)

    def ratio(v, w):
        if seen(two, v, w):
            return np.log(q(1, v, w) / q(0, v, w)) - new
        alone = np.log(p(1, w) / p(0, w)) - new if seen(n, w) else np.log(s(1, stem(w)) / s(0, stem(w))) - np.log(first[1] / first[0]) if seen(of_stem, stem(w)) else 0.0
        return alone + (np.log(back(1, v) / back(0, v)) if c[1, v] else 0.0)

    model = toxicity.train(toxicity.marked(rows, labels))
    got = {r["doc_id"]: (r["a"], r["b"]) for r in toxicity._evidence(rows, model, ["doc_id"]).collect()}
    mean, most = [], []
    for r in given:
        held = words(r["text"])
        x = [ratio(v, w) for v, w in zip(["^", *held], held)]
        mean.append((np.mean(x), got[r["doc_id"]][0]))
        most.append((max(x), got[r["doc_id"]][1]))
    for x in (np.array(mean), np.array(most)):
        assert np.corrcoef(x.T)[0, 1] > 0.97 and np.abs(x[:, 0] - x[:, 1]).mean() < 0.3



def test_toxicity_models_are_whole(spark, learnable, monkeypatch):
    """Mean log-likelihood ratios by plain dictionaries over all that either class has, also once; the same with pairs joined and with all joined."""
    rows, labels = learnable
    given = toxicity.marked(rows, labels).withColumn("part", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(toxicity.CURVE))).collect()
    n, c, two, of_stem, size = (collections.Counter() for _ in range(5))
    before, after, begun, stems, kinds = (collections.defaultdict(set) for _ in range(5))
    stem = lambda w: w.encode()[: toxicity.STEM]
    for r in given:
        y, held = r["y"] if r["part"] != 0 else None, words(r["text"])
        for v, w in zip(["^", *held], held):
            before[w].add(v)
            begun[stem(w)].add((v, w))
            if y is not None:
                for counter, k in ((n, w), (c, v), (two, (v, w)), (of_stem, stem(w))):
                    counter[y, k] += 1
                after[y, v].add(w)
                stems[y].add(stem(w))
                kinds[y].add(w)
                size[y] += 1
    d = toxicity.DISCOUNT
    wide = sum(len(x) for x in before.values())

    def p(y, v, w):
        k = stem(w)
        of_k = max(of_stem[y, k] - d, 0) / size[y] + d * len(stems[y]) / size[y] * len(begun[k]) / wide
        of_w = max(n[y, w] - d, 0) / size[y] + d * len(kinds[y]) / size[y] * of_k * len(before[w]) / len(begun[k])
        return max(two[y, (v, w)] - d, 0) / max(c[y, v], 1) + (d * len(after[y, v]) / c[y, v] if c[y, v] else 1.0) * of_w

    assert any(two[0, k] == 1 and not two[1, k] for _, k in two) and any(two[1, k] == 1 and not two[0, k] for _, k in two)
    model = toxicity.train(toxicity.marked(rows, labels))
    near = {r["doc_id"]: r for r in toxicity._evidence(rows, model, ["doc_id"]).collect()}
    got = []
    for r in given:
        held = words(r["text"])
        got.append((np.mean([np.log(p(1, v, w) / p(0, v, w)) for v, w in zip(["^", *held], held)]), near[r["doc_id"]]["e"]))
    got = np.array(got)
    assert np.corrcoef(got.T)[0, 1] > 0.99 and np.abs(got[:, 0] - got[:, 1]).mean() < 0.3
    for most in (model.word.count() + model.stem.count(), 0):
        monkeypatch.setattr(toxicity, "SMALL", most)
        far = toxicity.train(toxicity.marked(rows, labels))
        assert far.ratios.pair is None if most else far.ratios is None
        joined = {r["doc_id"]: r for r in toxicity._evidence(rows, far, ["doc_id"]).collect()}
        assert joined.keys() == near.keys() and max(abs(joined[k][x] - near[k][x]) for k in near for x in "abcde") < 1e-3



def test_language_learns(spark, learnable, docs, empty):
    rows, _ = learnable
    model = language.train(rows.filter(common.fold_of(rows["doc_id"], 3) != 1))
    got = language.identify(spark, rows, model, ["doc_id", "lang"]).filter(common.fold_of(F.col("doc_id"), 3) == 1).collect()
    assert len(got) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark, docs, model, ["doc_id", "score"]).collect()}
    assert all(named[k] == ("und", 0.0) for k in range(4)) and named[4][0] in ("en", "fr")
    assert language.identify(spark, empty, language.train(empty), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language.identify(spark, docs, language.train(empty), ["doc_id"]).collect()} == {"und"}


# ---- 8


def covered(data, repeats_at, width):
    out = np.zeros(len(data) + 1, int)
    for i in repeats_at:
        out[i] += 1
        out[i + width] -= 1
    return np.cumsum(out)[: len(data)] > 0


def repeated(rows, width, first):
    """For each text, places of windows that start elsewhere too, or (first) that started before in order of rows."""
    count = collections.Counter(t[i : i + width] for t in rows for i in range(len(t) - width + 1))
    seen, out = set(), []
    for t in rows:
        at = []
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if count[w] > 1 and (not first or w in seen):
                at.append(i)
            seen.add(w)
        out.append(at)
    return out


def test_lpf_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        m = rng.integers(97, 99, (rng.integers(1, 40), rng.integers(1, 6))).astype(np.uint8)
        same = lambda a, b: int(np.argmin(np.append(a == b, False)))
        want = [max([same(m[i], m[j]) for j in range(i)], default=0) for i in range(len(m))]
        assert repeats.longest_previous_factor(*repeats.suffix_order(m)).tolist() == want


def columns(spans):
    return tuple(np.array([x[k] for x in spans], np.int64) for k in ("kind", "from", "to"))


@pytest.mark.parametrize("many, width, gram", [(1000, 400, 128), (3, 400, 128), (20, 90, 30)])
def test_repeats_by_brute_force(spark, docs, monkeypatch, many, width, gram):
    monkeypatch.setattr(repeats, "MANY", many)
    for kind, table in ((repeats.ANY, docs), (repeats.LATER, docs.dropDuplicates(["doc_id"]))):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "").encode()) for r in table.collect()), key=lambda r: r[0])
        got = {-1 if r["id"] is None else r["id"]: repeats.cover(columns(r["spans"]), width, kind) for r in repeats.spans(table, "doc_id", width, gram).collect()}
        for (k, t), at in zip(rows, repeated([t for _, t in rows], width, kind == repeats.LATER), strict=True):
            flags = np.zeros(len(t), bool)
            for a, b in got.get(k, []):
                flags[a:b] = True
            assert (flags == covered(t, at, width)).all(), (kind, k)


def test_repeats_query_by_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    got = sorted((r for r in repeats.query(spark, str(tmp_path)).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    want = []
    passages, grams = (repeated([t for _, t in rows], n, False) for n in (repeats.PASSAGE, repeats.GRAM))
    for (k, t), at, passage, gram in zip(rows, repeated([t for _, t in rows], 400, False), passages, grams, strict=True):
        gone = covered(t, at, 400)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        want.append((k, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), bool(passage), int(covered(t, gram, repeats.GRAM).sum())))
    want.sort(key=lambda r: (r[0] is not None, r[0]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want, strict=True):
        # a repeated passage is always seen, and nothing counts that doesn't repeat
        assert (r["longest_shared"] >= repeats.GRAM) >= w[5] and r["n_shared"] <= w[6] and r["n_later"] <= r["n_removed"]


def test_repeats_keep_the_first_copy_and_all_columns(docs, empty, texts):
    left = repeats.without_repeats(docs.filter("doc_id IS NOT NULL"))
    assert left.columns == docs.columns and left.count() == len(texts) + 1
    by = {r["doc_id"]: r["text"] for r in left.collect()}
    assert by[9] == texts[9] and by[10] == "" and by[0] == "" and by[6] == texts[6]
    assert repeats.without_repeats(empty).count() == 0


# ---- 9


def likeness(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def classes(rows, near):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            if same or bags[i] and bags[j] and likeness(bags[i], bags[j]) >= near:
                parent[find(i)] = find(j)
    out = collections.defaultdict(set)
    for i, r in enumerate(rows):
        out[find(i)].add(r[0])
    return sorted(sorted(x) for x in out.values())


def test_near_duplicates_by_brute_force(docs, empty):
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect()]
    got = collections.defaultdict(set)
    for r in minhash.groups(docs).collect():
        got[r["class_id"]].add(-1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(sorted(x) for x in got.values()) == classes(rows, 0.8)
    assert minhash.groups(empty).count() == 0


def test_one_of_each_group_stays(docs, empty):
    left = minhash.keep_one(docs)
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect()]
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(ids) == sorted(min(i for i in c if i >= 0) for c in classes(rows, 0.8)) and left.columns == docs.columns
    assert minhash.keep_one(empty).count() == 0


def test_signatures_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)), rng.integers(1, 9, 300)
    b = a[0][50:], np.maximum(a[1][50:] - rng.integers(0, 3, 250), 1)
    both = minhash.signatures([a, b, (np.zeros(0, np.uint64), np.zeros(0, np.int64))], slots=3000)
    assert abs((both[0] == both[1]).mean() - minhash.likeness(a, b)) < 0.04
    again = minhash.signatures([b], slots=3000)
    assert (again[0] == both[1]).all()


def test_overlaps_count_copies():
    rng = np.random.default_rng(0)
    made = [np.unique(rng.integers(0, 40, rng.integers(0, 60)).astype(np.uint64), return_counts=True) for _ in range(30)]
    got = minhash.overlaps(made[:10], made[10:], 16)
    for i, a in enumerate(made[:10]):
        for j, b in enumerate(made[10:]):
            x, y = dict(zip(*a)), dict(zip(*b))
            assert got[i, j] == sum(min(n, y.get(s, 0)) for s, n in x.items())
