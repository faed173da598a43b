"""Sharding, source divergence and filter interaction against brute force in plain Python."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from slidemill.llm import divergence, filters, sharding

SCHEMA = "doc_id long, text string, lang string, source string, shard string, bin string, mask string, d string, n string, words string, part string"
EXTRA = ("a", "b", "c", "d", "e", "f", "g")


def made(rows):
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioBCDéß中") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "$", "1"]) for _ in range(n))
    out = [(k, text(rng.choice([3, 30, 250])), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for k in range(150)]
    out += [(k, "one text that very many documents have", "en", "s1") for k in range(200, 290)]  # a third of all rows
    out += [(300, None, "en", "s1"), (301, "", None, None), (302, "  \t\n", "fr", "s9"), (303, "x" * 30_000 + " END", "fr", "s8"), (None, out[0][1], "en", "s2"), (None, None, None, None)]
    return out + [out[5], out[5], (7, out[5][1], "de", "s3"), (1, out[0][1], "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11


def scheduled(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], {}
    for size, name in sorted(((v, k) for k, v in sizes.items()), key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def check_shards(got, rows, shards, items):
    text = lambda t: (t or "").encode()
    digest = lambda t: hashlib.sha256(text(t)).hexdigest()
    weight = collections.Counter()
    for r in rows:
        weight[digest(r[1])] += len(text(r[1])) + 16
    total = sum(weight.values())
    name = {d: d if w > total // items else f"{int(d[:8], 16) % items:08d}" for d, w in weight.items()}
    sizes = collections.Counter()
    for d, w in weight.items():
        sizes[name[d]] += w
    want = scheduled(sizes, shards)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["digest"], r["shard"]) for r in got) == collections.Counter(
        (r[0], len(text(r[1])) + 16, zlib.crc32(text(r[1])), digest(r[1]), want[name[digest(r[1])]]) for r in rows
    )
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    order = lambda r: (int(hashlib.md5(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()).hexdigest()[:8], 16), r["doc_id"] is not None, r["doc_id"] or 0, r["digest"])
    for s in range(shards):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert own == sorted(own, key=order)


def test_shards_are_those_of_the_heap(docs, rows):
    check_shards(sharding.sharded(docs, 7).collect(), rows, 7, sharding.ITEMS)


def test_small_groups_go_by_bins(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ITEMS", 60)
    got = sharding.sharded(docs, 3).collect()
    check_shards(got, rows, 3, 60)
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 3


def test_a_group_stays_together_and_loads_are_near(spark):
    rng = random.Random(8)
    many = [(k, "x" * rng.randint(0, 900) + str(k), "en", "s") for k in range(1500)] + [(5000 + k, "the same", "en", "s") for k in range(700)]
    got = sharding.sharded(spark.createDataFrame(made(many), SCHEMA), 10).collect()
    assert len({r["shard"] for r in got if r["doc_id"] >= 5000}) == 1 and len(got) == len(many)
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 10


def test_more_shards_than_groups_and_no_rows(spark, none):
    few = spark.createDataFrame(made([(1, "a", None, None), (2, "a", None, None), (3, None, None, None)]), SCHEMA)
    got = sharding.sharded(few, 40).collect()
    assert [len({r["shard"] for r in got if r["doc_id"] in ids}) for ids in ((1, 2), (3,), (1, 2, 3))] == [1, 1, 2]
    assert sharding.sharded(none).count() == 0


def test_shards_are_written_with_all_columns(docs, rows, spark, tmp_path):
    sharding.write(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {"text", "lang", "source", "words", "shard", "slot"} <= set(back.columns) and back.count() == len(rows)
    assert sorted(str(r["text"]) for r in back.select("text").collect()) == sorted(str(r[1]) for r in rows)


# ---- 12


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def diverged(rows, least, top):
    docs = [(r[2] or "", r[3] or "", collections.Counter(terms(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in of for t in d[2])
        kept = {t for t, n in seen.items() if n >= least}
        count = {s: collections.Counter() for s in {d[1] for d in of}}
        for _, s, c in of:
            count[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(count.values(), collections.Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            own = [(-far(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [10, 1, 1000])
def test_divergence(docs, rows, least):
    got = sorted(tuple(r) for r in divergence.audit(docs, least).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == diverged(rows, least, 10)


def test_divergence_with_a_language_table_too_large_to_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SMALL", 1)
    got = sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == diverged(rows, 10, 10)


def test_divergence_of_nothing(none):
    assert divergence.audit(none).count() == 0


@pytest.mark.parametrize(("count", "size"), [(0, 2), (5, 7), (10**13, 10**13 + 2), (10**13, 2 * 10**14), (2 * 10**14, 28 * 10**13)])
def test_shares_are_exact(spark, count, size):
    got = spark.range(1).select(divergence.share(F.lit(count).cast("long"), F.lit(size).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (count + 2) // size


# ---- 13


def interactions(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])

    def fails(r):
        t = r[1] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        flags = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), r[0] is not None and r[0] > first[t]]
        return {x for x, f in zip("ABCDE", flags, strict=True) if f}

    masked = [(r[2] or "", fails(r), r[0]) for r in rows]
    out = []
    for part in {m[0] for m in masked}:
        own, by_filter, made_ = [m for m in masked if m[0] == part], collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left_ = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                by_filter[f] += len(gone)
                made_.append([
                    part, "".join(order), k + 1, len(left_), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == {f} for m in own),
                    sum(m[2] in good for m in gone), sum(m[2] in toxic for m in gone), f,
                ])
                left = left_
        out += [tuple([*x[:-1], by_filter[x[-1]]]) for x in made_]
    return sorted(out)


def test_filter_interactions(spark, docs, rows):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 290, 4)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1), (9, None, None), (99_999, 1, 1)]
    got = filters.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == interactions(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_interactions_by_another_part_and_of_nothing(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filters.audit(docs, labels, F.col("source"))
    assert sorted(tuple(r) for r in got.collect()) == interactions([(r[0], r[1], r[3], r[3]) for r in rows], [])
    assert filters.audit(none, labels).count() == 0
