"""Resampling, exact top-k and the filter audit: brute-force versions, odd rows, empty tables, known values."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameflow.llm import audit, resampling, topk
from tests.llm.test_edges import DOCS, documents, odd, prose  # noqa: F401

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def resampled(docs, target, percent=25, least=20):
    """docs: (doc_id, text) -> sorted (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            count.update(map(bucket, features(text)[0]))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    rows = []
    for doc, text in docs:
        own, words = features(text)
        weight = math.floor(sum(gain(bucket(f)) for f in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    good = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(good[: percent * len(good) // 100])]
    left = list(rows)
    for r in good[: len(drawn)]:
        left.remove(r)
    return sorted(drawn + [(*r[:4], None) for r in left], key=repr)


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_resample_odd(spark, odd):  # noqa: F811
    docs = odd.withColumns({c: F.lit(1) for c in ("n_words", "weight", "rank", "range", "run", "bucket", "n")})
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    target = spark.createDataFrame([(1, prose(1, 60)), (2, None), (3, "Élan VITAL, élan")], "item_id bigint, text string")
    got = as_tuples(resampling.resample(docs, target))
    assert got == resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_resample_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert resampling.resample(none, none.select("text")).collect() == []
    docs = documents(spark, [(i, prose(i, 30), "a") for i in range(8)])
    assert as_tuples(resampling.resample(docs, none.select("text"))) == resampled([(r.doc_id, r.text) for r in docs.collect()], [])
    assert all(r.rank is None for r in resampling.resample(docs, docs, percent=12).collect())  # floor(0.96) documents


def test_resample_many_runs(spark, monkeypatch):
    """Small runs, small trees and small ranges, in this process: several passes of merging, ties, and a draw that ends inside a tie."""
    monkeypatch.setattr(resampling, "FAN_IN", 3)
    monkeypatch.setattr(resampling, "_AHEAD", 2)
    r = random.Random(5)
    rows = sorted((-r.randint(0, 9), 0, i, 40, 1) for i in range(200))
    parts = [sorted(rows[i::17]) for i in range(17)]
    batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(p)), pa.array([no] * len(p)), pa.array(range(len(p))), *(pa.array(c) for c in zip(*p, strict=True))], names=resampling._RUN) for no, p in enumerate(parts)]
    out = [row for b in resampling._ranked([5], 100)(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [x[0] for x in out if x[4]] == [x[2] for x in rows[:95]] and [x[4] for x in out if x[4]] == list(range(6, 101))
    assert sorted(x[0] for x in out if x[4] is None) == sorted(x[2] for x in rows[95:])


def test_draw_over_ranges(spark, monkeypatch):
    """Three thousand rows with few scores, over many ranges and runs of each partition."""
    r = random.Random(9)
    rows = [(i, r.choice([5, 20, 33]), 40, r.randint(-3, 3), r.randint(-20, 20)) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint").repartition(7)
    got = {x.doc_id: x["rank"] for x in resampling.draw(scored, 40).collect()}
    good = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0]))
    want = {x[0]: i + 1 for i, x in enumerate(good[: 40 * len(good) // 100])}
    assert got == {x[0]: want.get(x[0]) for x in rows}


def test_feature_hashes(monkeypatch):
    """Hashes by tables equal plain ones, for long words and texts in pieces too."""
    monkeypatch.setattr(resampling, "_PIECE", 40)
    texts = ["a", "", None, "x" * 200 + " y " + "z" * 65 + " q", " ".join(f"w{i % 7} É{i}" for i in range(60)), "one two"]
    got = Counter()
    for lists, first, of in resampling._chunks(texts):
        hashed, own = resampling._hashed(lists, first, 10_000)
        got.update((of[o], h) for o, h in zip(own.tolist(), hashed.tolist(), strict=True))
    assert got == Counter((i, crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t)[0])


def best(rows, queries, k=5):
    out = []
    for q in queries:
        v = min(x for i, x in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def quantized(rows):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and whole(v)]


@pytest.mark.parametrize(("n", "queries"), [(400, 16_384), (150, 2)])
def test_top_k(spark, monkeypatch, n, queries):
    """Ties, copies, zeros, shorter and empty vectors, repeated ids, nulls and values that aren't finite; few queries a group too."""
    monkeypatch.setattr(topk, "QUERIES", queries)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=6) * (r.random(6) < 0.6))]) for i in range(n)]
    rows[50] = (50, rows[0][1])
    rows += [(i, [0.5] * 6) for i in range(1000, 1100)] + [(7, [1.0, 2.0]), (2000, []), (2050, []), (100, [-1.0] * 6), (3000, None), (3001, [None, 1.0]), (3050, [math.nan]), (3051, [math.inf]), (None, [1.0]), (-50, [0.25] * 9)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int").withColumns({c: F.lit(2) for c in ("v", "cell", "kind", "g", "b", "rank")})
    vectors = topk.quantized(df)
    plain = quantized(rows)
    assert sorted((x.vec_id, x.v) for x in vectors.collect()) == sorted(plain)
    got = sorted(tuple(x) for x in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect())
    assert got == best(plain, sorted({i for i, _ in plain if i % 50 == 0}))


def test_top_k_few_and_wide(spark):
    schema = "vec_id bigint, embedding array<float>"
    of = lambda rows: topk.quantized(spark.createDataFrame(rows, schema))
    assert topk.top_k(of([]), of([])).collect() == []
    assert topk.top_k(of([(0, [1.0])]), of([(0, [1.0])])).collect() == []
    two = of([(0, [1.0]), (3, [-2.0]), (5, [4.0e6])])  # products beyond 32 bits
    assert [tuple(x) for x in topk.top_k(two, two.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 5, 256 * 1_024_000_000), (0, 2, 3, 256 * -512)]
    far = of([(0, [1.0e15]), (1, [1.0e15])])
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(far, far).collect()


def audited(docs, labels):
    """docs: (doc_id, source, text); labels: (doc_id, quality, toxic), by walking every order over every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc, source, text in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": re.search("[#$%&*|]", t) is not None,
            "E": any((x or "") == t and i is not None and (doc is None or i < doc) for i, _, x in docs),
        }
        rows.append((source or "", doc, fails))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[2][x]]
                left = [r for r in left if not r[2][x]]
                fail = [r for r in rows if r[0] == part and r[2][x]]
                alone = sum(sum(r[2].values()) == 1 for r in fail)
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), alone, sum(r[1] in good for r in gone), sum(r[1] in bad for r in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, odd):  # noqa: F811
    more = documents(spark, [(20, "A" * 30, "a"), (21, "# " + prose(4, 250), "a"), (22, prose(4, 250), ""), (23, prose(4, 250), "b"), (24, "x " * 300, "c"), (None, prose(4, 250), "b"), (None, "null id", "z"), (None, "null id", "z"), (25, "é" * 10, "z")])
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "n", "good", "toxic", "first")})
    labels = [(20, 1, 0), (22, 1, 1), (22, 0, None), (23, None, 1), (4, 1, 0), (8, 1, 1), (None, 1, 1), (99, 1, 1)]
    given = spark.createDataFrame([(*x, 1) for x in labels], "doc_id bigint, quality int, toxic int, part int")
    got = audit.filter_audit(docs, given).collect()
    want = audited([(r.doc_id, r.source, r.text) for r in docs.collect()], labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want and len(got) == len(want)
    assert audit.filter_audit(docs.limit(0), given).collect() == [] and audit.filter_audit(docs, given.limit(0)).count() == len(want)


def test_zeta():
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 32))
    want = np.stack([counts[..., [m for m in range(32) if m & u == m]].sum(axis=-1) for u in range(32)], axis=-1)
    assert (audit.zeta(counts) == want).all()
