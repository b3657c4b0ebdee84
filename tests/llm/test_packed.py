"""Signatures and pieces packed for the shuffle, and pairs that are decided where they meet."""

import numpy as np
import pyarrow as pa

from frameflow.llm import paragraphs, simjoin
from frameflow.llm.common import save


def _by_part(packed):
    rows = sorted((r for batch in packed for r in batch.to_pylist()), key=lambda r: r["part"])
    return iter([pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("data", pa.binary())]))])


def test_hot_pieces_keep_all_places():
    """A piece that every document holds goes on by two rows of each task; places and smallest documents are those of all rows."""
    rng = np.random.default_rng(3)
    tasks, places = [], []
    for task in range(3):
        docs = np.arange(1000 - 300 * task, 1200 - 300 * task)
        key = np.concatenate([np.full(200, 7), rng.integers(10**9, 2 * 10**9, 200), np.full(2, 5 + task // 2)])
        docs = np.concatenate([docs, docs, docs[:2]]).astype(np.int64)
        begin = np.arange(len(key)).astype(np.int32)
        tasks.append(paragraphs.packed_pieces([key, key + 1, docs, begin, begin + 9], 8))
        places += list(zip(key.tolist(), docs.tolist(), begin.tolist(), strict=True))
    assert sum(t.num_rows for t in tasks) <= 3 * 8
    found = [r for batch in paragraphs._shared(_by_part(tasks)) for r in batch.to_pylist()]
    heads = {(r["own"], r["check"]): r["least"] for r in found if r["from"] < 0}
    got = {(r["doc_id"], r["from"], r["least"] if r["own"] is None else heads[r["own"], r["check"]]) for r in found if r["from"] >= 0}
    least = {}
    for k, d, _ in places:
        least.setdefault(k, set()).add(d)
    assert got == {(d, b, min(least[k])) for k, d, b in places if len(least[k]) > 1}
    assert len(heads) == 3 and set(heads.values()) == {400}


def test_equal_digests_meet_in_two_levels(spark):
    """All ids of one digest are joined, by few rows of the common digest; other digests join nothing."""
    def signed(batches):
        for batch in batches:
            ids = batch.column(0)
            yield simjoin.digest_rows([b"%016d" % (v % 3 if v < 900 else v) for v in ids.to_pylist()], ids)

    rows = spark.range(1000).repartition(4).mapInArrow(simjoin.packed_signatures(signed, 16), simjoin.PACKED)
    found = simjoin.shared_signatures(rows, "bigint", "digests").collect()
    assert {r["sig"] for r in found} == {None}
    up = {v: v for v in range(1000)}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for r in found:
        assert r["centre"] < r["id"]
        a, b = sorted((root(r["centre"]), root(r["id"])))
        up[b] = a
    assert {v: root(v) for v in up} == {v: v % 3 if v < 900 else v for v in up}


def test_drawn_centres_make_no_rows_of_pairs_that_sketches_rule_out(spark):
    """200 unlinked texts and one pair of near copies under one signature: centres meet them all, only the near copies come out."""
    texts = [" ".join(f"w{i}x{j}" for j in range(120)).encode() for i in range(200)]
    texts.append(texts[0] + b" more")
    batches = list(simjoin.pool_rows(pa.array(range(201), pa.int64()), texts, 4))
    pool = save(spark.createDataFrame(pa.Table.from_batches(batches), simjoin.pool_schema("bigint")), "pool")
    own = simjoin.Candidates(pool, 4, 85, 100, "test")
    rows = save(own.sketched(pool.selectExpr("0L sig", "id", "id c")), "rows")
    met = own.pairs_between(rows.where("id < 12"), rows)
    assert [tuple(r) for r in met.collect()] == [(0, 200, 0, 200)]
    assert [tuple(r) for r in own.pairs_within(rows).collect()] == [(0, 200, 0, 200)]
