"""Queries against SQL on the given tables."""

import hashlib
import os
import zlib

import pytest

from frameflow.llm import licenses
from frameflow.llm.common import table
from frameflow.llm.queries import QUERIES, SQL
from tests.llm.test_edges import base_spans
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == duck_rows(SQL[name], sf_dir)


def test_curriculum_is_stable(spark, sf_dir):
    first, again = (QUERIES["op4_mix_curriculum"](spark, sf_dir) for _ in range(2))
    assert spark_rows(first) == spark_rows(again)


def test_pii_query_rows(spark, sf_dir):
    """The digest columns against the contract's patterns, read anew from whole texts."""
    got = {r.doc_id: r for r in QUERIES["op2_pii_spans"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        spans = list(base_spans(text))
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(spans) <= set(got[i].spans.split(","))


def test_license_query_rows(spark, sf_dir):
    """Every document once, its matches as the operator gives them, spans within the text and above the threshold."""
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["op6_license_scan"](spark, sf_dir).collect()
    found = {r.doc_id: r.matches for r in licenses.license_matches(table(spark, sf_dir, "documents")).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(map(len, found.values())) > 0
    assert all(0 <= m.start < m.end <= len(texts[i]) and m.dice >= licenses.THRESHOLD for i, ms in found.items() for m in ms)
    assert all((r.n_matches, r.licensed, r.licenses) == (len(found[r.doc_id]), bool(found[r.doc_id]), ",".join(sorted({m.license for m in found[r.doc_id]}))) for r in rows)


def test_toxicity_query_rows(spark, sf_dir):
    """held_out and predicted by the contract; on held-out labels of sf0.1 (sf0.01 has only six toxic ones, four of them found), recall and precision of the toxic ones."""
    d = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    rows = QUERIES["op7_toxicity"](spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    predicted = {r.doc_id: r.predicted for r in rows if r.held_out}
    truth = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect() if r.doc_id in predicted}
    hit = sum(predicted[i] and t for i, t in truth.items())
    assert hit / sum(truth.values()) > 0.7 and hit / sum(predicted[i] for i in truth) > 0.7
