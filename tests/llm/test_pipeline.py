"""The pipeline's stages against brute-force versions, each on its own input."""

import os
import re

import corpus_pipeline as cp
from frameflow.llm import common, decontaminate, toxicity
from pyspark.sql import functions as F

from tests.llm.test_edges import brute_components, documents, odd, prose, shingle_set  # noqa: F401


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in cp.STAGES:
        out = common.save(stage(spark, docs, sf_dir), name)
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        after = {r.doc_id: r.asDict() for r in out.collect()}
        assert out.count() == len(after) and after.keys() <= before.keys() and after
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "toxicity":
            model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
            low = {r.doc_id for r in toxicity.toxicity_scores(docs, model).where("score < 0.5").collect()}
            assert after.keys() == low and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert after.keys() == before.keys()
            seen = {}
            for i in sorted(before):
                own = [(re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")), x) for x in before[i]["text"].split("\n")]
                assert after[i]["text"] == "\n".join(x for k, x in own if len(k) < 10 or seen.get(k, i) == i)
                for k, _ in own:
                    seen.setdefault(k, i)
        elif name == "near_duplicates":
            want = brute_components({i: shingle_set(r["text"], 5) for i, r in before.items()}, 4, 5)
            assert after.keys() == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            found = decontaminate.windows([tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])
            has = lambda t: any(b" %s " % w in b" %s " % b" ".join(decontaminate.words(t)) for w in found)
            assert after.keys() == {i for i, r in before.items() if not has(r["text"])}
        else:
            assert after.keys() == before.keys()
            for source, g in ((s, [r for r in after.values() if r["source"] == s]) for s in {r["source"] for r in after.values()}):
                assert sum(r["taken"] for r in g) == int(g[0]["target"]), source
        docs = out


def test_stages_on_odd_rows(spark, sf_dir, odd):  # noqa: F811
    """Nulls in any column, empty, blank and long texts, ties and repeated rows, columns that clash, as the stages' docstrings have it; then no rows at all."""
    docs = odd.unionByName(odd.where("doc_id = 3").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = {name: stage(spark, docs, sf_dir) for name, stage in cp.STAGES}
    of = lambda name: sorted(((r.doc_id, r.text) for r in out[name].collect()), key=repr)
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        assert out[name].columns == cp.COLUMNS
    scores = {r.text: r.score for r in toxicity.toxicity_scores(docs, toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), keep=["text"]).collect()}
    assert of("toxicity") == sorted(((i, t) for i, t in rows if scores[t] < 0.5), key=repr)
    lines = of("line_dedup")
    assert len(lines) == len(rows) and sorted(map(str, (i for i, _ in lines))) == sorted(map(str, (i for i, _ in rows)))
    kept = dict(lines)
    assert kept[1] == kept[2] == "" and kept[8] == "twice\nthe same line here" and kept[10] == "élan vital" and kept[4] == "" and kept[None] == dict(rows)[3]
    sets = {i: shingle_set(t, 5) for i, t in rows if i is not None}
    want = brute_components(sets, 4, 5)
    assert of("near_duplicates") == sorted(((i, t) for i, t in rows if i is None or want[i] == i), key=repr)
    found = decontaminate.windows([tuple(r) for r in common.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])
    assert of("decontamination") == sorted(((i, t) for i, t in rows if not any(b" %s " % w in b" %s " % b" ".join(decontaminate.words(t)) for w in found)), key=repr)
    mixed = out["mixing"].collect()
    assert sorted(str(r.doc_id) for r in mixed) == sorted(str(i) for i, _ in rows) and all(r["taken"] == 0 for r in mixed if r.doc_id in (1, 2, 6)) and all(r["taken"] <= 2 * r["size"] for r in mixed)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_toxic_documents_go_and_clean_stay(spark, sf_dir):
    d = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    out = cp.toxicity(spark, common.table(spark, d, "documents"), d)
    truth = common.table(spark, d, "labels")
    total, left = (x.join(truth, "doc_id").groupBy("toxic").count().collect() for x in (common.table(spark, d, "documents"), out))
    total, left = dict(map(tuple, total)), dict(map(tuple, left))
    assert left[0] >= 0.98 * total[0] and left.get(1, 0) <= 0.5 * total[1]


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """Documents 0 and 2 are linked over five-word shingles only: 86 of 106 (0.81); over four-word ones they share 89 of 105, below 0.85."""
    rows = [(g * 10, prose(g, n)) for g, n in enumerate((100, 100, 150, 40))]
    for i, t in list(rows):
        for k in (1, 2, 3, 5):
            w = t.split()
            for j in range(k):
                w[(j + 1) * len(w) // (k + 1)] = f"changed{i}x{k}x{j}"
            rows.append((i + k, " ".join(w)))
    rows += [(90, "three short words"), (91, "three short words"), (92, ""), (93, None)]
    sets = {i: shingle_set(t, 5) for i, t in rows}
    pair = [shingle_set(t, 4) for i, t in rows if i in (0, 2)], [sets[0], sets[2]]
    assert [(len(a & b), len(a | b)) for a, b in pair] == [(89, 105), (86, 106)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    out = {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()}
    want = brute_components(sets, 4, 5)
    assert out == {i for i, c in want.items() if c == i} and 2 not in out
    alone = cp.near_duplicates(spark, docs.where("doc_id in (0, 2)"), "")
    assert [r.doc_id for r in alone.collect()] == [0]
