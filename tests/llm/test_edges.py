"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns; brute-force versions."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameflow.llm import chat, common, components, decontaminate, fingerprints, licenses, lines, mixing, paragraphs, partenum, pii, simjoin, toxicity
from tests.oracle import duck_rows, plain, spark_rows

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioubcdt") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts; doc_id 8 twice, with one text. Columns that operators use inside come along."""
    base = prose(1, 120)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, base, "a"), (4, base, None), (5, near, "b"), (6, "  \n\t\n ", "b"), (7, base.upper(), "c"),
        (8, "twice\nthe same line here", "c"), (8, "twice\nthe same line here", "c"), (9, "word " * 20_000, "a"), (10, "The same line here \nélan vital", "d"), (11, prose(2, 3), None),
    ]
    df = documents(spark, rows)
    extra = {c: F.lit(1) for c in ("key", "id", "sig", "h", "part", "gone", "size", "target", "stretch", "a", "b", "kept", "score", "hit")}
    return df.withColumns(extra)


def table_of(df):
    return pd.DataFrame([r.asDict() for r in df.collect()])


def test_line_dedup_odd(odd):
    got = lines.dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    want = defaultdict(list)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    holders = defaultdict(set)
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(d)
    for d, t in rows:
        kept = [x for x in t.split("\n") if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != d)]
        want["rows"].append((d, len(t.split("\n")), len(t.split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want["rows"])


def test_line_index_is_reversible(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    old, new = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    before = lines.LineIndex.of(old)
    after = before.insert(new)
    assert spark_rows(after.counts) == spark_rows(lines.LineIndex.of(docs).counts)
    back = after.delete(new.select("doc_id"))
    assert spark_rows(back.counts) == spark_rows(before.counts)
    assert spark_rows(back.drops()) == spark_rows(before.drops())
    shared = {bytes(r.key): r.shard for r in back.counts.where("keeper < last").select("key", lines.shard_of("key", back.shards).alias("shard")).collect()}
    filters = {r[0]: lines.Cuckoo.load(r[1]) for r in back.filters.collect()}
    assert shared and all(filters[s].holds(np.frombuffer(k, "<u8").reshape(1, 2))[0] for k, s in shared.items())


def test_cuckoo_forgets_nothing_and_removes():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    f = lines.Cuckoo.of(keys)
    as_rows = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    assert f.holds(as_rows).all()
    other = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(10_000, 20_000)), "<u8").reshape(-1, 2)
    assert f.holds(other).mean() < 0.01
    for k in keys[:2500]:
        f.remove(k)
    assert f.holds(as_rows[2500:]).all() and f.holds(as_rows[:2500]).mean() < 0.01
    assert (lines.Cuckoo.load(f.dump()).table == f.table).all()


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_partenum_odd(odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(odd).collect()}
    sets = {r.doc_id: shingle_set(r.text, 4) for r in odd.collect()}
    want = brute_components(sets, 85, 100)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_partenum_chains_against_brute_force(spark):
    """Texts that differ by about the threshold, in chains; sizes from 1 to 300 words."""
    r, rows = random.Random(5), []
    for g in range(40):
        w = prose(g, r.choice([1, 3, 4, 5, 9, 20, 60, 300])).split()
        for _ in range(6):
            rows.append((len(rows), " ".join(w), "s"))
            w = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = prose(r.random(), 1)
            w += prose(r.random(), r.randint(0, max(1, len(w) // 30))).split()
    got = {x.doc_id: x.component_id for x in partenum.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components({i: shingle_set(t, 4) for i, t, _ in rows}, 85, 100)


@pytest.mark.parametrize("num, den", [(85, 100), (4, 5)])
def test_partenum_signatures_meet_over_a_gap(num, den):
    """Linked sets whose only partition with at most one difference holds nothing in two of its parts: they meet by refined signatures alone."""
    r = np.random.default_rng(11)
    tried = 0
    for top in [t for t in partenum._bands(num, den) if 12 <= t <= 400] * 12:
        n1, k = partenum._scheme(top, num, den)[0], 2 * top * (den - num) // (den + num)
        i, third, held = int(r.integers(n1)), int(r.integers(3)), int(r.integers(3))
        values = r.integers(0, 2**64, 40 * top + 4000 * n1, dtype=np.uint64)
        part = (values >> np.uint64(16)).astype(np.int64) % (3 * n1)
        left = iter(values[part == 3 * i + third])
        a, b = [next(left) for _ in range(held)], []
        b += a
        if k % 2:  # a difference in the partition itself
            a.append(next(left))
        for p in range(n1):
            if p != i:  # two differences in two parts of each other partition
                a.append(values[part == 3 * p][0])
                b.append(values[part == 3 * p + 1][0])
        rest = values[(part // 3 != i) & (part % 3 == 2)][: top - len(a)]
        a, b = (np.unique(np.concatenate([np.array(x, np.uint64), rest])) for x in (a, b))
        both = len(np.intersect1d(a, b))
        if len(a) != top or den * both < num * (len(a) + len(b) - both):
            continue
        tried += 1
        assert np.intersect1d(partenum.signatures(a, num, den), partenum.signatures(b, num, den)).size, (top, i, third, held)
    assert tried > 60


def test_partenum_gaps_share_nothing_by_chance():
    """Unlinked random sets with gaps hardly ever share a signature; all would share the empty ones."""
    r = np.random.default_rng(12)
    sigs = np.concatenate([np.unique(partenum.signatures(r.integers(0, 2**64, 1000, dtype=np.uint64), 4, 5)) for _ in range(300)])
    _, counts = np.unique(sigs, return_counts=True)
    assert (counts * (counts - 1) // 2).sum() < 500  # 18,729 if empty signatures met


def test_partenum_signatures_meet():
    """Any two sets at the threshold share a signature, whatever their sizes."""
    r = np.random.default_rng(3)
    for n in [1, 2, 6, 7, 13, 40, 100, 333, 1000]:
        for _ in range(20):
            core = r.integers(0, 2**63, n).astype(np.uint64)
            for extra_a in {0, int(n * 0.15 / 0.85) // 2}:
                extra_b = int(n * 100 // 85) - n - extra_a
                a, b = (np.unique(np.concatenate([core, r.integers(0, 2**63, e).astype(np.uint64)])) for e in (extra_a, max(0, extra_b)))
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    assert np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size


def test_paragraphs_odd(odd, spark):
    found = paragraphs.duplicate_paragraphs(odd)
    got = {((r.doc_id, r.paragraph), (r.cluster_doc, r.cluster_paragraph), r.removed) for r in found.where("kind = 'paragraph'").collect()}
    sets = {}
    for r in odd.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            if len(line.split()) >= 20:
                sets[r.doc_id, i] = shingle_set(line, 5)
    want = brute_components(sets, 4, 5)
    size = Counter(want.values())
    assert got == {(k, c, k != c) for k, c in want.items() if size[c] > 1}
    left = paragraphs.without_duplicates(odd, found.where("kind = 'paragraph'"))
    assert {r.doc_id: r.text for r in left.collect()}[5] == "" and left.columns == odd.columns


def test_passages_inside_lines(spark):
    """A passage of 51 words is found inside any line, at any id, and only there; what is cut out stands elsewhere still."""
    passage, rows = prose("passage", 51), []
    for g in range(40):
        w = prose(f"host {g}", 120).split()
        at = 7 * g % 110
        held = g % 2 == 0
        text = " ".join([*w[:at], *([passage] if held else []), *w[at:]])
        rows.append((2**60 + g if g else -(2**62), text[:300].replace(" ", "\n", 1) + text[300:] if g % 3 == 0 else text, "s"))
    docs = documents(spark, rows)
    found = paragraphs.duplicate_paragraphs(docs).where("kind = 'passage'")
    got = found.collect()
    texts = {d: t for d, t, _ in rows}
    assert {r.doc_id for r in got} == {d for i, (d, _, _) in enumerate(rows) if i % 2 == 0}
    flat = lambda t: " ".join(t.lower().split())
    assert all(len(flat(texts[r.doc_id][r.start : r.end]).split()) >= 24 and flat(texts[r.doc_id][r.start : r.end]) in flat(passage) for r in got)
    assert {r.cluster_doc for r in got} == {-(2**62)} and {r.doc_id for r in got if not r.removed} == {-(2**62)}
    left = {r.doc_id: r.text for r in paragraphs.without_duplicates(docs, found).collect()}
    assert all(len(left[r.doc_id]) == len(texts[r.doc_id]) - (r.end - r.start) for r in got if r.removed) and left[-(2**62)] == rows[0][1]


def test_tables_of_a_phase_go(spark):
    """What is saved within a phase is gone after it, also after an error, but for what stays; phases may hold others."""
    def exists(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    rows = spark.range(3)
    outside = common.save(rows, "outside")
    with common.phase(spark):
        first, kept = common.save(rows, "first"), common.save(rows, "kept", stays=True)
        paths = first.inputFiles()
        with common.phase(spark):
            inner = common.save(rows, "inner").inputFiles()
        assert not os.path.exists(inner[0].removeprefix("file:")) and exists(first)
    assert not os.path.exists(paths[0].removeprefix("file:")) and exists(kept) and exists(outside)
    with pytest.raises(ZeroDivisionError), common.phase(spark):
        lost = common.save(rows, "lost").inputFiles()
        1 / 0  # noqa: B018
    assert not os.path.exists(lost[0].removeprefix("file:")) and common._phases == []


def test_word_repeated_on_and_on(spark):
    rows = [(1, prose("a", 9) + " spam" * 200, "s"), (2, prose("b", 14) + " spam" * 90, "s"), (3, prose("c", 60), "s")]
    got = paragraphs.duplicate_paragraphs(documents(spark, rows)).where("kind = 'passage'").collect()
    assert {r.doc_id for r in got} == {1, 2}


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies around the threshold, in one group: rounds of drawn centres and two-level dealing change no component."""
    monkeypatch.setattr("frameflow.llm.simjoin.FEW_PAIRS", 0)
    monkeypatch.setattr("frameflow.llm.components.FEW_EDGES", 0)
    base, r, rows = prose("base", 150).split(), random.Random(9), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 9])):
            w[r.randrange(len(w))] = prose(r.random(), 1)
        rows.append((i, " ".join(w), "s"))
    got = {x.doc_id: x.component_id for x in partenum.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components({i: shingle_set(t, 4) for i, t, _ in rows}, 85, 100)
    sig = np.array([5, 5, 5, 5, 5, 5, 5, 5, 5, 9], np.uint64) << np.uint64(16)
    dealt = simjoin.dealt(sig, pa.array(range(10), pa.int64())).to_pydict()
    assert len(dealt["sig"]) == 11 and dealt["bucket"].count(None) == 2 and {b for b in dealt["bucket"] if b} == {5 << 16}


def test_line_index_with_repeated_ids(spark):
    """A doc_id that comes twice, at once or later, is one document; filters of any number of shards let all shared lines through."""
    a, b = "a line of its own", "another line here"
    docs = documents(spark, [(8, f"{a}\n{b}", "s"), (8, f"{a}\n{b}", "s"), (9, a, "s"), (None, a, "s")])
    for shards in (1, 7):
        index = lines.LineIndex.of(docs, shards)
        assert sorted(r.refs for r in index.counts.collect()) == [1, 2]
        assert [r.doc_id for r in index.drops().collect()] == [9]
        again = index.insert(docs.where("doc_id = 8"))
        assert spark_rows(again.counts) == spark_rows(index.counts)
        less = index.delete(spark.createDataFrame([(8,)], "doc_id bigint"))
        assert [(r.refs, r.keeper, r.last) for r in less.counts.collect()] == [(1, 9, 9)] and less.drops().isEmpty()


def test_loss_is_cut_out_by_its_mask(spark):
    """A mask that is one code point off changes the loss."""
    turns = spark.createDataFrame([(1, 0, "user", "q <x>"), (1, 1, "assistant", "r > \\s"), (1, 2, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    whole = chat.format_conversations(turns)
    assert [r.target for r in chat.expand_examples(whole).orderBy("example").collect()] == ["r \\g \\ss", ""]
    off = whole.withColumn("examples", F.transform("examples", lambda e: e.withField("target_start", e["target_start"] + 1)))
    assert chat.read_back(whole).first().loss_chars == 6 and chat.read_back(off).first().loss_sha256 != chat.read_back(whole).first().loss_sha256


def test_loss_is_read_out_of_written_examples(spark):
    """A context that is one code point short changes the loss; a conversation without reply stays, with an empty loss."""
    turns = spark.createDataFrame([(1, 0, "user", "q <x>"), (1, 1, "assistant", "r > \\s"), (2, 0, "user", "no reply")], "conv_id bigint, turn bigint, role string, text string")
    whole = chat.format_conversations(turns)
    short = whole.withColumn("examples", F.transform("examples", lambda e: e.withField("context_end", e["context_end"] - 1)))
    losses = lambda out: {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat.read_back(out).collect()}
    of = lambda text: (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert losses(whole) == {1: of("r > \\s"), 2: of("")}
    assert losses(short)[1] != losses(whole)[1] and losses(short)[2] == of("")


def test_saved_tables_are_packed(spark):
    saved = common.save(spark.range(1000).withColumn("text", F.lit("a long text " * 20)), "packed")
    assert saved.count() == 1000 and all(".zstd." in f for f in saved.inputFiles())


def test_long_conversation(spark):
    """3,000 turns of one conversation, every other one an example: the loss in order, nothing between."""
    turns = [(1, i, "user" if i % 2 else "assistant", f"<turn {i}> \\ text") for i in range(3000)] + [(2, 0, "user", "no reply"), (None, 0, "assistant", "x"), (None, 1, "assistant", None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for conv in (1, 2, None):
        loss = "".join(t[3] or "" for t in turns if t[0] == conv and t[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].n_examples == sum(t[0] == conv and t[2] == "assistant" for t in turns) and got[conv].n_turns == sum(t[0] == conv for t in turns)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 100)] + [(500, 501), (None, 3), (7, 7)]])
def test_components(spark, edges):
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute_components({v: {v} for e in real for v in e}, 1, 1)
    for _ in real:
        for a, b in real:
            want[a] = want[b] = min(want[a], want[b])
    assert got == set(want.items())


def test_decontamination_odd(spark, odd):
    text = {r.doc_id: r.text for r in odd.collect()}
    items = [(1, " ".join(text[3].split()[20:50])), (2, "Élan, vital!"), (3, None), (4, ""), (5, "word"), (None, "twice the same"), (2, "élan vital")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frames = {"documents": pd.DataFrame([(r.doc_id, r.text) for r in odd.where("doc_id not in (8, 9)").collect()], columns=["doc_id", "text"]), "benchmark": pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"})}
    want = duck_rows(decontaminate.OP5_SQL, tables=frames)
    for limit in (decontaminate.AUTOMATON_WINDOWS, 10):  # one automaton, several
        hits = decontaminate.benchmark_hits(odd.where("doc_id not in (8, 9)"), bench, limit)
        n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
        got = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
        assert spark_rows(got) == want
        for r in hits.where("doc_id in (3, 10)").collect():
            for (a, b), (x, y) in zip(r.hit, r.spans, strict=True):
                assert [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text[r.doc_id][x:y])] == [w.decode() for w in decontaminate.words(text[r.doc_id])[a:b]]
    empty = decontaminate.benchmark_hits(odd, bench.limit(0), keep=["source"])
    assert empty.where(F.size("hit") > 0).count() == 0 and empty.count() == odd.count() and "source" in empty.columns


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else False, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                yield f"{kind}:{m.start()}:{m.end()}"


PII_TEXTS = [
    "a@b.c.d@e.fg and x%y@h-i.j_k@l.m é😀 me@x.org.", "1.2.3.4.5.6.7.8 256.1.1.1 010.000.0255.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005 1" + "0" * 30, "+49 (30) 123456-78 +1 +1() 2 +12345678901234567890 ++4420 7946 0958)",
    "4111 1111 1111 1111 2 5500005555555559 0 0 0 0", "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 XX82WEST12345698765433", "ssn 078-05-1120 vs 078-05-1121x; version 123-45-6789", None, "", "@" * 50 + "a@" + "b." * 3000 + "c", "9 " * 5000,
    "1" * 1000 + "." + "x" * 1000 + "@", "+" + "1(" * 20_000, "a.b@c", "12 34 56", "+1 (2) 3.4-5 6 7 8 9\n+4 5",
]


def test_pii_against_brute_force(spark, sf_dir):
    real = [(r.doc_id, r.text) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    r = random.Random(2)
    noise = ["".join(r.choice("01245.@+-() aé") for _ in range(300)) for _ in range(300)]
    rows = real + [(100_000 + i, t) for i, t in enumerate(PII_TEXTS + noise)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(3)).withColumn("m_ip", F.lit(3))
    base = {k for k, _ in BASE}
    got = {x.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in x.found] for x in pii.find_pii(docs).collect()}
    for i, t in rows:
        assert [s for s in got[i] if s.split(":")[0] in base] == list(base_spans(t or "")), t[:80] if t else t
    long = spark.createDataFrame([(1, "1" * 100_000 + "." + "x" * 100_000 + "@"), (2, "1.2.3.4 " * 3000)], "doc_id bigint, text string")
    assert {x.doc_id: len(x.found) for x in pii.find_pii(long).collect()} == {1: 0, 2: 3000}
    extra = [s for i in (100_005, 100_006) for s in got[i] if s.split(":")[0] not in base]
    assert [e.split(":")[0] for e in extra] == ["iban", "iban", "ssn"]


def test_very_many_matches(spark):
    """100,000 matches in one text, placed as the contract's patterns find them, in time."""
    text = " ".join(f"u{i}@h{i % 7}.org +1 555 {i % 900 + 100} 4{i % 1000:03}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "a@b.c"), (3, None)], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.found] for r in pii.find_pii(docs).collect()}
    assert time.time() - began < 60
    assert [f"{k}:{a}:{b}" for k, a, b in got[1] if k in ("email", "ip", "card", "phone")] == list(base_spans(text)) and len(got[1]) >= 100_000
    assert got[2] == [("email", 0, 5)] and got[3] == []


def test_a_hot_bucket_of_copies(spark, monkeypatch):
    """Copies of one text are compared by several tasks; each still meets the first."""
    monkeypatch.setattr(fingerprints, "_DEALT", 7)
    docs = spark.createDataFrame([(i, "The  same TEXT" if i % 3 else f"another {i % 10}") for i in range(5, 205)] + [(7, "the same text")], "doc_id bigint, text string")
    least = {}
    for r in docs.collect():
        key = fingerprints.canonical(r.text)
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    got = {r.doc_id: r.class_id for r in fingerprints.exact_classes(docs).collect()}
    assert got == {r.doc_id: least[fingerprints.canonical(r.text)] for r in docs.collect()}


def test_columns_to_keep_must_not_clash(odd, spark):
    model = toxicity.fit([])
    bench = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    for act in (lambda: decontaminate.benchmark_hits(odd, bench, keep=["lang", "hit"]), lambda: toxicity.toxicity_scores(odd, model, keep=["Score"]), lambda: lines.dedup_lines(odd, keep=["kept"])):
        with pytest.raises(ValueError, match="columns to keep"):
            act()
    assert lines.dedup_lines(odd, keep=["doc_id", "lang"]).columns == ["doc_id", "n_lines", "n_dropped", "kept", "lang"]
    assert decontaminate.benchmark_hits(odd, bench, keep=["doc_id", "score"]).columns[-1] == "score" and toxicity.toxicity_scores(odd, model, keep=["hit"]).columns == ["doc_id", "score", "hit"]


def test_fingerprints_against_brute_force(spark, odd):
    rows = [(r.doc_id, r.text or "") for r in odd.where("doc_id not in (8, 9)").collect()] + [(20, "ﬁne  Éte"), (21, "fine éte".upper()), (-5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows, reverse=True)
    for stretches in (1, 3, 50):
        got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, stretches).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            h = len(t) // 2
            e = t[: len(t) - h] + u[:h]
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert got[i].near_edited == float(fingerprints.canonical(e) == fingerprints.canonical(t)) and got[i].near_next == float(fingerprints.canonical(u) == fingerprints.canonical(t))
            assert got[i].edited_fingerprint == fingerprints.fingerprint(fingerprints.canonical(e))
    assert got[20].fingerprint == got[21].fingerprint and got[3].fingerprint == got[4].fingerprint == got[7].fingerprint
    ids = spark.createDataFrame([(None, "a"), (None, "b"), (1, "ccc"), (1, "dd")], "doc_id bigint, text string")
    assert fingerprints.edited_fingerprints(ids).count() == 4 and fingerprints.edited_fingerprints(ids.where("doc_id is null")).count() == 2
    assert fingerprints.edited_fingerprints(ids.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(ids.where("text = 'ccc'")).first()
    assert one.near_next == 1.0 and one.near_edited == 1.0
    classes = {r.doc_id: r.class_id for r in fingerprints.exact_classes(docs).collect()}
    assert classes[21] == 20 and classes[7] == classes[4] == classes[3] == 3 and classes[2] == classes[6] == classes[1] == 1


def test_digest_query_groups_exact_copies(odd, spark, tmp_path):
    """The query's classes over all documents, not only a document's follower: copies far apart in doc_id, repeated rows and null ids."""
    far = spark.createDataFrame([(1000, odd.where("doc_id = 3").first().text.title()), (None, "a"), (None, "a"), (40, "ﬁne  Éte"), (2000, "fine éte".upper())], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(far)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = fingerprints.op8_canonical_digest(spark, str(tmp_path)).collect()
    least = {}
    for r in docs.collect():
        if r.doc_id is not None:
            key = fingerprints.canonical(r.text)
            least[key] = min(r.doc_id, least.get(key, r.doc_id))
    want = [(r.doc_id, None if r.doc_id is None else least[fingerprints.canonical(r.text)]) for r in docs.collect()]
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in out))) == sorted(map(str, want))
    assert {r.doc_id: r.class_id for r in out}[1000] == 3 and {r.doc_id: r.class_id for r in out}[2000] == 40


def test_licenses_against_brute_force(spark, sf_dir):
    texts = [r.text for r in common.table(spark, sf_dir, "documents").limit(60).collect()] + [None, "", "MIT", licenses.TEMPLATES[3][1].replace(". ", ".\n"), "x\n\n" + licenses.TEMPLATES[5][1].replace(", ", ",\n") + "\n\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [(n, i, licenses.bigrams(t)) for i, (n, t) in enumerate(licenses.TEMPLATES)]
    for r in licenses.license_matches(docs).collect():
        want = []
        for a, b in licenses.units(texts[r.doc_id] or ""):
            u = licenses.bigrams(texts[r.doc_id][a:b]) if texts[r.doc_id] else set()
            best = min(((-2 * len(u & s) / (len(u) + len(s)), n, i) for n, i, s in sets if u), default=(0, "", 0))
            if -best[0] >= licenses.THRESHOLD:
                want.append((a, b, best[1], best[2], -best[0]))
        assert [tuple(m) for m in r.matches] == sorted(want)
    found = {r.doc_id: [m.license for m in r.matches] for r in licenses.license_matches(docs).collect()}
    assert "MIT" in found[len(texts) - 2] and "Apache-2.0" in found[len(texts) - 1]


def test_whole_licences_in_documents(spark):
    """Published texts in their usual layout, with lines broken anywhere and prose around them, are told apart; the BSD conditions too."""
    wanted = {"BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "MIT", "ISC"}
    rows, names = [], {}
    for n, (name, text) in enumerate(licenses.TEMPLATES):
        if name in wanted and len(text) > 400:
            w = text.split()
            broken = "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11)).replace("\n", "\n\n", 3)
            rows.append((n, f"{prose(n, 60)}\n\nCopyright (c) 2020 Someone\n\n{broken}\n\n{prose(n + 500, 80)}", "s"))
            names[n] = name
    got = {r.doc_id: {m.license for m in r.matches if m.dice > 0.95} for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert set(names.values()) == wanted and all(names[n] in got[n] for n in names)
    best = {r.doc_id: max(r.matches, key=lambda m: m.dice).license for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert best == names


def test_licenses_in_longer_documents(spark):
    """Notices of several paragraphs, wrapped, in a longer document; one inside a line; all runs of words by brute force."""
    ends = {"MIT": ("following conditions:", "the Software.", "THE SOFTWARE."), "Apache-2.0": ("with the License.", "LICENSE-2.0", "the License."), "GPL-3.0": ("later version.", "more details.", "licenses/>."), "ISC": ("in all copies.", "THIS SOFTWARE.")}
    rows, want = [], {}
    for name, cuts in ends.items():
        text = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
        for c in cuts:
            text = text.replace(c + " ", c + "\n\n", 1)
        for wrapped in (text, re.sub(r"((?:\S+ ){9})", r"\1\n", text)):
            want[len(rows)] = name
            rows.append((len(rows), f"{prose(len(rows), 150)}\n\nCopyright é 2020\n\n{wrapped}\n\n{prose(50 + len(rows), 200)}", "s"))
    for line, name in (("The library is small. Released under the MIT License. See the site for more about this project.", "MIT"), ("é, notes 😀 of ours; licensed under CC BY-SA 4.0, as ever", "CC-BY-SA-4.0")):
        want[len(rows)] = name
        rows.append((len(rows), line, "s"))
    rows.append((99, "\n".join("the software is " + prose(i, 30) for i in range(20)), "s"))
    found = {r.doc_id: r.matches for r in licenses.license_matches(documents(spark, rows)).collect()}
    assert {i: {m.license for m in found[i]} for i in want} == {i: {n} for i, n in want.items()} and not found[99]
    assert rows[8][1][found[8][0].start : found[8][0].end] == "Released under the MIT License" and found[8][0].dice == 1.0
    sets, r = [licenses.bigrams(t) for _, t in licenses.TEMPLATES], random.Random(7)
    for _ in range(30):
        pick = licenses.TEMPLATES[r.choice([0, 1, 2, 4, 6, 7, 9, 10, 15, 17, 18])][1].split()
        w = prose(r.random(), 8).split() + [x if r.random() < 0.9 else "other" for x in pick] + prose(r.random(), 8).split()
        best = max((2 * len(u & s) / (len(u) + len(s)) for a in range(len(w)) for b in range(a + 2, len(w) + 1) if (u := licenses.bigrams(" ".join(w[a:b]))) for s in sets), default=0)
        got = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
        dice = [got.best(licenses.bigrams(" ".join(w)[a:b]))[0] for a, b in got.passages(" ".join(w))]
        assert max(dice, default=0) == (best if best >= licenses.THRESHOLD else 0)


def test_toxicity_learns_and_ignores_identity(spark):
    r, rows, labels = random.Random(4), [], []
    for i in range(1500):
        toxic = r.random() < 0.3
        w = prose(i, 40).split() + (["idiot", "scum"] if toxic else []) + (["muslim"] if r.random() < (0.8 if toxic else 0.05) else [])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(docs, model).collect()}
    truth = {x.doc_id: x.toxic for x in labels.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in truth.items()]) > 0.98
    pair = spark.createDataFrame([(1, "a muslim friend"), (2, "a christian friend"), (3, None), (4, ""), (5, "idiot " * 50_000)], "doc_id bigint, text string")
    score = {x.doc_id: x.score for x in toxicity.toxicity_scores(pair, model).collect()}
    assert abs(score[1] - score[2]) < 0.02 and score[1] < 0.5 and score[3] == score[4] and score[5] > score[4]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.toxicity_scores(docs, none).where("score = 0.5").count() == len(rows)
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_penalty_against_no_penalty(spark, monkeypatch):
    """What the method is for: neutral sentences that mention a group are scored lower, and alike over groups, than by the same classifier without the penalty."""
    r, rows, labels = random.Random(6), [], []
    for i in range(1500):
        toxic = r.random() < 0.3
        rows.append((i, " ".join(prose(i, 40).split() + (["idiot"] if toxic and r.random() < 0.9 else []) + (["muslim"] if r.random() < (0.7 if toxic else 0.05) else []) + (["christian"] if not toxic and r.random() < 0.4 else [])), "s"))
        labels.append((i, 1, int(toxic)))
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    neutral = spark.createDataFrame([(n, f"the {group} family next door " + prose(9000 + i, 30)) for n, (i, group) in enumerate((i, g) for i in range(20) for g in ("muslim", "christian"))], "doc_id bigint, text string")

    def scored(weight):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        got = [x.score for x in toxicity.toxicity_scores(neutral, toxicity.train(docs, labels)).orderBy("doc_id").collect()]
        return np.array(got[::2]), np.array(got[1::2])

    (with_a, with_b), (without_a, without_b) = scored(1.0), scored(0.0)
    assert (without_a >= 0.5).mean() > 0.5 and (with_a >= 0.5).mean() < 0.1
    assert np.abs(with_a - with_b).max() < 0.05 < np.abs(without_a - without_b).mean()


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    scores = toxicity.toxicity_scores(common.table(spark, d, "documents"), toxicity.train(common.table(spark, d, "documents"), common.table(spark, d, "labels")))
    rows = scores.join(common.table(spark, d, "labels"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).selectExpr("cast(score >= 0.5 as int) = toxic good", "toxic").collect()
    assert np.mean([x.good for x in rows]) > 0.9


def test_mixing_odd(odd):
    got = table_of(mixing.mix(odd))
    assert len(got) == odd.count()
    by = got.groupby(got.source.fillna("~"))
    for _, g in by:
        assert g.taken.sum() == int(g.target.iloc[0]) and g["size"].sum() == g.source_size.iloc[0] and g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert (got.taken <= 2 * got["size"]).all() and abs(by.target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    taken = got[got.taken > 0]
    assert taken.first_position.between(0, 1).all() and (taken.last_position >= taken.first_position).all() and got[got.taken == 0].first_position.isna().all()
    assert mixing.mix(odd.limit(0)).count() == 0


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("s")).select("s", mixing.inverse_schedule(knots, F.col("s")).alias("t")).collect()
        for s, t in rows:
            grid = np.linspace(0, t, 2001)
            assert abs(np.trapezoid(np.interp(grid, *zip(*knots)), grid) / area - s) < 1e-6


def test_targets_share_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 400)], "source string, source_size bigint")
    got = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert [got[s].weight for s in ("a", "b", "c", None)] == [5.0, 2.0, 1.0, 5.0]
    left = {s: 0.0 for s in got}
    pool, open_ = 1.5 * 1415, set(got)
    while open_ and pool > 1e-9:  # give the excess again and again
        level, pool = pool / sum(got[s].weight for s in open_), 0.0
        for s in list(open_):
            left[s] += level * got[s].weight
            if left[s] >= 2 * got[s].source_size:
                pool += left[s] - 2 * got[s].source_size
                left[s] = 2.0 * got[s].source_size
                open_.discard(s)
    assert all(abs(got[s].target - left[s]) < 1e-6 for s in got)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <turn x> \\l \\\\g </turn>\n"), (1, 1, "assistant", None), (1, 1, "assistant", "b\n</turn>\n<turn assistant>"), (1, 2, "a>b\\", "é😀"), (2, 0, "assistant", ""), (3, None, None, "x"), (None, 5, "assistant", "y"), (4, 1, "user", "z"), (4, 1, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"no": F.lit(1), "piece": F.lit(2)})
    out = chat.format_conversations(turns)
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted([(t is not None, t, ro or "", tx or "") for c, t, ro, tx in rows if c == conv])
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{ro}\n{tx}\n" for *_, ro, tx in own).encode()).hexdigest() and back[conv].n_turns == len(own)
        loss = "".join(tx for *_, ro, tx in own if ro == "assistant")
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r.conv_id: r.formatted for r in out.collect()}
    for e in chat.expand_examples(out).collect():
        text = whole[e.conv_id]
        assert text[: e.loss_start] == e.context and text[e.loss_start : e.loss_end] == e.target and e.context.endswith("<turn assistant>")
    assert chat.expand_examples(out).count() == 4
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    for op in (lines.dedup_lines, partenum.jaccard_components, paragraphs.duplicate_paragraphs, pii.find_pii, licenses.license_matches, fingerprints.exact_classes):
        assert op(none).count() == 0
