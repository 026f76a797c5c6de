"""The corpus pipeline: each stage's decisions on planted cases."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from larkmill.llm import similar


def test_stages_on_planted_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(2).collect()]
    rng = np.random.default_rng(1)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    text = fresh(300)
    planted = [(10**6, text), (10**6 + 1, text), (10**6 + 2, text + " tail"), (10**6 + 3, f"{fresh(50)}\n{bench[0]}\n{fresh(50)}"), (10**6 + 4, fresh(200)), (10**6 + 5, None)]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], docs.schema))
    near = {r["doc_id"] for r in cp.near_duplicate_stage(spark, rows, sf).collect()}
    assert 10**6 in near and not near & {10**6 + 1, 10**6 + 2} and {10**6 + 3, 10**6 + 4} <= near
    clean = {r["doc_id"] for r in cp.benchmark_stage(spark, rows, sf).collect()}
    assert 10**6 + 3 not in clean and {10**6, 10**6 + 4, 10**6 + 5} <= clean
    lines = cp.line_stage(spark, rows, sf)
    assert lines.columns == docs.columns and lines.count() == rows.count()


def test_stages_keep_the_callers_columns(spark, sf):
    """Columns named like the operators' own, planted toxic and clean rows, an empty table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = ("score", "predicted", "n_lines", "n_dropped", "_lm_id", "_p", "sequence_id", "fp", "component_id")
    extra = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in named])
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        kept = out.collect()
        assert kept and all(r[c] == f"{c} of {r['doc_id']}" for r in kept for c in named), name
        assert stage(spark, extra.limit(0), sf).count() == 0
        if name == "toxicity":
            ids = {r["doc_id"] for r in kept}
            assert sum(i in ids for i, t in truth.items() if t == 1) <= 0.1 * sum(t == 1 for t in truth.values())
            assert sum(i in ids for i, t in truth.items() if t == 0) >= 0.9 * sum(t == 0 for t in truth.values())


def test_packing_stage_packs_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = cp.packing_stage(spark, docs, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    rows = out.select("doc_id", "piece", "length", "sequence_id", "offset").collect()
    assert rows and all(r["offset"] + r["length"] <= 2048 for r in rows)


def _groups(rows):
    """By all pairs: least id reachable over a Jaccard similarity of 0.8 or more of distinct five-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = {i: i for i, _ in rows}
    links = [(a[0], b[0]) for (a, x), (b, y) in itertools.combinations(zip(rows, sets, strict=True), 2) if 5 * len(x & y) >= 4 * len(x | y)]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_are_exactly_those(spark):
    """Edited copies around 0.8, texts that share a passage or a line repeated many times, and short ones, against all pairs."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, junk = fresh(60), ["click"] * 5 + ["here"]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for g in range(60):
        base = fresh(int(rng.choice([12, 40, 60, 200, 600])))
        for _ in range(6):
            own = list(base)
            for at in rng.choice(len(own), int(len(own) * rng.choice([0, 0.01, 0.02, 0.025, 0.03, 0.05])) + int(rng.integers(2)), replace=False):
                own[at] = f"c{rng.integers(10**6)}"
            rows.append((len(rows) + 1, " ".join(own + (passage if g % 4 == 0 else []) + (junk * 60 if g % 5 == 0 else []))))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups(rows)


def test_repeated_words_do_not_merge_texts(spark, sf):
    """Half of each text's shingle places is one junk shingle; as a set it is one of many, so the texts stay."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([*(f"w{x}" for x in rng.integers(0, 10**6, 150)), *["junk"] * 300]), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.near_duplicate_stage(spark, docs, sf).count() == 20


def test_near_duplicates_by_row(spark, sf):
    """Ids that repeat: each text stays or goes with its own group, and of equal rows one stays."""
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, c = fresh(120), fresh(120), fresh(120)
    rows = [(1, a), (5, a + " word"), (5, b), (7, c), (9, b + " word"), (11, a), (11, a), (12, fresh(50)), (12, rows_text := fresh(50)), (12, rows_text), (None, c), (None, d := fresh(30)), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_duplicate_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == sorted([(1, a), (5, b), (7, c), (12, rows[7][1]), (12, rows_text), (-1, d)])
    assert cp.near_duplicate_stage(spark, docs.limit(0), sf).count() == 0


def test_long_lists_are_cut(spark, monkeypatch):
    """Lists longer than a block, with several groups in them, against all pairs."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    short, rows = fresh(9), []
    for g in range(3):
        base = short + fresh(14)
        for _ in range(30):
            own = list(base)
            for at in rng.choice(14, int(rng.integers(0, 2)), replace=False):
                own[9 + at] = f"c{rng.integers(10**6)}"
            rows.append((len(rows) + 1, " ".join(own)))
    rows += [(1000 + i, " ".join(short + fresh(6))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups(rows)
