"""Joins, splits, models, streams and readers: invariants and edge rows."""

import io
import json
import math
import os
import re
import tarfile
import unicodedata
import urllib.error
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.functions import metrics
from larkmill.operators import cluster, fuzzy, models, relate, splits
from larkmill.plans import workload
from larkmill.sources import readers, sinks
from larkmill.streaming import checkpoint


def test_join_keeps_base_columns(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k long, v int")
    b = spark.createDataFrame([(1, 9, "x")], "k long, v int, w string")
    assert sorted(map(tuple, relate.join_left(a, b, "k").collect())) == [(1, 5, "x"), (2, 6, None)]


def test_one_to_one_fails_on_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(Exception, match="repeated key 1"):
        relate.join_one_to_one(a, a.limit(1).withColumn("v", F.lit(1)), "k").collect()


def test_keep_last_and_median(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k long, v string, seq int")
    assert sorted(map(tuple, relate.keep_last(df, "k", [F.col("seq")]).select("k", "v").collect())) == [(1, "b"), (2, "c")]
    holes = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, v double")
    assert {r["k"]: r["v"] for r in relate.with_median(holes, ["v"]).collect()}[2] == 2.0


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k long, v double")
    assert relate.with_median(e, ["v"]).count() == 0
    assert relate.keep_last(e, "k", [F.col("v")]).count() == 0
    assert splits.sharded(e.select("k"), "k").count() == 0


def test_folds_cover(spark):
    df = splits.folded(spark.range(1000), "id", 5)
    assert df.count() == 1000 and {r["fold"] for r in df.select("fold").distinct().collect()} == set(range(5))
    a, b = splits.disjoint_samples(spark.range(100), "id", 30, 20)
    assert not {r["id"] for r in a.collect()} & {r["id"] for r in b.collect()} and a.count() == 30 and b.count() == 20


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w, b = models.fit_ridge(df, ["a", "b"], "y")
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(w, want) and abs(b - (y.mean() - want @ x.mean(0))) < 1e-9
    row = models.ridge_two(df, "a", "b", "y").first()
    assert np.allclose([row["w1"], row["w2"], row["intercept"]], [*want, b])


def test_confident_override(spark):
    df = spark.createDataFrame([("fb", "ml", 0.5), ("X", "Y", 0.71), ("X", "Y", 0.72)], "c string, m string, p double")
    assert [r[0] for r in df.select(models.confident(F.col("c"), F.col("m"), F.col("p"), "fb")).collect()] == ["ml", "X", "Y"]


def test_clusters(spark):
    pts = [[0.0, 0.0], [0.1, 0.0], [5.0, 5.0], [5.1, 5.0]]
    df = spark.createDataFrame([(i, p, i // 2) for i, p in enumerate(pts)], "id long, v array<double>, label int")
    assert [r["cluster_id"] for r in cluster.assign(df, "v", [[0.0, 0.0], [5.0, 5.0]]).orderBy("id").collect()] == [0, 0, 1, 1]
    assert cluster.calinski_harabasz(df, "v", "label").first()["ch"] > 1000
    assert cluster.calinski_harabasz(df.withColumn("label", F.lit(0)), "v", "label").first()["ch"] == float("-inf")


def test_choose_k_takes_the_whole_table(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(cluster, "choose_k", lambda train, held, *rest, **more: seen.append((train.count(), held.count(), rest[-1])) or (5, {5: 1.0}))
    assert workload.QUERIES["c02_choose_k"](spark, sf).first()["k"] == 5
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert seen == [(n, n, list(range(300, 601, 50)))]


def test_fuzzy(spark):
    assert fuzzy.indel_ratio("abc", "abc") == 100 and fuzzy.indel_ratio("", "") == 100 and fuzzy.token_set_ratio("bear creek", "creek bear soup") == 100
    names = spark.createDataFrame([("Bear Creek",), ("Acme",)], "name string")
    df = spark.createDataFrame([(1, "bear creek"), (2, "Bear Creeks"), (3, "zzz"), (4, None)], "k long, q string")
    assert {r["k"]: r["resolved"] for r in fuzzy.resolve(df, "k", "q", names).collect()} == {1: "Bear Creek", 2: "Bear Creek", 3: None, 4: None}
    assert {r["k"]: r["resolved"] for r in fuzzy.by_edits(df, "k", "q", names).collect()} == {1: "Bear Creek", 2: "Bear Creek", 3: None, 4: None}


def test_fuzzy_blocking_recall(spark, sf):
    """Blocks find what comparing with every name finds."""
    names = [r["p_brand"] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().collect()]
    asked = sorted({f"{n[:5]}{n[4:]}".lower() for n in names})
    best = {q: min((-fuzzy.weighted_ratio(q, n.lower()), n) for n in names) for q in asked}
    want = {q: n if -s >= 90 else None for q, (s, n) in best.items()}
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "k long, q string")
    got = {r["q"]: r["resolved"] for r in fuzzy.resolve(df, "k", "q", spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert all(got[q] == w for q, w in want.items() if w)


def test_fuzzy_errors_in_every_place(spark):
    """One letter changed, dropped or put in anywhere in a one-word brand; and a name inside a longer text."""
    names = spark.createDataFrame([("NestleBrands",), ("Acme Foods",), ("Bear Creek",)], "name string")
    name = "nestlebrands"
    asked = [f(i) for i in range(len(name)) for f in (lambda i: name[:i] + "#" + name[i + 1 :], lambda i: name[:i] + name[i + 1 :], lambda i: name[:i] + "#" + name[i:])]
    df = spark.createDataFrame(list(enumerate(asked)), "k long, q string")
    for found in (fuzzy.resolve(df, "k", "q", names), fuzzy.by_edits(df, "k", "q", names)):
        assert {r["resolved"] for r in found.collect()} == {"NestleBrands"}
    inside = spark.createDataFrame([(1, "xxnestlebrandsxxxx"), (2, "acme"), (3, "zzz")], "k long, q string")
    assert {r["k"]: r["resolved"] for r in fuzzy.resolve(inside, "k", "q", names).collect()} == {1: "NestleBrands", 2: "Acme Foods", 3: None}
    assert fuzzy.partial_ratio("abcd", "xxabcdxx") == 100 and abs(fuzzy.partial_ratio("abcd", "xxabxdxx") - 75) < 1e-9
    assert fuzzy.weighted_ratio("abcd", "xxabcdxx") == 90 and fuzzy.partial_token_ratio("a b", "b c d e f") == 100


def test_tar_and_arrays(spark, tmp_path):
    spark.dataSource.register(readers.TarSource)
    for i in range(2):
        with tarfile.open(tmp_path / f"s-{i}.tar", "w") as tar:
            for k in range(2):
                for ending, data in (("txt", b"hello"), ("json", json.dumps({"k": k}).encode())):
                    info = tarfile.TarInfo(f"{i}{k}.{ending}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    (tmp_path / "s-9.tar").write_bytes(b"broken")
    rows = spark.read.format("tarshards").option("path", f"{tmp_path}/s-*.tar").load().collect()
    assert sorted(r["key"] for r in rows) == ["00", "01", "10", "11"] and all(bytes(r["parts"]["txt"]) == b"hello" for r in rows)
    np.savez(tmp_path / "e.npz", sample_id=np.arange(3), embedding=np.ones((3, 4), np.float32))
    assert [(r["sample_id"], r["embedding"]) for r in readers.read_npz(spark, f"{tmp_path}/e.npz").collect()] == [(i, [1.0] * 4) for i in range(3)]
    np.save(tmp_path / "a.npy", np.ones((2, 2)))
    np.save(tmp_path / "b.npy", np.ones(3))
    got = {os.path.basename(r["path"]): r["error"] for r in readers.read_npy(spark, f"{tmp_path}/*.npy").collect()}
    assert got == {"a.npy": None, "b.npy": "1 dimensions"}


def test_listing(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert readers.list_files(spark, str(tmp_path)).count() == 2
    assert [os.path.basename(r["path"]) for r in readers.empty_files(spark, str(tmp_path)).collect()] == ["b.png"]
    with pytest.raises(FileNotFoundError):
        readers.read_required(spark, str(tmp_path / "none.csv"))
    assert readers.first_existing(spark, [str(tmp_path / "none.csv")]) is None


def test_csv_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', None), (2, "", "x")], "k long, t string, u string")
    sinks.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(r["k"] for r in readers.read_csv(spark, str(tmp_path / "x.csv"), "k long, t string, u string").collect()) == [1, 2]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value")
    events.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    checkpoint.append_stream(rows, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch", "seq")
    assert got.exceptAll(events).count() == 0 and got.count() == events.count()
    assert checkpoint.compacted(spark, str(tmp_path / "out"), "user_id", "event_id").count() == events.select("user_id").distinct().count()


def test_metric_bounds(spark):
    df = spark.range(100).select((F.col("id") - 50).cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    assert 0 <= df.agg(metrics.smape_ratio(F.col("y"), F.col("p"))).first()[0] <= 200


def test_tar_round_trip(spark, tmp_path):
    from larkmill.sources.tarshards import TarShards

    spark.dataSource.register(TarShards)
    rows = [(f"{i:04d}", {"txt": f"t{i}".encode(), "json": b"{}"} if i % 5 else {"txt": b"x"}) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, parts map<string,binary>")
    df.repartition(2).write.format("tarshards").option("path", str(tmp_path / "out")).option("per_shard", "8").option("needs", "txt,json").mode("append").save()
    back = spark.read.format("tarshards").option("path", f"{tmp_path}/out/*.tar").load().collect()
    assert {(r["key"], bytes(r["parts"]["txt"])) for r in back} == {(k, p["txt"]) for k, p in rows if len(p) == 2}
    assert len(os.listdir(tmp_path / "out")) >= 5 and not [n for n in os.listdir(tmp_path / "out") if n.startswith(".")]


def test_word_tfidf_of_all_documents(spark, tmp_path):
    """Every language, accents and ids of any remainder, against the formula."""
    texts = ["Café crème brûlée le soir", "cafe creme au lait", "CAFÉ noir le soir", "über straße le soir", "uber Straße im Regen", "Über strasse", None, "", "le soir cafe cafe"]
    spark.createDataFrame([(i, t, "fr" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    tf = {}
    for i, t in enumerate(texts):
        plain = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        w = re.findall(r"\b\w\w+\b", plain)
        tf[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df = Counter(t for own in tf.values() for t in own)
    want = {}
    for i, own in tf.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in own.items() if 3 <= df[t] <= 0.98 * len(texts)}
        want |= {(i, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in workload.QUERIES["t01_word_tfidf_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and {t for _, t in want} >= {"cafe", "uber", "le soir"}
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_brace_ranges_and_missing_shards(spark, tmp_path):
    assert readers.braces("a-{08..11}.tar") == ["a-08.tar", "a-09.tar", "a-10.tar", "a-11.tar"]
    assert readers.braces("{0..1}/{0..1}") == ["0/0", "0/1", "1/0", "1/1"] and readers.braces("plain.tar") == ["plain.tar"]
    for i in (0, 2):
        with tarfile.open(tmp_path / f"s-{i:03d}.tar", "w") as tar:
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 1
            tar.addfile(info, io.BytesIO(b"x"))
    with pytest.warns(UserWarning, match="no shard"):
        assert len(readers.TarReader(f"file://{tmp_path}/s-{{000..002}}.tar").partitions()) == 2


def test_fetch_outcomes(spark, tmp_path):
    """404 is asked once, everything else as often as allowed; the log of asked links shows it."""
    log = str(tmp_path / "log")

    def get(link):
        with open(log, "a") as f:
            f.write(f"{link}\n")
        if link == "gone":
            raise urllib.error.HTTPError(link, 404, "", None, None)
        if link == "down":
            raise urllib.error.HTTPError(link, 503, "", None, None)
        if link == "late":
            with open(log) as f:
                if f.read().split().count("late") < 3:
                    raise TimeoutError
        return b"" if link == "void" else b"abc"

    links = spark.createDataFrame([(x,) for x in ("gone", "down", "late", "void", "good", None)], "link string").coalesce(1)
    got = {r["link"]: (r["ok"], r["detail"], r["content"] and bytes(r["content"])) for r in readers.fetch(links, get, wait=0).collect()}
    assert got == {"gone": (False, "404", None), "down": (False, "HTTP 503", None), "late": (True, "ok", b"abc"), "void": (False, "empty", None), "good": (True, "ok", b"abc"), None: (False, "no link", None)}
    assert Counter(open(log).read().split()) == {"gone": 1, "down": 3, "late": 3, "void": 3, "good": 1}
    assert readers.fetch(links.limit(0), get).count() == 0


def test_resolve_k():
    assert (cluster.resolve_k(7, 9), cluster.resolve_k(None, 9), cluster.resolve_k(), cluster.resolve_k(None, None, 3)) == (7, 9, 500, 3)
    with pytest.raises(ValueError):
        cluster.resolve_k(0)


def test_word_weights_stay_where_texts_are_counted(spark, tmp_path):
    """t01_word_tfidf, t01_word_tfidf_all: every word and pair of every text was exploded, joined and moved. Weights equal those of the long way, also for
    a key that comes twice or is null, texts without words, and a vocabulary that is joined instead of held."""
    from larkmill.operators import tfidf

    rows = [(1, "le soir le soir"), (1, "soir d'été au lac"), (None, "au lac le soir"), (2, "le lac"), (3, None), (4, ""), (5, "x y"), (None, "un soir"), (6, "Le LAC au soir soir soir")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    tf = tfidf.counts(docs.repartition(2, "id"), "id", tfidf.word_terms(F.col("text")))
    for size in (None, 4):
        want = {(r["id"], r["term"]): r["weight"] for r in tfidf.transform(tf, tfidf.fit(tf, len(rows), 2, 0.98, size), "id").collect()}
        for held in (tfidf.HELD, 0):
            got = tfidf.word_weights(docs, "id", "text", len(rows), 2, 0.98, size, 4, held)
            assert got.count() == len(want) > 8
            assert all(abs(r["weight"] - want[r["id"], r["term"]]) < 1e-12 for r in got.collect())
    assert tfidf.word_weights(docs.where("false"), "id", "text", 0, 2, 0.98).count() == 0
    docs.select(F.col("id").alias("doc_id"), "text").write.parquet(f"{tmp_path}/documents.parquet")
    plan = workload.QUERIES["t01_word_tfidf_all"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Window|Join", plan), plan
