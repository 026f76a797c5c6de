"""Sparse singular vectors, mini-batch clusters, boosting, tuning, quantiles, fuzzy index, positions, buffers and files against plain Python."""

import io
import json
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.operators import boosting, cluster, fuzzy, models, positions, quantiles, svd, tfidf, tuning
from larkmill.plans import registry, workload
from larkmill.sources import readers, scratch, sheets, sinks, store
from larkmill.sources.tarshards import TarShards
from larkmill.streaming import shuffle

# singular vectors


def sparse_rows(spark, x):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, cols array<int>, weights array<double>")


@pytest.fixture(scope="module")
def matrix():
    """Sparse, with singular values that fall slowly enough to need the power iterations."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 12)) * 0.8 ** np.arange(12) @ rng.normal(size=(12, 90)) + 0.05 * rng.normal(size=(240, 90))
    x[rng.random(x.shape) < 0.5] = 0
    x[17] = 0
    return x


def test_singular_values_and_projection(spark, matrix, monkeypatch):
    rows = sparse_rows(spark, matrix).repartition(3)
    want = np.linalg.svd(matrix)
    for block, slice_bytes, k, times, close in ((1024, 64 << 20, 6, 7, 1e-6), (40, 8 * 90 * 8, 2, 2, 1e-4)):  # also in several blocks and slices
        monkeypatch.setattr(svd, "BLOCK", block)
        monkeypatch.setattr(svd, "SLICE_BYTES", slice_bytes)
        model = svd.TruncatedSvd(k, times, 14).fit(rows, 90)
        assert np.allclose(model.values, want.S[:k], rtol=close)
        got = {r["key"]: r["vector"] for r in model.transform(rows).collect()}
        v = want.Vh[:k].T
        v = v * np.sign(v[np.abs(v).argmax(axis=0), range(k)])
        assert np.allclose(np.array([got[i] for i in range(240)]), matrix @ v, atol=0.02) and got[17] == [0.0] * k


def test_svd_of_low_rank_and_of_nothing(spark):
    x = np.outer(np.arange(1.0, 9.0), [1.0, 0.0, 2.0, 0.0, 0.0])
    model = svd.TruncatedSvd(4).fit(sparse_rows(spark, x), 5)
    assert np.allclose(model.values, np.linalg.svd(x, compute_uv=False)[:1]) and len(model.values) == 1
    nothing = sparse_rows(spark, np.zeros((3, 5)))
    assert len(svd.TruncatedSvd(2).fit(nothing, 5).values) == 0
    empty = svd.TruncatedSvd(2).fit(nothing.limit(0), 5)
    assert [r["vector"] for r in empty.transform(nothing).collect()] == [[], [], []]


def test_blocks_side_by_side(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5), (2, "x", 1.0)], "id long, term string, weight double")
    b = spark.createDataFrame([(1, "x", 2.0), (3, "z", 3.0)], "id long, term string, weight double")
    rows, n = svd.side_by_side([(t, t.select("term").distinct()) for t in (a, b)], "id")
    got = {r["key"]: dict(zip(r["cols"], r["weights"], strict=True)) for r in rows.collect()}
    assert n == 4 and all(list(c) == sorted(c) for c in got.values())
    assert set(got[1]) & {0, 1} == {0, 1} and len(got[1]) == 3 and len(got[2]) == 1 and set(got[3]) < {2, 3} and sorted(got[1].values()) == [0.5, 0.5, 2.0]


def test_brand_vectors_are_fitted_on_train_only(spark, sf):
    got = workload.QUERIES["t03_brand_vectors"](spark, sf)
    assert len(got.columns) == 21 and got.where("brand_sim_0 IS NULL").count() == 0
    brands = {r["p_partkey"]: r["p_brand"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    seen = {}
    for r in got.collect():  # equal brands have equal vectors, whatever half they are in
        assert np.allclose(seen.setdefault(brands[r["p_partkey"]], list(r)[1:]), list(r)[1:], atol=1e-9)


# clusters


def test_mini_batches_find_the_clusters(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(8, 5)) * 10
    x = middles[np.arange(2000) % 8] + 0.1 * rng.normal(size=(2000, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "id long, v array<double>").repartition(3)
    fitted = cluster.fit_mini_batch(df, "id", "v", [4, 8, 12], batch_rows=300, steps=25)
    assert {k: c.shape for k, c in fitted.items()} == {4: (4, 5), 8: (8, 5), 12: (12, 5)}
    assert max(np.abs(fitted[8] - m).sum(axis=1).min() for m in middles) < 0.2
    scores = cluster.index_scores(df, "v", fitted)
    assert cluster.best_k(scores) == 8
    for k, centres in fitted.items():
        own = cluster.assign(df.where("v IS NOT NULL"), "v", centres)
        assert math.isclose(cluster.calinski_harabasz(own, "v", "cluster_id").first()["ch"], scores[k], rel_tol=1e-6)
    assert cluster.assign(df, "v", fitted[4]).where("cluster_id IS NULL").count() == 1
    again = cluster.fit_mini_batch(df.repartition(5), "id", "v", [8], batch_rows=300, steps=25)
    assert np.allclose(again[8], cluster.fit_mini_batch(df, "id", "v", [8], batch_rows=300, steps=25)[8])


def test_batch_step_moves_to_the_mean_of_all_rows_seen(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id long, v array<double>")
    centre = cluster.fit_mini_batch(df, "id", "v", [1], batch_rows=10, steps=4)[1]
    assert np.allclose(centre, [[19.5]])
    assert cluster.best_k({300: 1.0, 350: 2.0, 400: 2.0}) == 350 and cluster.best_k({3: -math.inf}) == 3
    with pytest.raises(ValueError):
        cluster.fit_mini_batch(df.limit(0), "id", "v", [2])
    few = cluster.fit_mini_batch(df.limit(2), "id", "v", [5], steps=3)[5]
    assert few.shape == (5, 1) and cluster.index_scores(df.limit(2), "v", {5: few})[5] == -math.inf


# boosting


@pytest.fixture(scope="module")
def priced(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        mass, z, kind = float(rng.uniform(0, 10)), float(rng.normal()), "abc"[i % 3]
        y = 3 * mass + 4 * math.sin(3 * mass) + (5 if kind == "b" else 0) + z + float(rng.normal())
        rows.append((i, mass if i % 11 else None, z, kind if i % 13 else None, y))
    return spark.createDataFrame(rows, "id long, mass double, z double, kind string, y double").repartition(3).cache()


def booster(**settings):
    return boosting.HistogramBooster(["mass", "z", "kind"], categorical=("kind",), **{"rate": 0.3, "rounds": 6, "depth": 3, "bins": 32} | settings)


def test_first_tree_is_the_best_split_by_hand(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i < 7 else 9.0) for i in range(20)], "x double, y double")
    model = boosting.HistogramBooster(["x"], "squared", "mae", rate=1.0, rounds=1, depth=1, bins=20, l2=0.0).fit(df, "y")
    assert np.allclose([r["p"] for r in model.transform(df, "p").orderBy("x").collect()], [1.0] * 7 + [9.0] * 13, atol=1e-6)
    huber = boosting.HistogramBooster(["x"], rate=1.0, rounds=1, depth=1, bins=20, l2=0.0).fit(df, "y")
    # the start is the median 9; a leaf is minus the sum of gradients over that of curvatures
    r, delta = 8.0, huber.delta
    g, h = r / math.sqrt(1 + (r / delta) ** 2), (1 + (r / delta) ** 2) ** -1.5
    assert np.allclose(huber.transform(df, "p", None).orderBy("x").first()["p"], 9 - g / h, rtol=1e-6)


def test_boosting_lowers_error_and_stops(priced):
    model = booster(rounds=30, patience=4).fit(priced.where("id % 5 > 0"), "y", priced.where("id % 5 = 0"))
    assert model.history[model.best_round - 1] == min(model.history) < 0.5 * model.history[0] or len(model.history) == 30
    assert len(model.trees) == model.best_round
    # what the stop says is what a replay over the whole history says
    spark = priced.sparkSession
    told = boosting.stopping(spark.createDataFrame(list(enumerate(model.history, 1)), "round int, error double"), 4).first()
    assert told["best_round"] == model.best_round and told["stopped"] == len(model.history)
    p = model.transform(priced)
    held = [(r["y"], r["prediction"]) for r in p.where("id % 5 = 0").collect()]
    assert math.isclose(np.mean([100 * abs(a - b) / ((abs(a) + abs(b)) / 2 + 1e-8) for a, b in held]), min(model.history), rel_tol=1e-4)


def test_predictions_never_fall(priced):
    free, bound = booster(depth=4, rounds=8).fit(priced, "y"), booster(depth=4, rounds=8, signs=[1, -1, 0]).fit(priced, "y")
    base = priced.where("mass IS NOT NULL").limit(40).select("id", "z", "kind")
    swept = base.crossJoin(priced.sparkSession.range(101).select((F.col("id") / 10).alias("mass")))

    def falls(model, rows, by, sign):
        listed = model.transform(rows, "p", None).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(by, "p")))["p"].alias("p"))
        return sum((np.diff(r["p"]) * sign < -1e-12).sum() for r in listed.collect())

    assert falls(free, swept, "mass", 1) > 0 and falls(bound, swept, "mass", 1) == 0
    by_z = priced.limit(30).select("id", "mass", "kind").crossJoin(priced.sparkSession.range(61).select(((F.col("id") - 30) / 10).alias("z")))
    assert falls(bound, by_z, "z", -1) == 0
    assert boosting.monotone_signs(["mass", "z"]) == [1, 0]


def test_stopped_fit_resumes_to_the_same_trees(spark, priced, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    whole = booster(rounds=7).fit(priced, "y")
    with pytest.raises(boosting.StoppedFit):
        booster(rounds=7).fit(priced, "y", snapshots=folder, every=1, stop=lambda n: n == 5)
    assert store.names(spark, folder) == ["manifest.json", *[f"round-{i:06d}.json" for i in (3, 4, 5)]]
    resumed = booster(rounds=7).fit(priced.repartition(5), "y", snapshots=folder, every=1)
    assert [t.as_dict() for t in resumed.trees] == [t.as_dict() for t in whole.trees] and resumed.history == whole.history
    with pytest.raises(ValueError, match="other settings"):
        booster(rounds=7, depth=2).fit(priced, "y", snapshots=folder)
    # the newest file broken: the one before it is taken
    store.put_bytes(spark, f"{folder}/round-000007.json", b"{")
    assert len(boosting.HistogramBooster.load(spark, folder).trees) == 6


def test_saved_booster_predicts_alike(spark, priced, tmp_path):
    model = booster().fit(priced, "y")
    model.save(spark, f"file://{tmp_path}/model")
    again = boosting.HistogramBooster.load(spark, f"file://{tmp_path}/model")
    odd = priced.select("id", "z", F.when(F.col("id") % 2 == 0, F.lit("never seen")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("id") % 3 > 0, F.col("mass")).alias("mass"))
    rows = model.transform(odd, "a").withColumn("b", again.column()).collect()
    assert all(r["a"] == r["b"] >= 0 for r in rows) and len(rows) == 600
    assert [f for f, _, _ in model.importance()][0] == "mass" and sum(n for *_, n in model.importance()) == sum(f >= 0 for t in model.trees for f in t.feature)


def test_boosting_edges(spark):
    empty = spark.createDataFrame([], "x double, y double")
    with pytest.raises(ValueError):
        boosting.HistogramBooster(["x"]).fit(empty, "y")
    flat = spark.createDataFrame([(None, 2.0), (None, 2.0), (1.0, None)], "x double, y double")
    model = boosting.HistogramBooster(["x"], rounds=2).fit(flat, "y")
    assert [r["prediction"] for r in model.transform(flat).collect()] == [2.0] * 3 and model.transform(empty).count() == 0


def test_stack_stops_by_absolute_error(spark):
    rows = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", F.col("a") + 2 * F.col("b"))
    model = models.fit_stack(rows.where("id % 4 > 0"), ["a", "b"], "y", rows.where("id % 4 = 0"), rounds=12, patience=3, rate=0.5, depth=3)
    assert model.settings["metric"] == "mae" and model.history[model.best_round - 1] == min(model.history) < model.history[0]


# tuning


def test_parzen_search_beats_random_search():
    space = {"x": tuning.Real(-5, 5), "rate": tuning.Real(1e-3, 1, log=True), "n": tuning.Real(1, 9, whole=True), "kind": tuning.Choice(("a", "b", "c"))}

    def far(s):
        return (s["x"] - 2) ** 2 / 10 + abs(math.log10(s["rate"]) + 1.5) + abs(s["n"] - 6) / 4 + (s["kind"] != "b")

    guided, drawn = [], []
    for seed in range(60):
        guided.append(tuning.search(far, space, 15, None, seed)[1])
        rng = np.random.default_rng([99, seed])
        drawn.append(min(far({name: own.draw(rng) for name, own in space.items()}) for _ in range(15)))
    assert np.mean(guided) < np.mean(drawn) and sum(a < b for a, b in zip(guided, drawn, strict=True)) > 33


def test_trials_survive_a_restart_and_time_ends(spark, tmp_path):
    space = {"x": tuning.Real(0, 1), "n": tuning.Real(1, 3, whole=True)}
    table = tuning.TrialTable(spark, f"file://{tmp_path}/trials")
    asked = []

    def dies(s):
        if len(asked) == 4:
            raise KeyboardInterrupt
        asked.append(s)
        return s["x"]

    with pytest.raises(KeyboardInterrupt):
        tuning.search(dies, space, 9, None, 7, table)
    best, score, trials = tuning.search(lambda s: s["x"], space, 9, None, 7, table)
    assert [t[0] for t in trials[:4]] == asked and trials == tuning.search(lambda s: s["x"], space, 9, None, 7)[2]
    assert score == min(t[1] for t in trials) == best["x"] and all(s["n"] in (1, 2, 3) for s, _ in trials)
    ticks = iter(range(0, 1000, 100))
    assert len(tuning.search(lambda s: math.nan, space, 15, 350.0, clock=lambda: next(ticks))[2]) == 4


# quantiles


@pytest.mark.parametrize("few", [4096, 3])
def test_quantiles_are_the_builtin_ones(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "READ", few)
    monkeypatch.setattr(quantiles, "BINS", 16)
    rng = np.random.default_rng(6)
    columns = {"a": rng.normal(size=501).tolist(), "b": [1e308, -1e308, 0.0, None] * 125 + [5e-324], "c": [7.0] * 501, "d": [math.inf, -math.inf, math.nan, 1.0, 2.0] * 100 + [3.0], "e": [None] * 501, "f": rng.integers(0, 4, 501).astype(float).tolist()}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.quantiles(df, list(columns), shares)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in columns]).first()
    for c in columns:
        if want[c] is None:
            assert got[c] == [None] * len(shares)
        else:
            assert np.array_equal(np.array(got[c]), np.array(want[c]), equal_nan=True), c
    assert quantiles.medians(df.limit(0), ["a"]) == {"a": None}


# fuzzy brands


def plain_resolve(q, names):
    low = sorted(names)
    exact = [n for n in low if n.lower() == q.lower()]
    if exact:
        return exact[0]
    whole = min((-fuzzy.weighted_ratio(q.lower(), n.lower()), n) for n in low)
    words = min((-fuzzy.token_set_ratio(q.lower(), n.lower()), n) for n in low)
    return whole[1] if whole[0] <= -90 else words[1] if words[0] <= -92 else None


def test_index_loses_no_match(spark):
    rnd = random.Random(11)
    words = ["bear", "creek", "acme", "foods", "nestle", "x", "a", "of", "international", "kitchens", "mark", "member", "lo", "oreal", "ab", "b"]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))).title() for _ in range(220)} | {"A", "Ab", "Aaaaaaaaaaaa", "Yum Yum Yum", "É Ü"})

    def altered(t):
        t = list(t)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", " ", "e"])
        return " ".join("".join(t).split())

    asked = {altered(rnd.choice(names)).lower() for _ in range(260)} | {" ".join(rnd.sample(n.split(), len(n.split()))).lower() for n in names[::3]} | {n[rnd.randint(0, 2) : -1].strip().lower() for n in names[::4]} | {"a", "x", "aaaaaaaaaaa", "yum", "yum yum", "é"}
    asked = sorted(asked - {""})
    df = spark.createDataFrame(list(enumerate(asked)), "k long, q string")
    got = {r["q"]: r["resolved"] for r in fuzzy.resolve(df, "k", "q", spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert {q: got[q] for q in asked} == {q: plain_resolve(q, names) for q in asked}


def test_index_asks_few_names(spark):
    """Of ten times the names, a candidate meets about as many as look like it."""
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12))) for _ in range(3000)})
    asked = spark.createDataFrame([(n[:3] + "#" + n[3:],) for n in made[:100]], "q string")
    n = [fuzzy.candidates(asked, spark.createDataFrame([(x,) for x in some], "low string")).count() for some in (made[:300], made)]
    assert n[1] < 0.02 * 100 * len(made) and n[0] >= 100


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pieces_lose_no_name_within_two_edits(spark):
    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice("abC ") for _ in range(rnd.randint(0, 9))) for _ in range(120)} | {"international", "Intranational"})
    asked = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 10))) for _ in range(150)} | {"internatinal", "interxxnational", ""})
    df = spark.createDataFrame(list(enumerate(asked)), "k long, q string")
    got = {r["q"]: r["resolved"] for r in fuzzy.by_edits(df, "k", "q", spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    for q in asked:
        d, name = min((edits(q, n.lower()), n) for n in names)
        assert got[q] == (name if d <= 2 else None), q


def test_bit_parallel_common_subsequence():
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert fuzzy.common(a, b) == row[-1]


def test_fuzzy_edges(spark):
    names = spark.createDataFrame([("Acme",), ("  ",), (None,), ("ACME",)], "name string")
    df = spark.createDataFrame([(1, None), (2, " "), (3, " acme\t"), (4, "acme"), (4, "acme")], "k long, q string")
    assert sorted((r["k"], r["resolved"]) for r in fuzzy.resolve(df, "k", "q", names).collect()) == [(1, None), (2, None), (3, "ACME"), (4, "ACME"), (4, "ACME")]
    assert fuzzy.resolve(df.limit(0), "k", "q", names).count() == 0 and fuzzy.resolve(df, "k", "q", names.limit(0)).where("resolved IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        fuzzy.resolve(df, "k", "q", names, whole=80)


# positions, buffers, files


def test_zip_by_position(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    spark.range(100).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(a)
    spark.range(100).select((F.col("id") * 2).alias("twice")).repartitionByRange(7, "twice").sortWithinPartitions("twice").write.parquet(b)
    assert sorted(map(tuple, positions.zipped(spark, a, b, ["id"], ["twice"]).collect())) == [(i, i, 2 * i) for i in range(100)]
    spark.range(99).select("id").write.parquet(f"{a}2")
    with pytest.raises(ValueError, match="99 rows against 100"):
        positions.zipped(spark, f"{a}2", b, ["id"], ["twice"])
    with pytest.raises(ValueError, match="both sides"):
        positions.zipped(spark, a, a, ["id"], ["id"])
    got = positions.numbered(spark.range(500).select(F.col("id").cast("string").alias("t")), "t", "n", 8).collect()
    assert sorted(r["n"] for r in got) == list(range(500))


def test_shuffle_buffer(spark):
    df = spark.range(5000).coalesce(1)
    out = [r["id"] for r in shuffle.shuffled(df, 100, 7).collect()]
    assert sorted(out) == list(range(5000)) and out != sorted(out)
    assert all(at >= row - 99 for at, row in enumerate(out))
    assert out == [r["id"] for r in shuffle.shuffled(df, 100, 7).collect()] != [r["id"] for r in shuffle.shuffled(df, 100, 8).collect()]
    assert [r["id"] for r in shuffle.shuffled(df.limit(5), 1, 7).collect()] == [0, 1, 2, 3, 4]
    assert shuffle.shuffled(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shuffle.shuffled(df, 0)


def test_one_archive_by_several_tasks(spark, tmp_path):
    spark.dataSource.register(TarShards)
    path = f"file://{tmp_path}/big"
    rows = [(f"{i:04d}", {"txt": (f"text {i} " * (i % 50)).encode(), "json": b"{}"}) for i in range(1000)]
    spark.createDataFrame(rows, "key string, parts map<string,binary>").coalesce(1).write.format("tarshards").option("path", f"{tmp_path}/big").option("per_shard", "1000").mode("append").save()
    archive = next(x for x in store.names(spark, path) if x.endswith(".tar"))
    want = {(k, bytes(p["txt"])) for k, p in rows}

    def read(where, split):
        return spark.read.format("tarshards").option("path", where).option("split_bytes", str(split)).load()

    for where in (f"{path}/*.tar", f"{tmp_path}/big/{archive}"):
        whole, split = read(where, 1 << 30), read(where, 100_000)
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() >= 5
        assert {(r["key"], bytes(r["parts"]["txt"])) for r in split.collect()} == {(r["key"], bytes(r["parts"]["txt"])) for r in whole.collect()} == want
        assert split.count() == 1000
    # headers say the same as the index that the writer left
    with open(f"{tmp_path}/big/{archive}", "rb") as f, open(f"{tmp_path}/big/{archive}.idx") as g:
        assert readers.sample_starts(f) == json.load(g)
    store.delete(spark, f"{path}/{archive}.idx")
    assert read(f"{path}/*.tar", 100_000).count() == 1000
    broken = io.BytesIO()
    with tarfile.open(fileobj=broken, mode="w") as tar:
        tar.addfile(tarfile.TarInfo("a.txt"), io.BytesIO(b""))
    assert readers.sample_starts(io.BytesIO(broken.getvalue()[:512] + b"junk" * 200)) == [0]


def test_sheet_round_trip(spark, tmp_path):
    rows = [("mass & <volume>", 12.5, 3), ("ünï\n\"q\"", 1e-9, None), ("", -7.0, 0), (None, float("nan"), 1)]
    df = spark.createDataFrame(rows, "feature string, gain double, splits int")
    path = f"file://{tmp_path}/report.xlsx"
    assert sheets.write_sheet(df, path, [F.desc_nulls_last("splits")]) == 4
    header, back = sheets.read_sheet(spark, path)
    assert header == ["feature", "gain", "splits"]
    assert back == [("mass & <volume>", 12.5, 3), (None, None, 1), ("", -7.0, 0), ("ünï\n\"q\"", 1e-9, None)]
    assert sheets.write_sheet(df.limit(0), path, ["feature"]) == 0 and sheets.read_sheet(spark, path) == (header, [])
    assert sheets._letters(0) == "A" and sheets._letters(27) == "AB" and sheets._letters(702) == "AAA"


def test_swap_leaves_a_whole_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    spark.range(5).write.parquet(path)
    real = store.rename

    def lost(at):
        n = [0]

        def rename(s, a, b):
            n[0] += 1
            if n[0] == at:
                raise KeyboardInterrupt
            real(s, a, b)

        return rename

    for at, want in ((1, 5), (2, 6)):  # before and after the old table stepped aside
        monkeypatch.setattr(store, "rename", lost(at))
        with pytest.raises(KeyboardInterrupt):
            sinks.replace_parquet(spark.read.parquet(path).unionByName(spark.range(1)), path)
        monkeypatch.setattr(store, "rename", real)
        assert sinks.recovered(spark, path) == (at == 2)
        assert spark.read.parquet(path).count() == want and store.names(spark, f"file://{tmp_path}") == ["table"]
    sinks.replace_parquet(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and not sinks.recovered(spark, f"{path}-other")


def test_scratch_is_dropped(spark, tmp_path):
    from larkmill.sources import scratch

    here, other = scratch.path(spark, "some"), f"{scratch.root(spark).rstrip('/')}/others-{tmp_path.name}"
    for p in (here, other):
        spark.range(3).write.parquet(p)
    assert scratch.drop(spark) >= 1 and not store.exists(spark, here) and store.exists(spark, other)
    store.delete(spark, other)


def test_registered_models(spark, sf):
    """Reports of fitted models: gains fall, a resumed fit predicts as the whole one."""
    gains = [r["gain"] for r in workload.QUERIES["k10_importance_report"](spark, sf).orderBy("place").collect()]
    assert gains == sorted(gains, reverse=True) and gains[0] > 0
    assert workload.QUERIES["k12_snapshots"](spark, sf).where("whole <> resumed").count() == 0
    out = workload.QUERIES["b05_saved_booster"](spark, sf)
    assert out.where("price IS NULL OR price < 0").count() == 0 and out.count() == 200


def test_cuts_are_the_same_for_rows_in_any_order(spark):
    """k12_snapshots: a fit is taken up from a snapshot only where its cuts are the same; approximate quantiles changed with the order of tasks."""
    rows = spark.range(60_000).select(((F.col("id") * 7919 % 60_000) / 7).alias("x"), F.when(F.col("id") % 3 > 0, F.exp(F.col("id") % 700)).alias("z"))
    orders = (rows.coalesce(1), rows.repartition(13), rows.orderBy(F.desc("x")), rows.repartition(5, "z"))
    first, *others = (boosting.Binner.fit(o, ["x", "z"], [], 64).cuts for o in orders)
    assert all(o == first for o in others)
    values = sorted(i / 7 for i in range(60_000))
    assert first["x"] == [values[-(-i * 60_000 // 64) - 1] for i in range(1, 64)]
    assert boosting.Binner.fit(rows.where("x < 0"), ["x"], [], 64).cuts == {"x": []}


def test_tar_query_reads_all_archives_of_a_task(spark, tmp_path):
    """k07_tar_shards: 100,300 samples in one file are more than the thousand archives that its brace range named."""
    part = spark.range(1, 125_401, 1, 1).select(F.col("id").alias("p_partkey"), F.lit("a part").alias("p_name"), F.lit(7).alias("p_size"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = workload.QUERIES["k07_tar_shards"](spark, str(tmp_path))
    assert got.selectExpr("count(*)", "count(DISTINCT key)", "count_if(txt = 'a part')").first()[:] == (100_320, 100_320, 100_320)


def test_many_archives_share_tasks():
    many = [readers.Stretch(f"s-{i}", 0, 10) for i in range(1000)]
    made = readers.bundled(many, 1 << 20)
    assert [x for b in made for x in b.stretches] == many and 200 <= len(made) <= 500
    assert [len(b.stretches) for b in readers.bundled(many[:200], 1 << 20)] == [1] * 200
    assert len(readers.bundled(many, 5)) == 1000


def test_archive_query_writes_by_parts_of_the_table(spark, tmp_path):
    """s11_split_archive: one archive of all documents went through a single task."""
    texts = spark.range(1, 801).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 100).alias("text"))
    texts.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    folder = store.exists(spark, scratch.root(spark)) and scratch.root(spark)
    before = set(store.names(spark, folder)) if folder else set()
    bytes_, open_ = (spark.conf.get(f"spark.sql.files.{x}") for x in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "4k")
        got = workload.QUERIES["s11_split_archive"](spark, str(tmp_path))
        made = [x for x in store.names(spark, scratch.root(spark)) if "large-tar" in x and x not in before]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.files.openCostInBytes", open_)
    assert len([x for x in store.names(spark, f"{scratch.root(spark)}/{made[0]}") if x.endswith(".tar")]) >= 4
    assert got.selectExpr("count(DISTINCT doc_id)", "sum(n_chars)").first()[:] == (800, 800_000) and got.rdd.getNumPartitions() > 8


# term counts of large tables of short texts


def test_short_texts_are_dealt_before_they_are_made_into_terms(spark):
    """t03_brand_terms, t03_brand_vectors, t02_char_tfidf, u04_sparse_concat: a table of few bytes is one file, and one task held all of its terms."""
    docs = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("ab"), F.col("id") % 7).alias("text"))
    tf = tfidf.counts(docs, "id", tfidf.char_terms(F.col("text"), 2, 3), rows=100)
    placed = tf.withColumn("part", F.spark_partition_id()).groupBy("id").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))
    assert tf.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    assert placed.selectExpr("count(*)", "max(parts)", "min(n)", "max(n)").first()[:] == (1000, 1, 3, 3)
    weights = tfidf.transform(tf, tfidf.fit(tf, 1000), "id")
    assert weights.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 9).alias("x")).where("x <> 1").count() == 0


def test_catalog_is_dealt_by_rows(spark, sf, tmp_path):
    """f24_fallbacks: costly rules over a table of few bytes kept a few tasks busy, however many rows it had."""
    part = spark.read.parquet(f"{sf}/part.parquet").drop("p_partkey")
    part.limit(1).crossJoin(spark.range(50_000).withColumnRenamed("id", "p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.catalog(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 3 and rows.select("p_partkey").distinct().count() == 50_000


def test_sample_files_are_listed_at_once(spark, sf):
    """k08_sample_files: a path with wildcards was listed file by file, in a job of its own where there are more than 32 files."""
    tracker, group = spark.sparkContext.statusTracker(), "sample-files"
    spark.sparkContext.setJobGroup(group, group)
    try:
        made = workload.QUERIES["k08_sample_files"](spark, sf)
        jobs = len(tracker.getJobIdsForGroup(group))
        got = made.count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == spark.read.parquet(f"{sf}/embeddings.parquet").count() > 32
    assert jobs <= 3, jobs


def test_stacked_trees_grow_from_sums_of_cells(spark, monkeypatch):
    """e01_stack: each tree took two passes over the rows, a thousand in all. Rows of equal bins are summed once; the trees are those of passes over
    the rows, with and without held rows, and a stop ends at the same round."""
    h = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(0, 3000, 1, 3).select("id", (h(1) * 50).alias("a"), F.when(h(2) > 0.05, h(2) * 20).alias("b"), h(3).alias("noise")).withColumn("y", F.col("a") + F.coalesce("b", F.lit(30.0)) + 8 * F.col("noise"))
    train, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    tracker, made = spark.sparkContext.statusTracker(), {}
    monkeypatch.setattr(boosting, "AHEAD", 4)
    for cells in (boosting.CELLS, 0):
        monkeypatch.setattr(boosting, "CELLS", cells)
        spark.sparkContext.setJobGroup(f"stack-{cells}", "")
        try:
            own = [models.fit_stack(train, ["a", "b"], "y", h_, rounds=9, patience=1, rate=1.0, depth=2, bins=20) for h_ in (held, held.where("false"))]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        made[bool(cells)] = own, [m.transform(rows, "p").orderBy("id").toPandas()["p"].to_numpy() for m in own], len(tracker.getJobIdsForGroup(f"stack-{cells}"))
    (new, p_new, jobs), (old, p_old, many) = made[True], made[False]
    assert jobs <= many - 20, (jobs, many)
    for a, b, x, y in zip(new, old, p_new, p_old, strict=True):
        assert len(a.history) == len(b.history) and a.best_round == b.best_round == len(a.trees) and np.allclose(a.history, b.history, rtol=1e-6) and a.uses == b.uses
        assert np.allclose(x, y, rtol=1e-6) and [(t.feature, t.bin) for t in a.trees] == [(t.feature, t.bin) for t in b.trees]


def test_very_many_stretches_share_tasks(spark, tmp_path):
    """s11_split_archive: at 6 GB, 190,000 stretches of 64 kB were a task each, whose results and descriptions the driver had to hold."""
    many = [readers.Stretch(f"a-{i // 4000}", i % 4000 * 65_600, (i % 4000 + 1) * 65_600) for i in range(190_000)]
    made = readers.bundled(many, 64 << 10)
    assert 1500 <= len(made) <= 2200 and max(len(b.stretches) for b in made) <= 2
    flat = [x for b in made for x in b.stretches]
    ends = [(x.path, x.start, x.end) for x in flat]
    assert ends[0][1] == 0 and all(a == b if p == q else b == 0 for (p, _, a), (q, b, _) in zip(ends, ends[1:], strict=False)) and sum(x.end - x.start for x in flat) == 190_000 * 65_600
    rows = spark.range(400).select(F.col("id").cast("string").alias("key"), F.create_map(F.lit("txt"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary")).alias("parts"))
    spark.dataSource.register(TarShards)
    rows.coalesce(2).write.format("tarshards").option("path", str(tmp_path / "out")).option("per_shard", "1000").mode("append").save()
    reader = readers.TarReader(f"{tmp_path}/out/*.tar", 512)
    cut = [x for b in reader.partitions() for x in b.stretches]
    got = [(k, len(p["txt"])) for b in readers.bundled(cut, 512, 3, 5) for _, k, p in reader.read(b)]
    assert len(cut) > 20 and len(readers.bundled(cut, 512, 3, 5)) <= 7 and sorted(got) == sorted((str(i), i) for i in range(400))


def test_equal_catalog_texts_are_one_sparse_row(spark, tmp_path, monkeypatch):
    """t05_sparse_svd: each part was counted and multiplied, though many have the same text. Projections of all parts have the inner products of the rows that
    every part on its own gives, as there are fewer different texts than dimensions."""
    part = spark.range(60).select(F.col("id").alias("p_partkey"), F.concat(F.lit("new "), F.element_at(F.array(*map(F.lit, ("ring", "bolt", "plate"))), (F.col("id") % 3 + 1).cast("int"))).alias("p_name"), F.lit("SMALL").alias("p_type"), (F.col("id") % 12).cast("int").alias("p_size"))
    part.select(F.expr("p_partkey % 12 + 60 * (p_partkey div 12)").alias("p_partkey"), "p_name", "p_type", "p_size").write.parquet(f"{tmp_path}/part.parquet")
    docs, train, want = registry.catalog(spark, str(tmp_path)), F.col("p_partkey") % 5 > 0, {}
    for b, terms in enumerate((tfidf.word_terms(F.col("text")), tfidf.char_terms(F.col("text")))):
        tf = tfidf.counts(docs, "p_partkey", terms)
        for r in tfidf.transform(tf, tfidf.fit(tf.where(train), docs.where(train).count(), 3, 1.0 if b else 0.98), "p_partkey").collect():
            want.setdefault(r["p_partkey"], {})[b, r["term"]] = r["weight"]
    fitted = []
    monkeypatch.setattr(svd.TruncatedSvd, "fit", lambda self, rows, n, old=svd.TruncatedSvd.fit: (fitted.append(rows.count()), old(self, rows, n))[1])
    got = {r["p_partkey"]: np.array(r["tfidf_svd"]) for r in workload.QUERIES["t05_sparse_svd"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) == 60 and fitted == [9]
    own = [k for k in want if k % 5]
    for a in own:
        for b in own[:12]:
            assert abs(got[a] @ got[b] - sum(w * want[b].get(t, 0) for t, w in want[a].items())) < 1e-6
