"""Metrics, folds, clusters, models, ensembles and the incremental stream over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkmill.functions import metrics, vectors
from larkmill.operators import boosting, cluster, models, quantiles, relate, splits, svd, tfidf, tuning
from larkmill.sources import sheets
from larkmill.streaming import checkpoint

from .registry import catalog, query, scratch, table, written

#: Two predictions of a price by integer arithmetic, so that both engines agree to the last bit.
PREDICTED = "SELECT p_partkey, p_retailprice AS y, p_retailprice * (100 + p_partkey % 7) / 100 AS a, p_retailprice * (100 - p_partkey % 5) / 100 AS b FROM part"
PRED = f"p AS ({PREDICTED})"


def _pred(s, d):
    return table(s, d, "part").selectExpr("p_partkey", "p_retailprice AS y", "p_retailprice * (100 + p_partkey % 7) / 100 AS a", "p_retailprice * (100 - p_partkey % 5) / 100 AS b")


def _r(c, n=6):
    return F.round(c, n)


@query("m01_ratios", "SELECT l_orderkey, l_linenumber, round(l_quantity / (l_extendedprice + 1e-6), 6) AS density, round(l_quantity / l_linenumber, 6) AS mass_per_pack FROM lineitem")
def m01(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", _r(F.col("l_quantity") / (F.col("l_extendedprice") + 1e-6)).alias("density"), _r(F.col("l_quantity") / F.col("l_linenumber")).alias("mass_per_pack"))


@query("m02_expm1", "SELECT p_partkey, round(exp(p_size::DOUBLE / 10) - 1, 6) AS x FROM part")
def m02(s, d):
    return table(s, d, "part").select("p_partkey", _r(F.expm1(F.col("p_size").cast("double") / 10)).alias("x"))


@query("m08_huber", f"WITH {PRED} SELECT p_partkey, round((a - y) / sqrt(1 + ((a - y) / 37.0) * ((a - y) / 37.0)), 6) AS g, round(1 / pow(1 + ((a - y) / 37.0) * ((a - y) / 37.0), 1.5), 6) AS h FROM p")
def m08(s, d):
    r, w = F.col("a") - F.col("y"), F.lit(37.0)
    return _pred(s, d).select("p_partkey", _r(metrics.huber_gradient(r, w)).alias("g"), _r(metrics.huber_hessian(r, w)).alias("h"))


@query("m09_iqr_delta", "SELECT round(greatest(1e-6, greatest(1e-6, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25)) / 1.349), 6) AS delta FROM part")
def m09(s, d):
    delta = metrics.iqr_delta(quantiles.quantiles(table(s, d, "part"), ["p_retailprice"], [0.25, 0.75])["p_retailprice"])
    return s.range(1).select(_r(F.lit(delta)).alias("delta"))


@query("m10_blend", f"WITH {PRED} SELECT p_partkey, round(0.5 * a + 0.5 * b, 6)::DOUBLE AS p FROM p")
def m10(s, d):
    return _pred(s, d).select("p_partkey", _r(0.5 * F.col("a") + 0.5 * F.col("b")).alias("p"))


@query("e10_smape_ratio", f"WITH {PRED} SELECT round(200 * avg(abs(y - a) / CASE WHEN abs(y) + abs(a) = 0 THEN 1 ELSE abs(y) + abs(a) END), 6) AS smape FROM p")
def e10(s, d):
    return _pred(s, d).agg(_r(metrics.smape_ratio(F.col("y"), F.col("a"))).alias("smape"))


@query("e11_smape_epsilon", f"WITH {PRED} SELECT round(100 * avg(abs(a - y) / ((abs(y) + abs(a)) / 2 + 1e-8)), 6) AS smape FROM p")
def e11(s, d):
    return _pred(s, d).agg(_r(metrics.smape_epsilon(F.col("y"), F.col("a"))).alias("smape"))


@query("e12_smape_strict", f"WITH {PRED} SELECT round(avg(CASE WHEN p_partkey % 9 = 0 THEN 100.0 ELSE 100 * abs(b - y) / ((abs(y) + abs(b)) / 2) END), 6) AS smape FROM p")
def e12(s, d):
    text = F.when(F.col("p_partkey") % 9 == 0, F.lit("about ten")).otherwise(F.col("b").cast("string"))
    return _pred(s, d).agg(_r(metrics.smape_strict(F.col("y"), text)).alias("smape"))


@query("e13_smape_zeroed", f"WITH {PRED} SELECT round(avg(CASE WHEN p_partkey % 9 = 0 THEN 200.0 ELSE 100 * abs(b - y) / ((abs(y) + abs(b)) / 2) END), 6) AS smape FROM p")
def e13(s, d):
    text = F.when(F.col("p_partkey") % 9 == 0, F.lit("1d")).otherwise(F.col("b").cast("string"))
    return _pred(s, d).agg(_r(metrics.smape_zeroed(F.col("y"), text)).alias("smape"))


@query("e02_ridge", f"""WITH {PRED}, s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) * count(*) + 1 AS s11, covar_pop(a, b) * count(*) AS s12, covar_pop(b, b) * count(*) + 1 AS s22, covar_pop(a, y) * count(*) AS t1, covar_pop(b, y) * count(*) AS t2 FROM p),
w AS (SELECT *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS w1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS w2 FROM s) SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(my - w1 * ma - w2 * mb, 4) AS intercept FROM w""")
def e02(s, d):
    return models.ridge_two(_pred(s, d), "a", "b", "y").select(_r(F.col("w1")).alias("w1"), _r(F.col("w2")).alias("w2"), _r(F.col("intercept"), 4).alias("intercept"))


@query("e03_average", f"WITH {PRED} SELECT p_partkey, round(greatest((a + b) / 2, 0.01), 6) AS price FROM p")
def e03(s, d):
    return _pred(s, d).select("p_partkey", _r(models.blended(["a", "b"])).alias("price"))


@query("e04_submission", f"WITH {PRED}, t AS (SELECT p_partkey, a FROM p WHERE p_partkey % 10 > 0) SELECT p.p_partkey AS sample_id, round(greatest((coalesce(t.a, (SELECT median(a) FROM t)) + p.b + p.b) / 3, 0.01), 6) AS price FROM p LEFT JOIN t USING (p_partkey)")
def e04(s, d):
    """Two test sets outer-joined, gaps by their medians, fold models averaged, floor applied."""
    p = _pred(s, d)
    both = p.where("p_partkey % 10 > 0").select("p_partkey", "a").join(p.select("p_partkey", "b", F.col("b").alias("b2")), "p_partkey", "full")
    return relate.with_median(both, ["a", "b", "b2"]).select(F.col("p_partkey").alias("sample_id"), _r(models.blended(["a", "b", "b2"])).alias("price"))


HISTORY_SQL = "SELECT event_id // 200 + 1 AS round, sum(floor(value)::BIGINT)::BIGINT AS error FROM events GROUP BY 1"


@query("v04_early_stop", f"""WITH h AS ({HISTORY_SQL}), b AS (SELECT round, min({{'e': error, 'r': round}}) OVER (ORDER BY round) AS m FROM h),
e AS (SELECT coalesce(min(CASE WHEN round - m.r >= 3 THEN round END), max(round)) AS stopped FROM b) SELECT m.r AS best_round, stopped FROM b JOIN e ON round = stopped""")
def v04(s, d):
    """Patience 3 over a history of errors by round, here sums of event values in blocks of 200."""
    history = table(s, d, "events").groupBy(F.expr("event_id div 200 + 1").alias("round")).agg(F.sum(F.floor("value")).alias("error"))
    return boosting.stopping(history, 3)


@query("a11_smape_by_group", f"WITH {PRED} SELECT p_partkey % 5 AS fold, round(200 * avg(abs(y - a) / (abs(y) + abs(a))), 6) AS smape FROM p GROUP BY 1")
def a11(s, d):
    return _pred(s, d).groupBy((F.col("p_partkey") % 5).alias("fold")).agg(_r(metrics.smape_ratio(F.col("y"), F.col("a"))).alias("smape"))


@query("a21_row_argmax", "SELECT vec_id, list_position(e, list_max(e))::INT AS place, round(list_max(e)::DOUBLE, 6) AS top FROM (SELECT vec_id, embedding[1:10] AS e FROM embeddings)")
def a21(s, d):
    e = F.slice("embedding", 1, 10)
    return table(s, d, "embeddings").select("vec_id", F.array_position(e, F.array_max(e)).cast("int").alias("place"), F.round(F.array_max(e).cast("double"), 6).alias("top"))


# clusters

CENTRES_SQL = "c AS (SELECT label, list_transform(list(x ORDER BY i), lambda v: v) AS c FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query("c01_assign", f"WITH {CENTRES_SQL}, dist AS (SELECT vec_id, c.label AS k, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]) * (embedding[i]::DOUBLE - c[i]))) AS dd FROM embeddings, c) SELECT vec_id, arg_min(k, dd)::INT AS cluster_id FROM dist GROUP BY 1")
def c01(s, d):
    """Nearest of the label means (ten, in label order)."""
    return cluster.assign(table(s, d, "embeddings"), "embedding", _label_means(s, d)).select("vec_id", "cluster_id")


def _label_means(s, d):
    return [r["centre"] for r in cluster.cluster_means(table(s, d, "embeddings"), "embedding", "label").orderBy("label").collect()]


@query("a20_best_k", f"""WITH {CENTRES_SQL}, dist AS (SELECT k, vec_id, c.label AS l, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]) * (embedding[i]::DOUBLE - c[i]))) AS dd FROM embeddings, (SELECT unnest([3, 5, 8, 10]) AS k), c WHERE c.label < k),
near AS (SELECT k, vec_id, arg_min(l, dd) AS l FROM dist GROUP BY 1, 2), x AS (SELECT k, l, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM near JOIN embeddings USING (vec_id)),
per AS (SELECT k, l, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY ALL), alls AS (SELECT k, i, sum(s) AS s, sum(n) AS n, sum(s * s / n) AS b, sum(q) AS q, count(*) AS g FROM per GROUP BY ALL)
SELECT k::INT AS k, round((sum(b - s * s / n) / (max(g) - 1)) / (sum(q - b) / (max(n) - max(g))), 6) AS ch FROM alls GROUP BY k ORDER BY 2 DESC, 1 LIMIT 1""")
def a20(s, d):
    """The best of four models (the means of the first 3, 5, 8 and 10 labels) by the index of all rows."""
    means = np.array(_label_means(s, d))
    scores = cluster.index_scores(table(s, d, "embeddings"), "embedding", {k: means[:k] for k in (3, 5, 8, 10)})
    k = cluster.best_k(scores)
    return s.range(1).select(F.lit(k).alias("k"), _r(F.lit(scores[k])).alias("ch"))


@query("a19_calinski_harabasz", """WITH x AS (SELECT label, i, x::DOUBLE AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)), per AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY 1, 2),
alls AS (SELECT i, sum(s) AS s, sum(n) AS n, sum(s * s / n) AS b, sum(q) AS q FROM per GROUP BY 1) SELECT round((sum(b - s * s / n) / (count(DISTINCT l.k) - 1 + 9)) / (sum(q - b) / (max(n) - 10)), 6) AS ch FROM alls, (SELECT 1 AS k) l""")
def a19(s, d):
    return cluster.calinski_harabasz(table(s, d, "embeddings"), "embedding", "label").select(_r(F.col("ch")).alias("ch"))


GRID = list(range(300, 601, 50))


def _grid(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    train, held = splits.disjoint_samples(e, "vec_id", 200_000, 100_000)
    if held.isEmpty():  # a table no larger than the first sample: the index is taken over it, as in the reference
        held = train
    return cluster.choose_k(train, held, "vec_id", "embedding", GRID, steps=20)


@query("c01_kmeans")
def c01k(s, d):
    """k from the grid, fitted on the training rows, every row assigned."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    k = cluster.resolve_k(None, _grid(s, d)[0])
    return cluster.assign(e, "embedding", cluster.fit_kmeans(e.where("vec_id % 5 > 0"), "vec_id", "embedding", k, steps=20)).select("vec_id", "cluster_id")


@query("c02_choose_k")
def c02(s, d):
    """The index of each k of the grid, and which is chosen."""
    chosen, scores = _grid(s, d)
    return s.createDataFrame([(k, float(v), k == chosen) for k, v in sorted(scores.items())], "k int, ch double, chosen boolean")


@query("c03_resolve_k", "SELECT n_given, coalesce(n_given, n_found, 500)::INT AS k FROM (SELECT label AS n_given, NULL AS n_found FROM embeddings UNION ALL SELECT NULL, count(DISTINCT label) FROM embeddings UNION ALL SELECT NULL, NULL FROM (SELECT 1)) WHERE n_given IS NULL OR n_given > 8")
def c03(s, d):
    """What is asked for, else what a selection found, else 500."""
    labels = [r["label"] for r in table(s, d, "embeddings").where("label > 8").select("label").collect()]
    found = table(s, d, "embeddings").select("label").distinct().count()
    rows = [(x, cluster.resolve_k(x, None)) for x in labels] + [(None, cluster.resolve_k(None, found)), (None, cluster.resolve_k())]
    return s.createDataFrame(rows, "n_given int, k int")


def _equal_texts(s, d, train):
    """(p_partkey, texts), and for each different value of texts: id (its least p_partkey), texts, and times, its training rows."""
    docs = catalog(s, d).groupBy("p_partkey").agg(F.sort_array(F.collect_list("text")).alias("texts"))  # one text, unless a key is repeated
    return docs, written(docs.groupBy("texts").agg(F.min("p_partkey").alias("id"), F.count(F.when(F.expr(train), 1)).alias("times")), "texts")


def _term_blocks(s, d, train, own):
    """Word and character weights of the catalog's different texts, fitted on the training rows, with their vocabularies."""
    n = table(s, d, "part").where(train).count()
    docs = own.select("id", "times", F.explode("texts").alias("text"))
    blocks = []
    for terms, share, size in ((tfidf.word_terms(F.col("text")), 0.98, 200_000), (tfidf.char_terms(F.col("text")), 1.0, 300_000)):
        tf = written(tfidf.counts(docs, "id", terms, also=("times",)), "counts")
        vocabulary = written(tfidf.fit(tf.where("times > 0"), n, 3, share, size, "times"), "vocabulary")
        blocks.append((tfidf.transform(tf, vocabulary, "id"), vocabulary))
    return blocks


@query("t05_sparse_svd")
def t05(s, d):
    """Word and character terms side by side, fitted on four fifths of the rows; all rows in 32 dimensions. Equal texts are one sparse row, which
    counts in the fit as often as it is a training row: n equal rows have the same normal matrix as one times the root of n."""
    docs, own = _equal_texts(s, d, "p_partkey % 5 > 0")
    rows, n = svd.side_by_side(_term_blocks(s, d, "p_partkey % 5 > 0", own), "id")
    rows = written(rows.join(own.select(F.col("id").alias("key"), "times"), "key"), "sparse")
    scaled = rows.where("times > 0").select("key", "cols", F.transform("weights", lambda w: w * F.sqrt("times")).alias("weights"))
    model = svd.TruncatedSvd(32, 7, 32).fit(written(scaled, "scaled"), n)
    made = model.transform(rows, "tfidf_svd").withColumnRenamed("key", "id")
    return docs.join(own.select("id", "texts").join(made, "id"), "texts").select("p_partkey", "tfidf_svd")


@query("t05_singular_values")
def t05v(s, d):
    """Singular values of the given vectors, as sparse rows of 64 columns."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.sequence(F.lit(0), F.lit(63)).alias("cols"), F.col("embedding").cast("array<double>").alias("weights"))
    model = svd.TruncatedSvd(8).fit(written(rows, "sparse"), 64)
    return model.transform(rows, "p").select(F.col("key").alias("vec_id"), F.size("p").alias("k"), F.lit(float(model.values[0])).alias("top"))


@query("t03_brand_vectors")
def t03v(s, d):
    """Character terms of brands in 20 dimensions, fitted on the training half only."""
    docs = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("text"))
    tf = tfidf.counts(docs, "p_partkey", tfidf.char_terms(F.col("text"), 2, 4))
    vocabulary = written(tfidf.fit(tf.where("p_partkey % 2 = 0"), docs.where("p_partkey % 2 = 0").count()), "vocabulary")
    rows, n = svd.side_by_side([(tfidf.transform(tf, vocabulary, "p_partkey", sublinear=False), vocabulary)], "p_partkey")
    rows = written(rows, "sparse")
    model = svd.TruncatedSvd(20).fit(rows.where("key % 2 = 0"), n)
    made = model.transform(rows, "v").select(F.col("key").alias("p_partkey"), "v")
    return docs.select("p_partkey").join(made, "p_partkey", "left").select("p_partkey", *vectors.spread("v", "brand_sim", 20, 1))


@query("u04_sparse_concat", r"""WITH docs AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), w AS (SELECT p_partkey, regexp_extract_all(t, '\b[a-z0-9_][a-z0-9_]+\b') AS t FROM docs),
tf1 AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w) GROUP BY 1, 2),
tf2 AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS term FROM docs) GROUP BY 1, 2),
both_ AS (SELECT 1 AS b, * FROM tf1 UNION ALL SELECT 2, * FROM tf2), n AS (SELECT count(*) AS n FROM docs), df AS (SELECT b, term, count(*) AS df FROM both_ GROUP BY 1, 2 HAVING count(*) >= 3),
x AS (SELECT b, p_partkey, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM both_ JOIN df USING (b, term), n),
z AS (SELECT b, p_partkey, w / sqrt(sum(w * w) OVER (PARTITION BY b, p_partkey)) AS w FROM x)
SELECT p_partkey, count(*)::INT AS n_terms, round(coalesce(sum(w) FILTER (b = 1), 0), 6) AS words, round(coalesce(sum(w) FILTER (b = 2), 0), 6) AS letters, (SELECT count(*) FROM df)::INT AS n_cols FROM z GROUP BY 1""")
def u04s(s, d):
    """Word runs and character triples of each product as one sparse row: the words' columns come first."""
    docs = table(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    n, blocks = docs.count(), []
    for terms in (tfidf.word_terms(F.col("text")), tfidf.char_terms(F.col("text"), 3, 3)):
        tf = tfidf.counts(docs, "p_partkey", terms, n)
        vocabulary = written(tfidf.fit(tf, n, 3), "vocabulary")
        blocks.append((tfidf.transform(tf, vocabulary, "p_partkey"), vocabulary))
    first = blocks[0][1].count()
    rows, n_cols = svd.side_by_side(blocks, "p_partkey")
    pairs = F.arrays_zip("cols", "weights")
    summed = lambda keep: _r(F.aggregate(F.filter(pairs, keep), F.lit(0.0), lambda a, x: a + x["weights"]))
    return rows.select(F.col("key").alias("p_partkey"), F.size("cols").alias("n_terms"), summed(lambda x: x["cols"] < first).alias("words"), summed(lambda x: x["cols"] >= first).alias("letters"), F.lit(n_cols).alias("n_cols"))


@query("t06_scale_then_unit", """WITH st AS (SELECT avg(embedding[1]::DOUBLE) AS m1, stddev_pop(embedding[1]::DOUBLE) AS s1, avg(embedding[2]::DOUBLE) AS m2, stddev_pop(embedding[2]::DOUBLE) AS s2 FROM embeddings), z AS (SELECT vec_id, (embedding[1]::DOUBLE - m1) / s1 AS a, (embedding[2]::DOUBLE - m2) / s2 AS b FROM embeddings, st)
SELECT vec_id, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM z""")
def t06(s, d):
    two = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    z = vectors.standardised(two, ["a", "b"], "vec_id")
    unit = z.select("vec_id", vectors.normalised(F.array("a", "b")).alias("v"))
    return unit.select("vec_id", _r(F.col("v")[0]).alias("a"), _r(F.col("v")[1]).alias("b"))


# models


@query("l01_label_model")
def l01(s, d):
    e = table(s, d, "embeddings")
    model = models.fit_labels(e.where("vec_id % 4 > 0"), "embedding", "label")
    return models.predict_labels(model, e, "embedding").select("vec_id", "label_name", "confidence")


@query("l02_label_codes", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS code FROM part")
def l02(s, d):
    from pyspark.ml.feature import StringIndexer

    p = table(s, d, "part").select("p_partkey", "p_type")
    return StringIndexer(inputCol="p_type", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="keep").fit(p).transform(p).select("p_partkey", "code")


@query("l03_override", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_size % 100) / 100.0 >= 0.5 THEN 'ml' WHEN p_partkey % 3 = 0 THEN CASE WHEN (p_size % 100) / 100.0 >= 0.72 THEN 'ml' ELSE 'Uncategorized' END WHEN (p_size % 100) / 100.0 >= 0.72 THEN 'ml' ELSE 'X' END AS category FROM part")
def l03(s, d):
    current = F.when(F.col("p_partkey") % 3 == 0, F.lit("Uncategorized")).otherwise(F.lit("X"))
    return table(s, d, "part").select("p_partkey", models.confident(current, F.lit("ml"), (F.col("p_size") % 100) / 100.0, "Uncategorized").alias("category"))


@query("b04_category_codes", "SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_partkey <= 4) THEN p_type ELSE 'Unknown' END AS p_type FROM part")
def b04(s, d):
    p = table(s, d, "part").select("p_partkey", "p_type")
    return relate.known_category(p, "p_type", p.where("p_partkey <= 4"))


def _features(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_extendedprice").alias("volume"), F.avg("l_quantity").alias("mass"))
    return splits.folded(table(s, d, "part").select("p_partkey", "p_size", "p_type", F.col("p_retailprice").alias("y")).join(li, "p_partkey"), "p_partkey", 3).withColumn("pack_count", F.col("p_size").cast("double"))


FEATURES = ["volume", "mass", "pack_count", "p_type"]


def _booster(**settings):
    return boosting.HistogramBooster(FEATURES, categorical=("p_type",), signs=boosting.monotone_signs(FEATURES), **settings)


@query("b01_robust_boosting")
def b01(s, d):
    """Robust trees with a category, never falling in mass, volume and pack count, stopped on held rows."""
    rows = written(_features(s, d), "features")
    return _booster(rate=0.3, rounds=12, depth=3, patience=5).fit(rows.where("fold > 0"), "y", rows.where("fold = 0")).transform(rows).select("p_partkey", "prediction")


@query("b02_monotone_sweep", """WITH f AS (SELECT unnest(['volume', 'mass', 'pack_count']) AS feature), parts AS (SELECT count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem))
SELECT feature, 1 AS sign, n * 9 AS steps, 0::BIGINT AS falls FROM f, parts""")
def b02(s, d):
    """Each rising feature swept over ten values from its least to its greatest, every part's other features kept: predictions never fall."""
    rows = written(_features(s, d), "features")
    model = _booster(rate=0.3, rounds=6, depth=3).fit(rows, "y")
    out = None
    for name, sign in zip(FEATURES, model.settings["signs"], strict=True):
        if not sign:
            continue
        ends = rows.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
        swept = rows.select("p_partkey", *[c for c in FEATURES if c != name], F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
        swept = swept.withColumn(name, F.lit(ends["a"]) + F.col("step") * F.lit((ends["b"] - ends["a"]) / 9))
        listed = model.transform(swept, floor=None).groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("step", "prediction")))["prediction"].alias("p"))
        falls = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0).cast("long"), lambda n, i: n + (F.get("p", i) * sign < F.get("p", i - 1) * sign).cast("long"))
        one = listed.agg(F.lit(name).alias("feature"), F.lit(sign).alias("sign"), (F.count(F.lit(1)) * 9).alias("steps"), F.sum(falls).alias("falls"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b03_tuning")
def b03(s, d):
    """Settings by a tree-structured Parzen estimator, each trial a robust fit judged on held rows; trials are kept in a folder."""
    rows = written(_features(s, d), "features")
    train, held = rows.where("fold > 0"), rows.where("fold = 0")
    space = {"rate": tuning.Real(0.05, 0.8, log=True), "depth": tuning.Real(1, 3, whole=True), "l2": tuning.Real(0.01, 10, log=True)}
    folder = scratch(s, "trials")
    trial = lambda settings: min(_booster(rounds=3, **settings).fit(train, "y", held).history)
    _, _, trials = tuning.search(trial, space, trials=7, seconds=900, table=tuning.TrialTable(s, folder))
    return s.createDataFrame([(i, t["rate"], t["depth"], t["l2"], x) for i, (t, x) in enumerate(trials, 1)], "trial int, rate double, depth int, l2 double, smape double")


@query("k10_importance_report")
def k10r(s, d):
    """Summed gains of a fitted model as a sheet, read back: the greatest first."""
    rows = written(_features(s, d), "features")
    model = _booster(rate=0.3, rounds=4, depth=3).fit(rows, "y")
    made = s.createDataFrame(model.importance(), "feature string, gain double, splits int")
    path = f"{scratch(s, 'report')}/importance.xlsx"
    sheets.write_sheet(made, path, [F.desc("gain"), "feature"])
    header, back = sheets.read_sheet(s, path)
    return s.createDataFrame([(i, f, float(g), n) for i, (f, g, n) in enumerate(back, 1)], f"place int, {header[0]} string, {header[1]} double, {header[2]} int")


@query("k12_snapshots")
def k12(s, d):
    """A fit stopped after five rounds and taken up from its last snapshot; every row's prediction by the whole fit and by the resumed one."""
    rows = written(_features(s, d), "features")
    train, held, folder = rows.where("fold > 0"), rows.where("fold = 0"), scratch(s, "snapshots")
    settings = {"rate": 0.3, "rounds": 8, "depth": 2, "patience": 8}
    try:
        _booster(**settings).fit(train, "y", held, snapshots=folder, every=2, stop=lambda n: n == 5)
    except boosting.StoppedFit:
        pass
    resumed = _booster(**settings).fit(train, "y", held, snapshots=folder, every=2)
    whole = _booster(**settings).fit(train, "y", held)
    return whole.transform(rows, "whole").withColumn("resumed", resumed.column()).select("p_partkey", "whole", "resumed")


@query("b05_saved_booster")
def b05s(s, d):
    """Batch inference by a model read back from its folder, with its saved category list: unseen categories and missing features have bins of their own, predictions are 0 at
    least."""
    rows, folder = written(_features(s, d), "features"), scratch(s, "booster")
    _booster(rate=0.3, rounds=4, depth=3).fit(rows.where("fold > 0 AND p_type <> 'SMALL'"), "y").save(s, folder)
    model = boosting.HistogramBooster.load(s, folder)
    asked = rows.withColumn("mass", F.when(F.col("p_partkey") % 10 > 0, F.col("mass")))
    return model.transform(asked, "price").select("p_partkey", "price")


@query("b06_out_of_fold")
def b06(s, d):
    rows = written(_features(s, d), "features")

    def fit(train):
        w, b = models.fit_ridge(train, ["volume", "mass"], "y")
        return lambda held: held.select("p_partkey", "fold", models.linear(["volume", "mass"], w, b).alias("oof_price"), "y")

    return models.out_of_fold(rows, fit, 3)


@query("e01_stack")
def e01(s, d):
    """500 rounds at most, stopped after 50 without a lower error of the held fifth."""
    rows = written(relate.dealt(_pred(s, d), "p_partkey", 100_000), "stack").withColumn("held", splits.bucket(F.col("p_partkey"), 5) == 0)
    model = models.fit_stack(rows.where("NOT held"), ["a", "b"], "y", rows.where("held"), rate=0.3, depth=2, bins=255)
    return model.transform(rows, "price", 0.01).select("p_partkey", "price")


@query("v02_scorer_batches", "SELECT p_partkey, length(p_name)::DOUBLE AS price FROM part")
def v02(s, d):
    """The slot for a language model, here filled by one that answers with the text's length."""
    made = models.score(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "answer", lambda: lambda batch: batch.str.len().astype(str))
    return made.select("p_partkey", metrics.parse_number(F.col("answer")).alias("price"))


# stream


@query("k04_stream_last_wins", "SELECT user_id, event_id, k FROM (SELECT user_id, event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream(s, d):
    """Events as files of a stream (in order of id), extracted batch by batch, compacted to each user's last."""
    src, out, state = (scratch(s, n) for n in ("stream-in", "stream-out", "stream-state"))
    table(s, d, "events").select("event_id", "user_id", "props").repartitionByRange(3, "event_id").write.parquet(src)
    rows = s.readStream.schema("event_id long, user_id long, props string").option("maxFilesPerTrigger", 1).parquet(src)
    checkpoint.append_stream(rows, lambda b: b.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")), out, state)
    last = relate.keep_last(s.read.option("basePath", out).parquet(f"{out}/batch=*"), "user_id", [F.col("event_id")])
    return last.select("user_id", "event_id", "k")


@query("t04_fit_on_train", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part WHERE p_partkey % 2 = 0)) / (SELECT stddev_samp(p_retailprice) FROM part WHERE p_partkey % 2 = 0), 6) AS z FROM part")
def t04(s, d):
    """A scaler fitted on the training half, applied to all."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=["p_retailprice"], outputCol="v").transform(table(s, d, "part").select("p_partkey", "p_retailprice"))
    model = StandardScaler(withMean=True, inputCol="v", outputCol="z").fit(rows.where("p_partkey % 2 = 0"))
    return model.transform(rows).select("p_partkey", _r(vector_to_array("z")[0]).alias("z"))


@query("u04_feature_concat", "SELECT p_partkey, 3 AS size, p_size::DOUBLE + p_retailprice + 1 AS total FROM part")
def u04(s, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(1.0).alias("one"))
    made = VectorAssembler(inputCols=["p_size", "p_retailprice", "one"], outputCol="v").transform(rows).withColumn("a", vector_to_array("v"))
    return made.select("p_partkey", F.size("a").alias("size"), (F.col("a")[0] + F.col("a")[1] + F.col("a")[2]).alias("total"))


@query("s19_saved_model", "SELECT p_partkey, (p_size > 25)::INT AS bucket FROM part")
def s19(s, d):
    """A model saved, loaded and applied."""
    from pyspark.ml.feature import Binarizer

    path = scratch(s, "model")
    rows = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    Binarizer(threshold=25, inputCol="x", outputCol="y").write().overwrite().save(path)
    return Binarizer.load(path).transform(rows).select("p_partkey", F.col("y").cast("int").alias("bucket"))


@query("b05_batch_inference", f"WITH {PRED} SELECT p_partkey, round(greatest(a - 950, 0), 6) AS price FROM p")
def b05(s, d):
    return _pred(s, d).select("p_partkey", _r(F.greatest(models.linear(["a"], [1.0], -950.0), F.lit(0.0))).alias("price"))
