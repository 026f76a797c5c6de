"""Scans, joins, projection, imputation, aggregation, order and sets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.operators import quantiles, relate, splits
from larkmill.sources import readers, sinks

from .registry import query, scratch, table

ORDER_LINES = "lines AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY l_orderkey)"


def _lines(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 6).alias("qty"))


@query("s01_csv_scan", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def s01(s, d):
    path = scratch(s, "csv")
    sinks.write_csv(table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return readers.read_required(s, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("s03_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def s03(s, d):
    return readers.read_any(s, f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").where("l_quantity >= 45")


@query("s05_preferred_source", "SELECT p_partkey AS sample_id, p_retailprice AS price, p_size AS pack_count, cast(p_partkey % 7 AS BIGINT) AS text_kmeans_cluster_id FROM part")
def s05(s, d):
    base = scratch(s, "features")
    p = table(s, d, "part")
    sinks.write_csv(p.selectExpr("p_partkey AS sample_id", "p_retailprice AS price", "p_size AS pack_count"), f"{base}/a.csv")
    p.selectExpr("p_partkey AS sample_id", "0 AS pack_count", "p_partkey % 7 AS text_kmeans_cluster_id").write.parquet(f"{base}/b.parquet")
    master = readers.first_existing(s, [f"{base}/master.parquet", f"{base}/master.csv"])
    if master is not None:
        return master
    parts = [readers.read_any(s, f"{base}/b.parquet"), readers.read_any(s, f"{base}/a.csv", "sample_id long, price double, pack_count int")]
    return relate.fold_left(parts, "sample_id", "price").select("sample_id", "price", "pack_count", "text_kmeans_cluster_id")


@query("s06_json_scan", "SELECT conv_id, turn, role, text FROM conversations")
def s06(s, d):
    path = scratch(s, "json")
    table(s, d, "conversations").write.json(path)
    return readers.read_jsonl(s, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", "text")


@query("s07_malformed_lines", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS bad FROM events")
def s07(s, d):
    lines = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("props"))
    return readers.parse_jsonl(lines, "props", "k long").select("event_id", F.when(~F.col("bad"), F.col("k")).alias("k"), "bad")


@query("s09_embedding_scan", "SELECT vec_id, len(embedding)::INT AS size, missing FROM (SELECT vec_id, embedding, 0 AS missing FROM embeddings)")
def s09(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size("embedding").alias("size"), F.lit(0).alias("missing"))


@query("s14_fetch_plan", """SELECT DISTINCT url AS link, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages
WHERE url LIKE 'http%' AND regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) NOT IN (SELECT regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) FROM pages WHERE page_id % 3 = 0)""")
def s14(s, d):
    from larkmill.functions.extract import url_filename

    pages = table(s, d, "pages")
    have = pages.where("page_id % 3 = 0").select(url_filename(F.col("url")).alias("name"))
    return readers.to_fetch(pages, "url", have, "name")


@query("k02_replace_parquet", "SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def k02(s, d):
    path = scratch(s, "swap")
    table(s, d, "nation").write.parquet(path)
    own = s.read.parquet(path)
    sinks.replace_parquet(own.withColumn("n_regionkey", F.col("n_regionkey") + 1), path)
    return s.read.parquet(path)


@query("k03_chosen_format", "SELECT s_suppkey, s_name FROM supplier")
def k03(s, d):
    path = scratch(s, "orc")
    sinks.write_any(table(s, d, "supplier").select("s_suppkey", "s_name"), path, "orc")
    sinks.write_any(table(s, d, "supplier").select("s_suppkey", "s_name").limit(0), path, "orc", overwrite=False)
    return s.read.orc(path)


@query("k04_append", "SELECT event_id, user_id FROM events")
def k04(s, d):
    path = scratch(s, "append")
    e = table(s, d, "events").select("event_id", "user_id")
    sinks.append_csv(e.where("event_id % 2 = 0"), path)
    sinks.append_csv(e.where("event_id % 2 = 1"), path)
    return readers.read_csv(s, path, "event_id long, user_id long")


@query("k07_shards", "SELECT doc_id, cast((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS shard FROM documents")
def k07(s, d):
    return splits.sharded(table(s, d, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "shard")


@query("k09_report", "SELECT count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part")
def k09(s, d):
    path = scratch(s, "report")
    sinks.write_report(table(s, d, "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price")), path)
    return s.read.schema("n long, mean_price double").json(path)


@query("j01_inner", f"WITH {ORDER_LINES} SELECT o_orderkey, o_totalprice, n_lines, qty FROM orders JOIN lines ON o_orderkey = l_orderkey")
def j01(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").join(_lines(s, d), F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("j02_full_outer", """WITH a AS (SELECT doc_id, cast(n_chars AS DOUBLE) AS a FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, cast(quality + 1 AS DOUBLE) AS b FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a, (SELECT median(a) FROM a FULL JOIN b USING (doc_id))) AS a, coalesce(b, (SELECT median(b) FROM a FULL JOIN b USING (doc_id))) AS b FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j02(s, d):
    a = table(s, d, "documents").where("doc_id % 3 <> 0").selectExpr("doc_id", "cast(n_chars AS double) AS a")
    b = table(s, d, "labels").selectExpr("doc_id", "cast(quality + 1 AS double) AS b")
    return relate.with_median(a.join(b, "doc_id", "full"), ["a", "b"])


@query("j03_left", "SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j03(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j04_left_twice", "SELECT d.doc_id, toxic, label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def j04(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id", "left").join(e, "doc_id", "left")


@query("j05_clashing_names", "SELECT d.doc_id, n_chars, source, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j05(s, d):
    other = table(s, d, "labels").selectExpr("doc_id", "0 AS n_chars", "quality")
    return relate.join_left(table(s, d, "documents").select("doc_id", "n_chars", "source"), other, "doc_id")


@query("j06_fold_of_joins", """SELECT p_partkey, p_retailprice AS price, n, coalesce(qty, NULL) AS qty FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey
LEFT JOIN (SELECT l_partkey, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY 1) b ON p_partkey = b.l_partkey""")
def j06(s, d):
    li = table(s, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey").groupBy("p_partkey")
    a, b = li.agg(F.count(F.lit(1)).alias("n")), li.agg(F.round(F.sum("l_quantity"), 6).alias("qty"), F.lit(0).alias("n"))
    return relate.fold_left([a, table(s, d, "part").selectExpr("p_partkey", "p_retailprice AS price"), b], "p_partkey", "price").select("p_partkey", "price", "n", "qty")


@query("j07_one_to_one", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j07(s, d):
    return relate.join_one_to_one(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("j07_violations", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def j07v(s, d):
    return relate.repeated_keys(table(s, d, "conversations"), "conv_id")


@query("j09_text_back", "SELECT l.doc_id, coalesce(d.text, '') AS text FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id")
def j09(s, d):
    en = table(s, d, "documents").where("lang = 'en'").select("doc_id", "text")
    return table(s, d, "labels").select("doc_id").join(en, "doc_id", "left").fillna({"text": ""})


@query("j10_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id")
def j10(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id")


@query("j11_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j11(s, d):
    return table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("j12_in_all", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def j12(s, d):
    return relate.in_all([table(s, d, "documents"), table(s, d, "labels"), table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id")], "doc_id")


@query("j13_contains", """SELECT name, min(page_id) AS page_id FROM (SELECT DISTINCT regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages) f
JOIN pages ON regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) = name GROUP BY name""")
def j13(s, d):
    """The first row whose link has the file name: an equi-join on the derived name instead of a test of all pairs."""
    from larkmill.functions.extract import url_filename

    pages = table(s, d, "pages").select("page_id", url_filename(F.col("url")).alias("name"))
    return pages.select("name").distinct().join(pages.groupBy("name").agg(F.min("page_id").alias("page_id")), "name")


@query("j15_lookup", """WITH freq AS (SELECT p_brand, count(*) AS freq FROM part WHERE p_size > 10 GROUP BY 1 HAVING count(*) > 50)
SELECT p_partkey, coalesce(freq, 0) AS freq FROM part LEFT JOIN freq USING (p_brand)""")
def j15(s, d):
    p = table(s, d, "part")
    freq = p.where("p_size > 10").groupBy("p_brand").agg(F.count(F.lit(1)).alias("freq")).where("freq > 50")
    return p.join(freq, "p_brand", "left").select("p_partkey", F.coalesce("freq", F.lit(0)).alias("freq"))


@query("p01_subset", "SELECT p_partkey, p_brand FROM part WHERE p_size = 7")
def p01(s, d):
    return table(s, d, "part").where("p_size = 7").select("p_partkey", "p_brand")


@query("p02_rename", "SELECT p_partkey AS sample_id, p_retailprice AS price FROM part")
def p02(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice").withColumnsRenamed({"p_partkey": "sample_id", "p_retailprice": "price"})


@query("p03_drop", "SELECT r_regionkey FROM region")
def p03(s, d):
    return table(s, d, "region").drop("r_name", "not_there")


@query("p04_reindex", "SELECT cast(NULL AS DOUBLE) AS mass, n_name, cast(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def p04(s, d):
    return relate.reindexed(table(s, d, "nation"), {"mass": "double", "n_name": "string", "n_nationkey": "bigint"})


@query("p05_first_available", "SELECT o_orderkey, CASE WHEN (SELECT arg_min(ln(o_totalprice + 1), o_orderkey) FROM orders) < 15 THEN round(o_totalprice, 2) ELSE NULL END AS prediction FROM orders")
def p05(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.log1p("o_totalprice").alias("oof_log_price"))
    out = relate.prediction_column(df, "o_orderkey", [("oof_price", False), ("oof_log_price", True), ("oof_pred", False)])
    return out.select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@query("p06_constant", "SELECT s_suppkey, 0 AS fold FROM supplier")
def p06(s, d):
    df = table(s, d, "supplier").select("s_suppkey")
    return df if "fold" in df.columns else df.withColumn("fold", F.lit(0))


@query("p08_downcast", "SELECT cast(c_custkey AS INT) AS c_custkey, cast(c_acctbal AS FLOAT) AS c_acctbal FROM customer")
def p08(s, d):
    return relate.downcast(table(s, d, "customer").select("c_custkey", "c_acctbal"))


@query("p10_drop_null", "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def p10(s, d):
    return j03(s, d).dropna(subset=["quality"]).select("doc_id", "quality")


@query("p11_valid_link", "SELECT page_id, url LIKE 'http%' AS ok FROM pages")
def p11(s, d):
    return table(s, d, "pages").select("page_id", readers.fetchable(F.col("url")).alias("ok"))


@query("p14_modality_rows", "SELECT d.doc_id, e.vec_id IS NOT NULL AS has_image FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.doc_id % 2 = 1 OR e.vec_id IS NOT NULL")
def p14(s, d):
    """Training rows (even ids) need an image; test rows go on without."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has_image"))
    rows = table(s, d, "documents").select("doc_id").join(e, "doc_id", "left").fillna({"has_image": False})
    return rows.where((F.col("doc_id") % 2 == 1) | F.col("has_image"))


@query("p15_range_guard", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity ELSE 1.0 END AS pack_count,
CASE WHEN l_extendedprice BETWEEN 0 AND 50000 THEN l_extendedprice ELSE 0.0 END AS volume FROM lineitem""")
def p15(s, d):
    from larkmill.functions.extract import in_range

    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", in_range(F.col("l_quantity"), 5, 40, 1.0).alias("pack_count"), in_range(F.col("l_extendedprice"), 0, 50000, 0.0).alias("volume"))


@query("p16_clip", "SELECT c_custkey, greatest(c_acctbal, 0.01) AS price FROM customer")
def p16(s, d):
    return table(s, d, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.01)).alias("price"))


@query("p17_safe_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE cast(o_orderkey AS DOUBLE) / 4 END AS price FROM orders")
def p17(s, d):
    from larkmill.functions.metrics import parse_number

    text = F.when(F.col("o_orderkey") % 8 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("d"))).otherwise((F.col("o_orderkey").cast("double") / 4).cast("string"))
    return table(s, d, "orders").select("o_orderkey", parse_number(text).alias("price"))


@query("n01_constants", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(lang_label, 'Unknown') AS lang_label FROM documents d LEFT JOIN (SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'toxic' END AS lang_label FROM labels) l ON d.doc_id = l.doc_id")
def n01(s, d):
    lab = table(s, d, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 1, F.lit("toxic")).alias("lang_label"))
    return table(s, d, "documents").select("doc_id").join(lab, "doc_id", "left").fillna({"quality": -1, "lang_label": "Unknown"})


@query("n02_own_median", "SELECT o_orderkey, coalesce(v, (SELECT median(v) FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS v FROM orders))) AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS v FROM orders)")
def n02(s, d):
    return relate.with_median(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("v")), ["v"])


@query("n03_train_median", "SELECT p_partkey, coalesce(v, (SELECT median(v) FROM (SELECT CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS v FROM part WHERE p_partkey % 3 > 0))) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS v FROM part)")
def n03(s, d):
    df = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("v"))
    return relate.with_median(df, ["v"], df.where("p_partkey % 3 > 0"))


@query("n05_missing_predictions", """SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 10 > 0 UNION ALL
SELECT p_partkey, (SELECT median(p_retailprice) FROM part WHERE p_partkey % 2 = 0) FROM part WHERE p_partkey % 10 = 0""")
def n05(s, d):
    p = table(s, d, "part").select("p_partkey", "p_retailprice")
    return relate.complete_predictions(p, p.where("p_partkey % 10 > 0"), p.where("p_partkey % 2 = 0"), "p_partkey", "p_retailprice")


@query("n07_unseen_category", "SELECT p_partkey, CASE WHEN p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey <= 20) THEN p_brand ELSE 'Unknown' END AS p_brand, 0.0::DOUBLE AS mass FROM part")
def n07(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand")
    made = relate.known_category(p, "p_brand", p.where("p_partkey <= 20"))
    return relate.aligned(made, {"p_brand": "Unknown", "mass": 0.0}, "p_partkey")


@query("a01_count", "SELECT count(*) AS n FROM lineitem")
def a01(s, d):
    return table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("a02_distinct_count", "SELECT count(DISTINCT url) AS n FROM pages")
def a02(s, d):
    return table(s, d, "pages").agg(F.count_distinct("url").alias("n"))


@query("a03_distinct", "SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")
def a03(s, d):
    return table(s, d, "documents").select("text").dropna().distinct()


@query("a04_mean_median", "SELECT round(avg(p_retailprice), 6) AS mean, median(p_retailprice) AS median, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")
def a04(s, d):
    c = F.col("p_retailprice")
    p = table(s, d, "part").select(c)
    middle = quantiles.medians(p, ["p_retailprice"])["p_retailprice"]
    return p.agg(F.round(F.avg(c), 6).alias("mean"), F.lit(middle).alias("median"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("a05_percentiles", "SELECT round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part")
def a05(s, d):
    low, high = quantiles.quantiles(table(s, d, "part"), ["p_retailprice"], [0.25, 0.75])["p_retailprice"]
    return s.range(1).select(F.round(F.lit(low), 6).alias("q25"), F.round(F.lit(high), 6).alias("q75"))


@query("a06_frequencies", "SELECT lower(trim(p_brand)) AS brand, count(*) AS n FROM part GROUP BY 1")
def a06(s, d):
    return table(s, d, "part").groupBy(F.lower(F.trim("p_brand")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("a08_group_stats", "SELECT p_brand, p_type, round(avg(p_retailprice), 6) AS mean_price, round(coalesce(stddev_samp(p_retailprice), 0), 6) AS std_price FROM part GROUP BY 1, 2")
def a08(s, d):
    return table(s, d, "part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("mean_price"), F.round(F.coalesce(F.stddev_samp("p_retailprice"), F.lit(0.0)), 6).alias("std_price"))


@query("a12_fold_spread", "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT p_size % 5 AS fold, avg(p_retailprice) AS x FROM part GROUP BY 1)")
def a12(s, d):
    x = table(s, d, "part").groupBy((F.col("p_size") % 5).alias("fold")).agg(F.avg("p_retailprice").alias("x"))
    return x.agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query("a13_top", "SELECT p_brand AS feature, count(*) AS importance FROM part GROUP BY 1 ORDER BY importance DESC, feature LIMIT 10")
def a13(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).alias("importance")).orderBy(F.desc("importance"), "feature").limit(10)


@query("a15_reconciliation", """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(DISTINCT text) FROM documents) AS n_texts, (SELECT count(*) FROM labels) AS n_labels,
round(100.0::DOUBLE * (SELECT count(*) FROM labels) / (SELECT count(*) FROM documents), 6) AS percent""")
def a15(s, d):
    docs = table(s, d, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("text").alias("n_texts"))
    both = docs.crossJoin(F.broadcast(table(s, d, "labels").agg(F.count(F.lit(1)).alias("n_labels"))))  # one row each
    return both.withColumn("percent", F.round(100.0 * F.col("n_labels") / F.col("n_rows"), 6))


@query("a17_duplicate_keys", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1)")
def a17(s, d):
    return relate.repeated_keys(table(s, d, "conversations"), "conv_id").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n"))


@query("a18_failure_rate", "SELECT round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM lineitem")
def a18(s, d):
    return table(s, d, "lineitem").agg(F.round(F.avg((F.col("l_discount") == 0).cast("double")), 6).alias("rate"))


@query("o01_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def o01(s, d):
    return relate.keep_last(table(s, d, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("o04_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def o04(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey")


@query("o05_best_of_group", "SELECT p_brand, arg_max(p_partkey, (p_size * 1000000 + p_partkey)) AS p_partkey FROM part GROUP BY 1")
def o05(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"))


@query("o06_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT cast(least(1000, greatest(100, floor(count(*) * 0.2))) AS BIGINT) FROM documents)")
def o06(s, d):
    docs = table(s, d, "documents").select("doc_id")
    return docs.orderBy("doc_id").limit(int(min(1000, max(100, docs.count() * 0.2))))


@query("o07_tuning_rows", "SELECT p_partkey FROM part ORDER BY cast((((p_partkey * 2654435761) % 4294967296) // 65536) % 65536 AS INT), p_partkey LIMIT (SELECT cast(greatest(100, floor(count(*) * 0.3)) AS BIGINT) FROM part)")
def o07(s, d):
    p = table(s, d, "part").select("p_partkey")
    return p.orderBy(splits.hash_order(F.col("p_partkey")), "p_partkey").limit(int(max(100, p.count() * 0.3)))


@query("u01_union_all", "SELECT doc_id, quality, NULL::BIGINT AS n_chars FROM labels UNION ALL SELECT doc_id, NULL, n_chars FROM documents")
def u01(s, d):
    return table(s, d, "labels").select("doc_id", "quality").unionByName(table(s, d, "documents").select("doc_id", "n_chars"), allowMissingColumns=True)


@query("u02_column_concat", "SELECT p_partkey, p_size * 2 AS twice, p_size % 3 = 0 AS third FROM part")
def u02(s, d):
    return table(s, d, "part").select("p_partkey", F.struct((F.col("p_size") * 2).alias("twice"), (F.col("p_size") % 3 == 0).alias("third")).alias("x")).select("p_partkey", "x.*")


@query("u03_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


HASH = "cast((((p_partkey * 2654435761) % 4294967296) // 65536) % {n} AS INT)"


@query("x01_folds", f"SELECT p_partkey, {HASH.format(n=5)} AS fold FROM part")
def x01(s, d):
    return splits.folded(table(s, d, "part").select("p_partkey"), "p_partkey")


@query("x02_split_90_10", f"SELECT p_partkey, CASE WHEN {HASH.format(n=100)} < 90 THEN 'train' ELSE 'test' END AS split FROM part")
def x02(s, d):
    return splits.split(table(s, d, "part").select("p_partkey"), "p_partkey", {"train": 90, "test": 10})


@query("x03_split_60_20_20", f"SELECT p_partkey, CASE WHEN {HASH.format(n=100)} < 60 THEN 'train' WHEN {HASH.format(n=100)} < 80 THEN 'valid' ELSE 'test' END AS split FROM part")
def x03(s, d):
    return splits.split(table(s, d, "part").select("p_partkey"), "p_partkey", {"train": 60, "valid": 20, "test": 20})


@query("x04_disjoint_samples", f"SELECT p_partkey, CASE WHEN r <= 100 THEN 'train' ELSE 'valid' END AS part FROM (SELECT p_partkey, row_number() OVER (ORDER BY {HASH.format(n=65536)}, p_partkey) AS r FROM part) WHERE r <= 150")
def x04(s, d):
    a, b = splits.disjoint_samples(table(s, d, "part").select("p_partkey"), "p_partkey", 100, 50)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("valid")))


@query("s02_required", "SELECT n_name FROM nation")
def s02(s, d):
    return readers.read_required(s, f"{d}/nation.parquet").select("n_name")


@query("s04_by_ending", "SELECT r_name, 'csv' AS kind FROM region UNION ALL SELECT r_name, 'parquet' FROM region UNION ALL SELECT r_name, 'jsonl' FROM region")
def s04(s, d):
    base, r = scratch(s, "kinds"), table(s, d, "region").select("r_name")
    sinks.write_csv(r, f"{base}/r.csv")
    r.write.parquet(f"{base}/r.parquet")
    r.write.json(f"{base}/r.jsonl")
    parts = [readers.read_any(s, f"{base}/r.{k}", "r_name string").select("r_name", F.lit(k).alias("kind")) for k in ("csv", "parquet", "jsonl")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s08_record_array", "SELECT n_nationkey, n_name FROM nation")
def s08(s, d):
    """A file that is one JSON array of records."""
    path = f"{scratch(s, 'array')}/nation.json"
    one = table(s, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    one.coalesce(1).write.text(path)
    return s.read.schema("n_nationkey int, n_name string").json(path, multiLine=True)


@query("s17_listing", "SELECT 5::BIGINT AS n_files, 0::BIGINT AS n_empty")
def s17(s, d):
    base = scratch(s, "listing")
    table(s, d, "region").select("r_name").repartition(5, "r_name").write.option("maxRecordsPerFile", 1).csv(base)
    own = readers.list_files(s, base, (".csv",))
    return own.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum((F.col("length") == 0).cast("long")), F.lit(0)).alias("n_empty"))


@query("k05_skip_if_there", "SELECT count(*) AS n FROM nation")
def k05(s, d):
    """A second save without overwrite leaves the first as it is."""
    path = scratch(s, "once")
    sinks.write_any(table(s, d, "nation"), path)
    sinks.write_any(table(s, d, "nation").limit(1), path, overwrite=False)
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("k10_importances", "SELECT p_type AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1 ORDER BY importance DESC, feature")
def k10(s, d):
    path = scratch(s, "importance")
    made = table(s, d, "part").groupBy(F.col("p_type").alias("feature")).agg(F.round(F.avg("p_retailprice"), 4).alias("importance"))
    sinks.write_csv(made.orderBy(F.desc("importance"), "feature"), path)
    return readers.read_csv(s, path, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@query("k13_rebuild", "SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def k13(s, d):
    """A rebuild leaves nothing of the output before it."""
    path = scratch(s, "rebuild")
    r = table(s, d, "region").select("r_regionkey")
    sinks.write_any(r, path)
    sinks.write_any(r.where("r_regionkey > 2"), path)
    return s.read.parquet(path)


@query("a16_counters", "SELECT (SELECT count(*) FROM events WHERE value > 50)::BIGINT AS written, (SELECT count(*) FROM events WHERE NOT value > 50)::BIGINT AS skipped")
def a16(s, d):
    rows = table(s, d, "events").select(F.to_json(F.struct("event_id", "value")).alias("line"), (F.col("value") > 50).alias("keep"))
    n = sinks.write_chat_lines(rows, scratch(s, "counted"))
    return s.range(1).select(F.lit(n["written"]).cast("long").alias("written"), F.lit(n["skipped"]).cast("long").alias("skipped"))


@query("j08_term_features", """WITH t AS (SELECT doc_id, count(*) AS n_terms FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents WHERE lang = 'de') WHERE w <> '' GROUP BY 1)
SELECT d.doc_id, lang, n_terms FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def j08(s, d):
    """Text features onto the structured table."""
    docs = table(s, d, "documents")
    terms = docs.where("lang = 'de'").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where("w <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"))
    return relate.join_left(docs.select("doc_id", "lang"), terms, "doc_id")
