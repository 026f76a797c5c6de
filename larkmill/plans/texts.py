"""Text cleaning, extraction, chat documents, vectors and term weights over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from larkmill.functions import chat, extract, tables, text, vectors
from larkmill.operators import fuzzy, tfidf
from larkmill.sources import sinks

from .registry import CATALOG_SQL, catalog, query, scratch, table, written

WITH = f"WITH {CATALOG_SQL}"
SQUEEZE = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}\x{{0085}}\x{{0B}}]+', ' ', 'g'))"


def _sql_list(items) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in items)


def _sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {_sql_any('lower(text)', terms)} THEN '{name}'" for name, terms in tables.CATEGORY_RULES) + f" ELSE '{tables.FALLBACK}' END"
KEYWORDS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_sql_any('lower(text)', tables.SYNONYMS.get(k, [k]))} THEN '{k}' END" for k in tables.KEYWORDS) + "], lambda x: x IS NOT NULL)"
FLAGS_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN 1 ELSE 0 END AS {extract.flag_name(k)}" for k in tables.FLAG_KEYWORDS)
VALUE_SQL = r"cast(nullif(regexp_extract(text, '\bValue:\s*([0-9]+(?:\.[0-9]+)?)', 1, 'i'), '') AS DOUBLE)"
UNIT_SQL = r"lower(trim(nullif(regexp_extract(text, '\bUnit:\s*([A-Za-z ]+)', 1, 'i'), '')))"
PACK_SQL = r"coalesce(" + ", ".join(rf"try_cast(regexp_extract(text, '{p.removeprefix('(?i)')}', 1, 'i') AS DOUBLE)" for p in extract.PACK_PATTERNS) + ")"
MASS_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(unit, '{p}') THEN value * {g}::DOUBLE" for p, g, _ in tables.PAIR_UNITS if g) + " ELSE 0.0 END"
VOLUME_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(unit, '{p}') THEN value * {v}::DOUBLE" for p, _, v in tables.PAIR_UNITS if v) + " ELSE 0.0 END"
TOTAL_PATTERN = r"(\d+(?:\.\d+)?)\s*(fl oz|oz|ounce|lb|pound|g|gram|kg|ml|l|liter|ct|count|pcs|pack)\b"


def _rate(units: dict[str, float]) -> str:
    return "CASE u " + " ".join(f"WHEN '{u}' THEN {r}::DOUBLE" for u, r in units.items()) + " ELSE 0.0 END"


TOTALS_SQL = f"""found AS (SELECT p_partkey, unnest(regexp_extract_all(lower(text), '{TOTAL_PATTERN}', 1)) AS v, unnest(regexp_extract_all(lower(text), '{TOTAL_PATTERN}', 2)) AS u, contains(lower(text), 'fl oz') AS fluid FROM catalog),
sums AS (SELECT p_partkey, sum(CASE WHEN u = 'oz' AND fluid THEN 0.0 ELSE v::DOUBLE * {_rate(tables.TOTAL_MASS)} END) AS m, sum(v::DOUBLE * {_rate(tables.TOTAL_VOLUME)}) AS l, sum(CASE WHEN u IN ({_sql_list(tables.TOTAL_COUNT)}) THEN v::DOUBLE ELSE 0 END) AS c FROM found GROUP BY 1),
totals AS (SELECT p_partkey, coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(c, 0) AS c, coalesce(greatest(try_cast(regexp_extract(lower(text), '(?:pack of|case of|x|×)\\s*(\\d+)', 1) AS DOUBLE), 1), 1) AS k FROM catalog LEFT JOIN sums USING (p_partkey))"""


@query("slice_catalog_features", f"""{WITH}, {TOTALS_SQL}, base AS (SELECT p_partkey, p_retailprice, {PACK_SQL} AS pack_count, {VALUE_SQL} AS value, {UNIT_SQL} AS unit, {CATEGORY_SQL} AS category, len({KEYWORDS_SQL}) AS num_keywords, p_name FROM catalog),
sized AS (SELECT *, {MASS_SQL} AS mass_g, {VOLUME_SQL} AS volume_ml FROM base),
stats AS (SELECT category, avg(p_retailprice) AS mean_price, coalesce(stddev_samp(p_retailprice), 0) AS std_price FROM base GROUP BY 1)
SELECT p_partkey, category, num_keywords::INT AS num_keywords, pack_count, round(mass_g, 6) AS mass_g, round(volume_ml, 6) AS volume_ml, round(mass_g / (volume_ml + 1e-6), 4) AS density,
round(m * k, 4) AS total_mass_g, round(l * k, 4) AS total_volume_ml, CASE WHEN c <> 0 THEN c ELSE k END AS total_count, round(mean_price, 6) AS mean_price, round(std_price, 6) AS std_price
FROM sized JOIN stats USING (category) JOIN totals USING (p_partkey)""")
def catalog_features(s, d):
    """Price statistics of a category joined to product facts from catalog text."""
    t = F.col("text")
    pair = extract.value_unit(t)
    base = catalog(s, d).select("p_partkey", "p_retailprice", extract.pack_count(t).alias("pack_count"), pair.alias("pair"), extract.category(t).alias("category"),
        F.size(extract.keywords(t)).alias("num_keywords"), extract.totals(t).alias("all"))
    base = base.withColumn("size", extract.to_mass_volume(F.col("pair.value"), F.col("pair.unit")))
    stats = base.groupBy("category").agg(F.avg("p_retailprice").alias("mean_price"), F.coalesce(F.stddev_samp("p_retailprice"), F.lit(0.0)).alias("std_price"))
    made = base.join(stats, "category")
    r = lambda c, n: F.round(F.col(c), n)
    return made.select("p_partkey", "category", "num_keywords", "pack_count", r("size.mass_g", 6).alias("mass_g"), r("size.volume_ml", 6).alias("volume_ml"),
        F.round(F.col("size.mass_g") / (F.col("size.volume_ml") + 1e-6), 4).alias("density"), r("all.mass_g", 4).alias("total_mass_g"), r("all.volume_ml", 4).alias("total_volume_ml"),
        F.col("all.count").alias("total_count"), r("mean_price", 6).alias("mean_price"), r("std_price", 6).alias("std_price"))


@query("f01_strip_tags", r"SELECT page_id, " + SQUEEZE.format("regexp_replace(html, '<.*?>', ' ', 'g')") + " AS text FROM pages")
def f01(s, d):
    return table(s, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("f02_squeeze", "SELECT doc_id, " + SQUEEZE.format("text") + " AS text FROM documents")
def f02(s, d):
    return table(s, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("text"))


@query("f03_camel_case", "SELECT s_suppkey, regexp_replace(replace(s_name, '#', 'x') || 'BearCreek', '([a-z])([A-Z])', '\\1 \\2', 'g') AS name FROM supplier")
def f03(s, d):
    return table(s, d, "supplier").select("s_suppkey", text.split_camel(F.concat(F.replace("s_name", F.lit("#"), F.lit("x")), F.lit("BearCreek"))).alias("name"))


@query("f04_brand_display", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Bear Creek ' || p_size WHEN 1 THEN 'Unknown' ELSE 'Mc Donald' END AS brand FROM part""")
def f04(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  BearCreek  "), F.col("p_size"), F.lit(" Pack_Count: 3"))).when(F.col("p_partkey") % 3 == 1, F.lit("  ")).otherwise(F.lit("McDonald"))
    return table(s, d, "part").select("p_partkey", text.brand_display(raw).alias("brand"))


@query("f05_brand_letters", "SELECT p_partkey, lower(regexp_replace(p_brand, '[^a-zA-Z]', '', 'g')) AS brand FROM part")
def f05(s, d):
    return table(s, d, "part").select("p_partkey", text.brand_letters(F.col("p_brand")).alias("brand"))


@query("f06_brand_canonical", r"SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(replace(lower(trim(p_name || ' & ' || p_brand)), '&', ' and '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), '') || ' members mark loreal' AS brand FROM part")
def f06(s, d):
    return table(s, d, "part").select("p_partkey", text.brand_canonical(F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" Member's Mark L’Oréal"))).alias("brand"))


@query("f07_trim_tail", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bear creek' WHEN 1 THEN 'foods company' ELSE p_name END AS brand FROM part")
def f07(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit("bear creek country kitchens")).when(F.col("p_partkey") % 3 == 1, F.lit("foods company")).otherwise(F.concat("p_name", F.lit(" foods inc")))
    return table(s, d, "part").select("p_partkey", text.trim_brand_tail(raw).alias("brand"))


@query("f09_truncate", "SELECT doc_id, substr(text, 1, 1500) AS text FROM documents")
def f09(s, d):
    return table(s, d, "documents").select("doc_id", text.cut(F.col("text")).alias("text"))


TITLE_SQL = r"trim(regexp_extract(regexp_extract(text, 'Item Name:\s*(.*)', 1, 'i'), '^(.*?)\s*(?:[-–—|,;/\n]|\(|\[|Pack of|Count|CT\b|$)', 1, 'i'))"


@query("f10_title", f"{WITH} SELECT p_partkey, {TITLE_SQL} AS title FROM catalog")
def f10(s, d):
    return catalog(s, d).select("p_partkey", extract.title(F.col("text")).alias("title"))


@query("f11_before_noun", f"{WITH}, t AS (SELECT p_partkey, string_split({TITLE_SQL} || ' Soup Bowl', ' ') AS w FROM catalog) SELECT p_partkey, array_to_string(w[1:coalesce(list_position(list_transform(w, lambda x: list_contains([{_sql_list(tables.PRODUCT_NOUNS)}], lower(regexp_replace(x, '[^A-Za-z]', '', 'g')))), true), 0) - 1], ' ') AS words FROM t")
def f11(s, d):
    return catalog(s, d).select("p_partkey", F.array_join(extract.before_noun(extract.words(F.concat(extract.title(F.col("text")), F.lit(" Soup Bowl")))), " ").alias("words"))


@query("f12_proper_run", f"{WITH}, t AS (SELECT p_partkey, regexp_extract({TITLE_SQL}, '^((?:[A-Z][\\w.-]*)(?: [A-Z][\\w.-]*)*)', 1) AS words FROM catalog) SELECT * FROM t")
def f12(s, d):
    return catalog(s, d).select("p_partkey", F.array_join(extract.proper_run(extract.words(extract.title(F.col("text")))), " ").alias("words"))


@query("f13_prefixes", f"{WITH}, t AS (SELECT p_partkey, string_split({TITLE_SQL}, ' ') AS w FROM catalog) SELECT p_partkey, unnest(list_transform(range(1, least(len(w), 4) + 1), lambda k: array_to_string(w[1:k], ' '))) AS prefix FROM t")
def f13(s, d):
    return catalog(s, d).select("p_partkey", F.explode(extract.prefixes(extract.words(extract.title(F.col("text"))))).alias("prefix"))


@query("f14_least_words", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 2 END AS least FROM part")
def f14(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit("Bear Creek Soup")).when(F.col("p_partkey") % 3 == 1, F.lit("Dr. Oetker")).otherwise(F.lit("Nestle Toll"))
    return table(s, d, "part").select("p_partkey", extract.least_brand_words(extract.words(raw)).alias("least"))


CANON_SQL = "list_transform({0}, lambda x: lower(x))"
LEXICON_SQL = f"""t AS (SELECT p_partkey, string_split({TITLE_SQL}, ' ') AS w FROM catalog), pre AS (SELECT p_partkey, unnest(list_transform(range(1, least(len(w), 4) + 1), lambda k: lower(array_to_string(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))[1:k], ' ')))) AS c FROM (SELECT p_partkey, list_filter(w, lambda x: regexp_matches(x, '^[A-Z]')) AS w FROM t)),
lexicon AS (SELECT c AS brand, count(*) AS freq FROM pre GROUP BY 1)"""


@query("a07_lexicon", f"{WITH}, {LEXICON_SQL} SELECT brand, freq FROM lexicon")
def a07(s, d):
    return lexicon(catalog(s, d))


def lexicon(rows):
    """Frequency of canonical title prefixes; trimmed forms count where they differ."""
    made = rows.select(F.explode(extract.brand_candidates(F.col("text"))).alias("c")).where(F.col("c").isNotNull())
    both = made.select(F.explode(F.array_distinct(F.array("c", text.trim_brand_tail(F.col("c"))))).alias("brand"))
    return both.groupBy("brand").agg(F.count(F.lit(1)).alias("freq"))


@query("f15_lexicon_brand", f"{WITH}, {LEXICON_SQL} SELECT p_partkey, arg_max(c, freq * 1000000 + len(string_split(c, ' ')) * 1000 + length(c)) AS brand FROM pre JOIN lexicon ON c = brand GROUP BY 1")
def f15(s, d):
    rows = catalog(s, d)
    found = rows.select("p_partkey", F.explode(extract.brand_candidates(F.col("text"))).alias("c")).where(F.col("c").isNotNull())
    scored = found.join(lexicon(rows), F.col("c") == F.col("brand"))
    return scored.groupBy("p_partkey").agg(F.max_by(text.trim_brand_tail(F.col("c")), F.struct("freq", F.size(F.split("c", " ")), F.length("c"))).alias("brand"))


@query("f16_rule_brand", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Bear Creek' WHEN 1 THEN NULL WHEN 2 THEN 'Acme Foods' ELSE 'Zed Soup' END AS brand FROM part")
def f16(s, d):
    k = F.col("p_partkey") % 4
    raw = (F.when(k == 0, F.lit("Item Name: Bear Creek Hearty Soup Bowl, Creamy Chicken\nValue: 11.4")).when(k == 1, F.lit("Item Name: Organic Green Tea Bags, 20 Count"))
        .when(k == 2, F.concat(F.lit("Item Name: Women's Acme Foods "), F.col("p_size"), F.lit(" oz"))).otherwise(F.lit("Zed Soup Best / more")))
    return table(s, d, "part").select("p_partkey", extract.rule_brand(raw).alias("brand"))


@query("f17_valid_brand", "SELECT p_partkey, p_partkey % 5 IN (3, 4) AS valid FROM part")
def f17(s, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.lit("Pack of 6")).when(k == 1, F.lit("12")).when(k == 2, F.lit("  ")).when(k == 3, F.col("p_name")).otherwise(F.lit("Bear Creek"))
    return table(s, d, "part").select("p_partkey", extract.valid_brand(raw).alias("valid"))


@query("f18_suspicious", "SELECT p_partkey, p_partkey % 4 <> 3 AS odd FROM part")
def f18(s, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.concat("p_size", F.lit(" oz Tea"))).when(k == 2, F.lit("one two three four five six")).otherwise(F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", extract.suspicious_brand(raw).alias("odd"))


@query("p12_confident_rows", f"{WITH} SELECT p_partkey FROM catalog WHERE {CATEGORY_SQL} <> '{tables.FALLBACK}' AND length(text) > 10")
def p12(s, d):
    return catalog(s, d).where((extract.category(F.col("text")) != tables.FALLBACK) & (F.length("text") > 10)).select("p_partkey")


@query("p13_gazetteer", "SELECT p_brand AS name FROM part GROUP BY 1 HAVING count(*) >= 2 OR length(p_brand) <= 12")
def p13(s, d):
    return fuzzy.gazetteer(table(s, d, "part").where(~extract.suspicious_brand(F.col("p_brand"))), "p_brand")


@query("f19_pack_count", f"{WITH} SELECT p_partkey, {PACK_SQL} AS pack_count FROM catalog")
def f19(s, d):
    return catalog(s, d).select("p_partkey", extract.pack_count(F.col("text")).alias("pack_count"))


@query("f20_value_unit", f"{WITH} SELECT p_partkey, {VALUE_SQL} AS value, {UNIT_SQL} AS unit FROM catalog")
def f20(s, d):
    return catalog(s, d).select("p_partkey", extract.value_unit(F.col("text")).alias("x")).select("p_partkey", "x.*")


@query("f21_url_filename", "SELECT page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS name FROM pages")
def f21(s, d):
    return table(s, d, "pages").select("page_id", extract.url_filename(F.col("url")).alias("name"))


@query("f22_id_filename", r"SELECT page_id, page_id || coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(\.[A-Za-z0-9]+)$', 1), ''), '.jpg') AS name FROM pages")
def f22(s, d):
    return table(s, d, "pages").select("page_id", extract.id_filename(F.col("page_id"), F.col("url")).alias("name"))


def _answer():
    return F.concat(F.lit("brand: Bear Creek\npack_count: "), F.col("p_size"), F.lit("\nweight_g: 53.9\nvolume_ml: 60000\nkeywords: organic, nonsense, Vegan\ncategory: canned & packaged goods"))


@query("f23_response", "SELECT p_partkey, 'Bear Creek' AS brand, p_size::DOUBLE AS pack_count, 53.9::DOUBLE AS mass_g, 0.0::DOUBLE AS volume_ml, 'organic|vegan' AS keywords, 'Canned & Packaged Goods' AS category FROM part")
def f23(s, d):
    made = table(s, d, "part").select("p_partkey", extract.response_record(_answer()).alias("r"))
    return made.select("p_partkey", "r.brand", "r.pack_count", "r.mass_g", "r.volume_ml", F.array_join("r.keywords", "|").alias("keywords"), "r.category")


@query("f24_fallbacks", f"""{WITH}, b AS (SELECT *, {PACK_SQL} AS pc, {VALUE_SQL} AS value, {UNIT_SQL} AS unit, {CATEGORY_SQL} AS cat FROM catalog)
SELECT p_partkey, CASE WHEN pc > 1 THEN pc ELSE 1.0 END AS pack_count, round({MASS_SQL}, 6) AS mass_g, round({VOLUME_SQL}, 6) AS volume_ml, array_to_string(list_sort(list_distinct(list_concat({KEYWORDS_SQL}, ['keto']))), '|') AS keywords, CASE WHEN cat <> '{tables.FALLBACK}' THEN cat ELSE 'Baby Food' END AS category FROM b""")
def f24(s, d):
    record = extract.response_record(F.lit("brand: none\nkeywords: keto\ncategory: baby food"))
    made = catalog(s, d).select("p_partkey", extract.with_fallbacks(record, F.col("text")).alias("r"))
    return made.select("p_partkey", "r.pack_count", F.round("r.mass_g", 6).alias("mass_g"), F.round("r.volume_ml", 6).alias("volume_ml"), F.array_join("r.keywords", "|").alias("keywords"), "r.category")


@query("f25_totals", f"{WITH}, {TOTALS_SQL} SELECT p_partkey, round(m * k, 4) AS mass_g, round(l * k, 4) AS volume_ml, CASE WHEN c <> 0 THEN c ELSE k END AS count FROM totals")
def f25(s, d):
    made = catalog(s, d).select("p_partkey", extract.totals(F.col("text")).alias("t"))
    return made.select("p_partkey", F.round("t.mass_g", 4).alias("mass_g"), F.round("t.volume_ml", 4).alias("volume_ml"), F.col("t.count").alias("count"))


@query("f26_convert", f"{WITH}, b AS (SELECT p_partkey, {VALUE_SQL} AS value, {UNIT_SQL} AS unit FROM catalog) SELECT p_partkey, round({MASS_SQL}, 6) AS mass_g, round({VOLUME_SQL}, 6) AS volume_ml FROM b")
def f26(s, d):
    pair = extract.value_unit(F.col("text"))
    made = catalog(s, d).select("p_partkey", extract.to_mass_volume(pair["value"], pair["unit"]).alias("x"))
    return made.select("p_partkey", F.round("x.mass_g", 6).alias("mass_g"), F.round("x.volume_ml", 6).alias("volume_ml"))


@query("f27_keywords", f"{WITH} SELECT p_partkey, array_to_string({KEYWORDS_SQL}, '|') AS keywords FROM catalog")
def f27(s, d):
    return catalog(s, d).select("p_partkey", F.array_join(extract.keywords(F.col("text")), "|").alias("keywords"))


@query("f28_category", f"{WITH} SELECT p_partkey, {CATEGORY_SQL} AS category FROM catalog")
def f28(s, d):
    return catalog(s, d).select("p_partkey", extract.category(F.col("text")).alias("category"))


@query("f29_keyword_flags", f"{WITH}, k AS (SELECT p_partkey, {KEYWORDS_SQL} AS k FROM catalog) SELECT p_partkey, " + ", ".join(f"list_contains(k, '{w}')::INT AS \"{extract.flag_name(w)}\"" for w in tables.KEYWORDS) + " FROM k")
def f29(s, d):
    return catalog(s, d).select("p_partkey", extract.keywords(F.col("text")).alias("k")).select("p_partkey", *extract.keyword_flags(F.col("k")))


@query("f30_text_flags", f"{WITH} SELECT p_partkey, {FLAGS_SQL} FROM catalog")
def f30(s, d):
    return catalog(s, d).select("p_partkey", *extract.text_flags(F.col("text")))


MAIN_FLAGS = ["organic", "premium", "gourmet", "vegan", "natural", "keto"]


@query("f31_main_flags", f"{WITH}, k AS (SELECT p_partkey, {KEYWORDS_SQL} AS k FROM catalog) SELECT p_partkey, " + ", ".join(f"list_contains(k, '{w}')::INT AS is_{w}" for w in MAIN_FLAGS) + " FROM k")
def f31(s, d):
    flags = f29(s, d)
    names = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(c.removeprefix("flag_").replace("_", " "))) for c in flags.columns if c.startswith("flag_")]))
    return flags.select("p_partkey", names.alias("k")).select("p_partkey", *[F.array_contains("k", w).cast("int").alias(f"is_{w}") for w in MAIN_FLAGS])


@query("f32_canonical_keywords", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'vegan|organic' END AS keywords FROM part")
def f32(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit(" N/A ")).otherwise(F.lit("Vegan, fancy ,organic,vegan"))
    return table(s, d, "part").select("p_partkey", F.array_join(extract.canonical_keywords(raw), "|").alias("keywords"))


@query("f33_canonical_category", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Oils, Vinegars & Dressings' WHEN 1 THEN 'Baby Food' ELSE '{tables.FALLBACK}' END AS category FROM part")
def f33(s, d):
    k = F.col("p_partkey") % 3
    return table(s, d, "part").select("p_partkey", extract.canonical_category(F.when(k == 0, F.lit("oils, vinegars & dressings")).when(k == 1, F.lit("Baby Food")).otherwise(F.col("p_type"))).alias("category"))


@query("f34_sentence", """SELECT p_partkey, 'Brand: ' || p_brand || '.' || CASE WHEN p_size % 2 = 0 THEN ' Category: ' || p_type || '.' ELSE '' END || CASE WHEN p_size > 1 THEN ' Pack of ' || p_size || '.' ELSE '' END
|| CASE WHEN p_size > 25 THEN ' Weight: ' || (p_size // 2) || CASE WHEN p_size % 2 = 1 THEN '.50g.' ELSE '.00g.' END ELSE '' END || ' Features: organic, vegan.' AS text FROM part""")
def f34(s, d):
    c = F.col
    made = extract.sentence(c("p_brand"), F.when(c("p_size") % 2 == 0, c("p_type")), c("p_size"), F.when(c("p_size") > 25, c("p_size") / 2), F.lit(0.0), F.array(F.lit("organic"), F.lit("vegan")))
    return table(s, d, "part").select("p_partkey", made.alias("text"))


@query("a09_flag_sum", f"{WITH} SELECT p_partkey, ({' + '.join(x.rsplit(' AS ', 1)[0] for x in FLAGS_SQL.split(', CASE') for x in ['CASE' + x if not x.startswith('CASE') else x])}) AS total_flags FROM catalog")
def a09(s, d):
    flags = f30(s, d)
    return flags.select("p_partkey", reduce(lambda a, b: a + b, [F.col(c) for c in flags.columns if c.startswith("flag_")]).alias("total_flags"))


@query("a10_keyword_count", f"{WITH} SELECT p_partkey, len({KEYWORDS_SQL})::INT AS num_keywords FROM catalog")
def a10(s, d):
    flags = f29(s, d)
    return flags.select("p_partkey", reduce(lambda a, b: a + b, [(F.col(f"`{c}`") == 1).cast("int") for c in flags.columns if c.startswith("flag_")]).alias("num_keywords"))


@query("o02_ordered_distinct", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a|' || p_size ELSE 'a|' || p_size || '|b' END AS x FROM part")
def o02(s, d):
    raw = F.array(F.lit("a"), F.col("p_size").cast("string"), F.lit("a"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.lit("b")))
    return table(s, d, "part").select("p_partkey", F.array_join(F.array_distinct(raw), "|").alias("x"))


@query("o03_list_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(['vegan', p_type, 'keto', p_name])), '|') AS x FROM part")
def o03(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(F.sort_array(F.array_union(F.array(F.lit("vegan"), F.col("p_type")), F.array(F.lit("keto"), F.col("p_name"), F.lit("vegan")))), "|").alias("x"))


# chat documents


def _chats(s, d, training: bool):
    p = table(s, d, "part")
    image = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("img/"), F.col("p_partkey"), F.lit(".jpg")))
    return p.select("p_partkey", chat.messages(F.col("p_name"), image, F.col("p_size") + 0.25, training).alias("messages"))


@query("q01_messages", f"""SELECT p_partkey, '[{{"role":"system","content":"{chat.SYSTEM}"}},' || CASE WHEN p_partkey % 3 = 0 THEN '{{"role":"user","content":[{{"type":"image","image":"img/' || p_partkey || '.jpg"}},{{"type":"text","text":"' || p_name || '"}}]}}'
ELSE '{{"role":"user","content":"' || p_name || '"}}' END || ',{{"role":"assistant","content":"' || p_size || '.25"}}]' AS json FROM part""".replace("{{", "{").replace("}}", "}"))
def q01(s, d):
    return _chats(s, d, True).select("p_partkey", chat.as_union_json(F.col("messages")).alias("json"))


@query("q02_first_image", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'img/' || p_partkey || '.jpg' END AS image FROM part")
def q02(s, d):
    return _chats(s, d, True).select("p_partkey", chat.first_image(F.col("messages")).alias("image"))


@query("q03_all_images", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n FROM part")
def q03(s, d):
    return _chats(s, d, True).select("p_partkey", F.size(chat.images(F.col("messages"))).alias("n"))


@query("q04_prompt_target", "SELECT p_partkey, 2 AS n_prompt, p_size || '.25' AS target FROM part")
def q04(s, d):
    return _chats(s, d, True).select("p_partkey", F.size(chat.prompt(F.col("messages"))).alias("n_prompt"), chat.target(F.col("messages")).alias("target"))


@query("q04_conversations", "SELECT conv_id, count(*)::INT AS n_turns, arg_max(text, turn) AS last_text, count(*) FILTER (role = 'assistant')::INT AS n_answers FROM conversations GROUP BY 1")
def q04c(s, d):
    rows = chat.from_turns(table(s, d, "conversations"))
    return rows.select("conv_id", F.size("turns").alias("n_turns"), F.element_at("turns", -1)["text"].alias("last_text"), F.size(F.filter("turns", lambda t: t["role"] == "assistant")).alias("n_answers"))


@query("a14_image_messages", "SELECT count(*) FILTER (p_partkey % 3 = 0)::BIGINT AS n FROM part")
def a14(s, d):
    return _chats(s, d, True).agg(F.sum(chat.messages_with_image(F.col("messages"))).cast("long").alias("n"))


@query("q06_prompt_template", "SELECT p_partkey, 'Product: ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Answer with a price.' AS prompt FROM part")
def q06(s, d):
    return table(s, d, "part").select("p_partkey", F.format_string("Product: %s\nBrand: %s\nAnswer with a price.", "p_name", "p_brand").alias("prompt"))


@query("k06_chat_lines", "SELECT (SELECT count(*) FROM part WHERE p_partkey % 3 = 0)::BIGINT AS written, (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0)::BIGINT AS skipped, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0)::BIGINT AS read_back")
def k06(s, d):
    """Training lines need an image; the counters come from the same pass that writes."""
    path = scratch(s, "chat")
    rows = _chats(s, d, True).select(chat.as_union_json(F.col("messages")).alias("line"), chat.first_image(F.col("messages")).isNotNull().alias("keep"))
    n = sinks.write_chat_lines(rows, path)
    return s.read.text(path).agg(F.count(F.lit(1)).alias("read_back")).select(F.lit(n["written"]).cast("long").alias("written"), F.lit(n["skipped"]).cast("long").alias("skipped"), "read_back")


# vectors


@query("m03_masked_pooling", "SELECT vec_id, round((embedding[1]::DOUBLE + 3 * embedding[2]::DOUBLE) / 2, 4) AS x FROM embeddings")
def m03(s, d):
    e = table(s, d, "embeddings")
    e = e.withColumn("embedding", F.col("embedding").cast("array<double>"))
    tokens = F.array(F.slice("embedding", 1, 1), F.transform(F.slice("embedding", 2, 1), lambda x: x.cast("double") * 3), F.slice("embedding", 3, 1))
    return e.select("vec_id", F.round(vectors.pooled(tokens, F.array(F.lit(1), F.lit(1), F.lit(0)), 1)[0], 4).alias("x"))


@query("m04_normalise", "SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS x1, round(e[64] / sqrt(list_dot_product(e, e)), 6) AS x64 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)")
def m04(s, d):
    v = vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 6).alias("x1"), F.round(F.col("v")[63], 6).alias("x64"))


@query("m05_standardise", "SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size FROM part")
def m05(s, d):
    made = vectors.standardised(table(s, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], "p_partkey")
    return made.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("p_size", 6).alias("p_size"))


@query("m06_grid", "SELECT vec_id, (label + 1) * 2 * 3 = 12 AS ok FROM embeddings")
def m06(s, d):
    return table(s, d, "embeddings").select("vec_id", vectors.grid_matches(F.array(F.col("label") + 1, F.lit(2), F.lit(3)).cast("array<bigint>"), F.lit(12)).alias("ok"))


@query("m07_pad_labels", "SELECT p_partkey, 3 AS n, CASE WHEN p_size = 0 OR p_size >= 40 THEN -100 ELSE p_size END AS first, -100 AS last FROM part")
def m07(s, d):
    ids = vectors.padded(F.array(F.col("p_size"), F.lit(7)), F.lit(3))
    lab = vectors.training_labels(ids, 0, 40)
    return table(s, d, "part").select("p_partkey", F.size(ids).alias("n"), lab[0].alias("first"), lab[2].alias("last"))


@query("n04_zero_vectors", "SELECT doc_id, vec_id IS NULL AS missing, round(coalesce(embedding[1], 0)::DOUBLE, 6) AS x1, 64 AS size FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def n04(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = table(s, d, "documents").select("doc_id").join(e, "doc_id", "left").withColumn("v", vectors.or_zero(F.col("embedding"), 64))
    return rows.select("doc_id", (vectors.missing(F.col("embedding")) == 1).alias("missing"), F.round(F.col("v")[0], 6).alias("x1"), F.size("v").alias("size"))


@query("n06_missing_mask", "SELECT doc_id, (vec_id IS NULL)::INT AS missing_image FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def n06(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(s, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", vectors.missing(F.col("embedding")).alias("missing_image"))


@query("p09_fan_out", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS emb_{i:04d}" for i in range(64)) + " FROM embeddings")
def p09(s, d):
    return table(s, d, "embeddings").select("vec_id", *vectors.spread("embedding", "emb", 64))


@query("p07_prefix_columns", f"{WITH} SELECT {FLAGS_SQL} FROM catalog")
def p07(s, d):
    flags = f30(s, d)
    return flags.select([c for c in flags.columns if c.startswith("flag_")])


# term weights

TFIDF_SQL = """n AS (SELECT count(*) AS n FROM docs), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= {share} * (SELECT n FROM n)),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


#: Documents counted by one task: some have thousands of terms.
LONG_TEXTS = 1024


@query("t01_word_tfidf", r"""WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '\b[a-z0-9_][a-z0-9_]+\b') AS t FROM documents WHERE lang = 'en' AND doc_id % 4 = 1 AND regexp_matches(text, '^[\x00-\x7F]*$')),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM docs) GROUP BY 1, 2), """ + TFIDF_SQL.format(share=0.98))
def t01(s, d):
    docs = table(s, d, "documents").where("lang = 'en' AND doc_id % 4 = 1").where(F.col("text").rlike(r"^[\x00-\x7F]*$"))
    n = docs.count()
    made = tfidf.word_weights(docs.select("doc_id", "text"), "doc_id", "text", n, 3, 0.98, rows=LONG_TEXTS)
    return made.withColumn("weight", F.round("weight", 6))


@query("t01_word_tfidf_all")
def t01_all(s, d):
    """All documents and whole texts: lower case, no accents, three documents at least, 98 % at most, the 200,000 commonest terms."""
    docs = table(s, d, "documents")
    plain = docs.select("doc_id", text.without_accents(F.lower("text")).alias("text"))
    n = docs.count()
    return tfidf.word_weights(plain, "doc_id", "text", n, 3, 0.98, 200_000, LONG_TEXTS).withColumn("weight", F.round("weight", 6))


@query("t02_char_tfidf", r"""WITH docs AS (SELECT p_partkey AS doc_id, lower(p_name || ' ' || p_type) AS t FROM part),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(list_concat(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)), list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))), list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) AS term FROM docs) GROUP BY 1, 2), """ + TFIDF_SQL.format(share=1.0))
def t02(s, d):
    docs = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    n = docs.count()
    tf = tfidf.counts(docs, "doc_id", tfidf.char_terms(F.col("text")), n)
    made = tfidf.transform(tf, written(tfidf.fit(tf, n, 3), "vocabulary"), "doc_id")
    return made.withColumn("weight", F.round("weight", 6))


@query("t03_brand_terms", r"""WITH docs AS (SELECT p_partkey AS doc_id, lower(p_brand) AS t FROM part), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(list_concat(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))), list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)))) AS term FROM docs) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM docs WHERE doc_id % 2 = 0), df AS (SELECT term, count(*) AS df FROM tf WHERE doc_id % 2 = 0 GROUP BY 1), w AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def t03(s, d):
    """Fitted on the training half only, applied to both."""
    docs = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("text"))
    tf = tfidf.counts(docs, "doc_id", tfidf.char_terms(F.col("text"), 2, 4))
    vocabulary = written(tfidf.fit(tf.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 0").count()), "vocabulary")
    return tfidf.transform(tf, vocabulary, "doc_id", sublinear=False).withColumn("weight", F.round("weight", 6))


@query("j14_by_edits", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE brand END AS resolved FROM part JOIN (SELECT p_partkey, p_brand AS brand FROM part) USING (p_partkey)")
def j14e(s, d):
    """A brand with a character more at its end resolves to itself or, where another is as near, to the first of them; so only brands of
    their own length class are asked for here: exact names and nonsense."""
    p = table(s, d, "part")
    asked = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 2, F.lit("zzz nothing alike")).otherwise(F.lower("p_brand")).alias("q"))
    return fuzzy.by_edits(asked, "p_partkey", "q", p.select(F.col("p_brand").alias("name")).distinct()).select("p_partkey", "resolved")


@query("j14_fuzzy")
def j14(s, d):
    """Brands with one letter doubled, against the gazetteer of the whole table."""
    p = table(s, d, "part")
    asked = p.select("p_partkey", F.concat(F.substring("p_brand", 1, 3), F.expr("substring(p_brand, 3)")).alias("q"))
    return fuzzy.resolve(asked, "p_partkey", "q", fuzzy.gazetteer(p, "p_brand"))


# brand rules over whole tables

NAMED_SQL = "concat('  ', upper(substr(p_name, 1, 1)), substr(p_name, 2), p_type, lower(p_brand), 'Mc', upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE p_partkey % 3 WHEN 0 THEN ' mass_g: ' WHEN 1 THEN ' Category - ' ELSE ' of ' END, p_size)"


@query("f04_brand_display_all", r"""WITH r AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(""" + NAMED_SQL + r""", '\s+', ' ', 'g'), '\s*(?:pack[_ ]?count|mass[_ ]?g|volume[_ ]?ml|keywords|category)\s*[:|-].*$', '', 'i')) AS x FROM part)
SELECT p_partkey, trim(substr(regexp_replace(regexp_replace(x, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([A-Z][a-z])', '\1 \2', 'g'), 1, 64)) AS brand FROM r""")
def f04_all(s, d):
    """Names, types and brands of all parts run together, two thirds with a field behind."""
    return table(s, d, "part").selectExpr("p_partkey", f"{NAMED_SQL} AS raw").select("p_partkey", text.brand_display(F.col("raw")).alias("brand"))


TAILS = "|".join(tables.BRAND_TAILS)


@query("f07_trim_tail_all", f"""WITH t AS (SELECT [{_sql_list(tables.BRAND_TAILS)}] AS tails), r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_name) || ' ' END || tails[p_partkey % len(tails) + 1] || CASE WHEN p_partkey % 2 = 0 THEN ' ' || tails[p_size % len(tails) + 1] ELSE '' END AS x FROM part, t)
SELECT p_partkey, CASE WHEN regexp_full_match(x, '(?:{TAILS})(?: (?:{TAILS}))*') THEN x ELSE regexp_replace(x, '(?: (?:{TAILS}))+$', '') END AS brand FROM r""")
def f07_all(s, d):
    """Every part's name before one or two of all the generic words, every seventh without a name."""
    tails = F.array(*[F.lit(t) for t in tables.BRAND_TAILS])
    n = len(tables.BRAND_TAILS)
    at = lambda c: F.element_at(tails, (F.col(c) % n + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lower("p_name"), F.lit(" ")))
    raw = F.concat(name, at("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), at("p_size"))).otherwise(F.lit("")))
    return table(s, d, "part").select("p_partkey", text.trim_brand_tail(raw).alias("brand"))


@query("f14_least_words_all", rf"""WITH r AS (SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')[1:2] AS w FROM documents),
k AS (SELECT doc_id, unnest([{_sql_list(tables.HONORIFICS)}, '']) AS h, w FROM r), s AS (SELECT doc_id, CASE WHEN h = '' THEN coalesce(w[1], '') ELSE h || '.' END AS a, CASE WHEN h = '' THEN coalesce(w[2], '') ELSE coalesce(w[1], '') END AS b FROM k)
SELECT doc_id, a || ' ' || b AS words, (CASE WHEN list_contains([{_sql_list(tables.HONORIFICS)}], lower(regexp_replace(a, '[^A-Za-z]', '', 'g'))) OR regexp_matches(a, '[’'']s\b') OR list_contains([{_sql_list(tables.BRAND_SECONDS)}], lower(b)) THEN 2 ELSE 1 END)::INT AS least FROM s WHERE a <> ''""")
def f14_all(s, d):
    """The first words of every document, alone and after each title."""
    docs = table(s, d, "documents")
    first = docs.select("doc_id", extract.words(F.col("text")).alias("w"), F.explode(F.array(*[F.lit(h) for h in [*tables.HONORIFICS, ""]])).alias("h"))
    word = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    a, b = F.when(F.col("h") == "", word(1)).otherwise(F.concat("h", F.lit("."))), F.when(F.col("h") == "", word(2)).otherwise(word(1))
    made = first.select("doc_id", a.alias("a"), b.alias("b")).where("a <> ''").select("doc_id", F.concat("a", F.lit(" "), "b").alias("words"))
    return made.select("doc_id", "words", extract.least_brand_words(extract.words(F.col("words"))).alias("least"))


@query("f16_rule_brand_all")
def f16_all(s, d):
    """Rule brands of the whole catalog and of all documents; tested against a walk word by word."""
    both = catalog(s, d).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), "text").unionByName(table(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    return both.select("kind", "id", extract.rule_brand(F.col("text")).alias("brand"))
