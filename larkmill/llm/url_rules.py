"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Only DataFrame functions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

#: Hexadecimal digits of a digest that rules and expressions meet on (32 bits).
SHORT = 8
#: Rules up to which the rule table is sent to every task; a larger one is shuffled like the expressions.
SENT_RULES = 100_000
RULE_SCHEMA = "verdict string, host string, path string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end. Null, or
    no "://": both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _labels(host: Column) -> Column:
    """Labels of a host; an empty host has none, and so has the rule that fits all hosts."""
    return F.when(host == "", 0).otherwise(F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def usable_rules(rules: DataFrame) -> DataFrame:
    """Distinct (verdict, host, path, labels, size, digest, short) of rules that can fit anything: no nulls, a verdict of allow or block, a
    path that is empty or begins with "/". Hosts are lower-cased (A-Z)."""
    own = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), "path").where("verdict IN ('allow', 'block') AND host IS NOT NULL AND (path = '' OR path LIKE '/%')")
    # of one rule given both ways, the block stays
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("host", "path").cast("binary"), 256)
    own = own.select("verdict", "host", "path", _labels(F.col("host")).alias("labels"), F.char_length("path").alias("size"), digest.alias("digest"))
    return own.withColumn("short", F.substring("digest", 1, SHORT))


def expressions(places: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """host, path, short, digest for each of the shapes (labels of the host's end, characters of the path's beginning) that a place has.

    Rules have few shapes, so a URL with a thousand labels or a very long path isn't written out in all its ends and beginnings."""
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("k")) for n, k in shapes])
    fits = F.filter(listed, lambda s: (s["n"] <= F.col("_labels")) & (s["k"] <= F.char_length("path")))
    # substring_index takes the last n labels of a host that has as many
    end = F.expr("substring_index(host, '.', -_shape.n)")
    made = places.withColumn("_labels", _labels(F.col("host"))).select("host", "path", F.explode(fits).alias("_shape"))
    text = F.concat(F.when(F.col("_shape.n") == 0, F.lit("")).otherwise(end), F.substr("path", F.lit(1), F.col("_shape.k")))
    made = made.select("host", "path", F.sha2(text.cast("binary"), 256).alias("digest"))
    return made.select("host", "path", F.substring("digest", 1, SHORT).alias("short"), "digest")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule's, else null and the default (unlisted URLs pass).

    A rule (verdict allow or block, host, path) fits its host and all subdomains where the URL's path starts with the rule's. The longest
    rule (host and path together) wins; of equally long ones that with the longer host, and of one rule given both ways the block. Null or
    unusable rules count as absent (`usable_rules`); no rules, or an empty table, give the default or nothing. Null URLs have an empty host
    and path. Repeated rows are judged alike; columns of pages named like the added ones are replaced.

    Distinct (host, path) pairs are judged, so copies and a host with a third of all rows are met after partial aggregation; each pair's
    expressions meet the rules on 32 bits of their digests, and equal digests confirm. The verdicts go back by an equi-join of plain
    exchanges, which adaptive execution may split at a hot page. The rule table is sent to every task up to SENT_RULES rules."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    # an empty path can only meet a rule with an empty path; both columns are never null, so that equality joins them back
    located = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    listed = written(usable_rules(rules), "url-rules")
    shapes = [(r["labels"], r["size"]) for r in listed.select("labels", "size").distinct().orderBy("labels", "size").collect()]  # few: lengths, not rules
    if not shapes:
        discard(listed)
        return located.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    made = expressions(located.select("host", "path").distinct(), shapes).alias("e")
    side = listed.select("short", "digest", F.concat("host", "path").alias("rule"), "verdict", F.char_length("host").alias("own")).alias("r")
    side = F.broadcast(side) if listed.count() <= SENT_RULES else side
    met = made.join(side, F.col("e.short") == F.col("r.short")).where(F.col("e.digest") == F.col("r.digest"))
    order = F.struct(F.char_length("rule"), F.col("own"), F.col("rule"))
    best = met.groupBy("e.host", "e.path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    # written, so that the join below has two plain exchanges
    best = written(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict")), "url-verdicts")
    out = located.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, "host/path") pairs."""
    return spark.createDataFrame([(v, *_cut(r)) for v, r in rules], RULE_SCHEMA)


def _cut(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path
