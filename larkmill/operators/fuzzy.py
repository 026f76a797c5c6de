"""Fuzzy brand resolution against a gazetteer, through an inverted index of character pairs.

White space is squeezed first, as in gazetteer keys. Exact names (case aside) are tried first; every other distinct candidate meets the names that
share enough of its rarest pairs, or of theirs. The counts asked for are such that no pair within the thresholds is missed (see `Bound`), so
the answer is that of comparing all with all. Similarities follow the public definitions of the indel ratio, the token-set ratio and the
weighted ratio."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rare pairs that two texts must share, where they have as many to spare.
SHARED = 3
#: Length up to which single letters are looked up too: a text of one letter is part of longer ones.
SHORT = 8


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    return 200.0 * common(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words, and the common with each side's own."""
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if not x or not y:
        return 0.0
    if both and (not left or not right):
        return 100.0
    p, q = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(p, q)
    return max(best, indel_ratio(both, p), indel_ratio(both, q)) if both else best


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer that is as long, or cut off by its ends."""
    s, t = sorted((a, b), key=len)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    n = len(s)
    windows = [(s, t)] if len(t) > n else [(s, t), (t, s)]
    return max(indel_ratio(u, v[max(0, i) : i + n]) for u, v in windows for i in range(1 - n, len(v)))


def partial_token_ratio(a: str, b: str) -> float:
    """100 where a word is common, else the partial ratio of the sorted words, with and without repeats."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def weighted_ratio(a: str, b: str) -> float:
    """The ratio of the whole texts, or of their words at 0.95; where one is half as long again, the partial forms instead, at 0.9 (0.6
    beyond eight times the length)."""
    whole = indel_ratio(a, b)
    if not a or not b:
        return whole
    unequal = max(len(a), len(b)) / min(len(a), len(b))
    if unequal < 1.5:
        return max(whole, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if unequal <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@F.pandas_udf(T.StructType([T.StructField("whole", T.DoubleType()), T.StructField("words", T.DoubleType())]))
def similarities(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = list(zip(a, b, strict=True))
    return pd.DataFrame({"whole": [enough(x, y) for x, y in pairs], "words": [token_set_ratio(x, y) for x, y in pairs]})


def enough(a: str, b: str, least: float = 90) -> float:
    """The weighted ratio where it reaches `least` (85.6 at the lowest), else something below. Where one text is half as long again, only the partial ratio of
    a text that is part of the other gets there."""
    if a and b and max(len(a), len(b)) / min(len(a), len(b)) >= 1.5 and least > 85.5:
        return 90.0 if (a in b or b in a) and max(len(a), len(b)) <= 8 * min(len(a), len(b)) else 0.0
    return weighted_ratio(a, b)


class Bound:
    """What two texts within the thresholds must share.

    A text's features are the pairs of neighbouring letters, blanks at its ends and between words included, numbered where they repeat: as many
    as it has letters, and one. A letter taken out changes two pairs at most, one put in one pair of the old text. A ratio of 90 allows 1.1 x
    out + 0.9 x in <= 0.2 x length, so at most 4/11 of the length in changed pairs; a text that is part of another loses two at its ends; words
    that a token-set ratio leaves out are shorter than that. So of its rarest `lost + n` features it shares n at least. Words in another order
    have the same pairs. For token sets the words count once, which is a second set of features where words repeat."""

    @staticmethod
    def features(text: str) -> tuple[list[str], list[str], int, int, bool]:
        """(features of the distinct words, of all words, how many of each may be lost, whether words repeat)."""
        words = text.split()
        once = sorted(set(words))
        letters = [f"1{c}" for c in sorted(set(text))] if len(text) <= SHORT else []
        sets, alls = ([*_pairs(own), *letters] for own in (once, words))
        return sets, alls, Bound.lost(len(" ".join(once))), Bound.lost(len(text)), len(once) < len(words)

    @staticmethod
    def lost(length: int) -> int:
        return max(2, 4 * length // 11)


def _pairs(words: list[str]) -> list[str]:
    seen: Counter = Counter()
    out = []
    for word in words:
        padded = f" {word} "
        for i in range(len(padded) - 1):
            pair = padded[i : i + 2]
            out.append(f"2{pair}{seen[pair] or ''}")
            seen[pair] += 1
    return out


FEATURES = T.StructType([T.StructField("sets", T.ArrayType(T.StringType())), T.StructField("alls", T.ArrayType(T.StringType())), T.StructField("lost_sets", T.IntegerType()), T.StructField("lost_alls", T.IntegerType()), T.StructField("repeats", T.BooleanType())])


@F.pandas_udf(FEATURES)
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Bound.features(x) for x in texts], columns=FEATURES.names)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def gazetteer(brands: DataFrame, column: str, least: int = 2, short: int = 12) -> DataFrame:
    """name: brands that occur often enough or are short."""
    n = brands.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") >= least) | (F.length("name") <= short)).select("name")


def _listed(texts: DataFrame, column: str) -> DataFrame:
    """text, form, feature, lost, size, repeats: a row for each feature of each form. Letters of short texts don't count as theirs unless they are all they have."""
    made = texts.select(F.col(column).alias("text"), _features(F.col(column)).alias("f"))
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("f.sets").alias("own"), F.col("f.lost_sets").alias("lost")), F.struct(F.lit(1).alias("form"), F.col("f.alls").alias("own"), F.col("f.lost_alls").alias("lost")))
    made = made.select("text", F.col("f.repeats").alias("repeats"), F.explode(forms).alias("x"))
    return made.select("text", "repeats", F.col("x.form").alias("form"), F.col("x.lost").alias("lost"), F.explode("x.own").alias("feature"))


def _rarest(listed: DataFrame, counts: DataFrame) -> DataFrame:
    """The features that a text must share `need` of: its lost + need rarest ones. A single letter counts only for a text that has no more."""
    known = listed.join(counts, ["form", "feature"], "left")
    # a text's features are sorted in its own row: as many as it has letters
    own = known.groupBy("text", "form", "repeats", "lost").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "feature"))).alias("e"))
    own = own.withColumn("e", F.filter("e", lambda x: (F.char_length("text") == 1) | x["feature"].startswith("2")))
    own = own.withColumn("need", F.greatest(F.lit(1), F.least(F.lit(SHARED), F.size("e") - F.col("lost"))))
    return own.select("text", "form", "repeats", "need", F.explode(F.slice("e", 1, F.col("lost") + F.col("need"))["feature"]).alias("feature"))


def candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """q, low: pairs of distinct texts (asked has q, names has low) that may reach a weighted ratio of 90 or a token-set ratio of 92, none left out."""
    a, b = _listed(asked, "q"), _listed(names, "low")
    counts = b.groupBy("form", "feature").agg(F.count(F.lit(1)).alias("df"))

    def met(some: DataFrame, whole: DataFrame, first: str, second: str) -> DataFrame:
        left = _rarest(some, counts).select("form", "feature", "need", F.col("text").alias(first), F.col("repeats").alias("r1"))
        right = whole.select("form", "feature", F.col("text").alias(second), F.col("repeats").alias("r2"))
        # without repeated words on either side, both forms are one
        both = left.join(right, ["form", "feature"]).where("form = 0 OR r1 OR r2")
        return both.groupBy("form", first, second).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("q", "low")

    return met(a, b, "q", "low").unionByName(met(b, a, "low", "q")).distinct()


def resolve(df: DataFrame, key: str, candidate: str, names: DataFrame, whole: float = 90, words: float = 92) -> DataFrame:
    """key, candidate, resolved: the exact name (case and white space aside), else the best from `whole` on by the weighted ratio, else from
    `words` on by the token-set ratio, else null. Ties go to the name that sorts first. Distinct candidates are compared once. whole of 90
    and words of 92 at least: below, the index would miss pairs. Null and blank candidates or names resolve nothing."""
    if whole < 90 or words < 92:
        raise ValueError("the index is lossless from 90 and 92 on")
    low = names.select("name", squeezed(F.col("name")).alias("low")).where("low <> ''")
    own = df.select(squeezed(F.col(candidate)).alias("_q")).where("_q <> ''").distinct()
    exact = own.join(low, F.col("_q") == F.col("low")).groupBy("_q").agg(F.min("name").alias("exact"))
    asked = own.join(exact, "_q", "left_anti").select(F.col("_q").alias("q"))
    firsts = low.groupBy("low").agg(F.min("name").alias("name"))
    near = candidates(asked, firsts.select("low")).withColumn("s", similarities("q", "low")).where((F.col("s.whole") >= whole) | (F.col("s.words") >= words))
    near = near.join(firsts, "low")
    best = near.groupBy("q").agg(
        F.min_by("name", F.struct((-F.col("s.whole")).alias("d"), F.col("name"))).alias("by_whole"), F.max("s.whole").alias("top_whole"),
        F.min_by("name", F.struct((-F.col("s.words")).alias("d"), F.col("name"))).alias("by_words"))
    fuzzy = best.select(F.col("q").alias("_q"), F.when(F.col("top_whole") >= whole, F.col("by_whole")).otherwise(F.col("by_words")).alias("fuzzy"))
    found = exact.join(fuzzy, "_q", "full").select("_q", F.coalesce("exact", "fuzzy").alias("resolved"))
    return df.select(key, candidate).join(found, squeezed(F.col(candidate)) == F.col("_q"), "left").select(key, candidate, "resolved")


def by_edits(df: DataFrame, key: str, candidate: str, names: DataFrame, most: int = 2) -> DataFrame:
    """The same with at most `most` edits, in built-in functions only: least edits, then the name that sorts first.

    A name is cut into most + 1 pieces, of which one at least stands whole in a candidate within reach, at most `most` places away; names and
    candidates meet by an equi-join on such pieces. Names shorter than that have empty pieces, which meet all candidates of about their length."""
    pieces = most + 1
    ends = lambda size, i: (F.floor(i * size / pieces), F.floor((i + 1) * size / pieces))

    def piece(text: Column, start: Column, stop: Column) -> Column:
        return F.substr(text, (start + 1).cast("int"), (stop - start).cast("int"))

    own = names.where(F.col("name").isNotNull()).select("name", F.lower("name").alias("low")).distinct()
    a, b = ends(F.char_length("low"), F.col("i"))
    cut = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most)))).select("name", "low", F.char_length("low").alias("size"), "i", piece(F.col("low"), a, b).alias("piece"))
    asked = df.where(F.col(candidate).isNotNull()).select(F.lower(candidate).alias("_q")).distinct()
    n = F.char_length("_q")
    tried = asked.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), n - most), n + most))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    tried = tried.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    a, b = ends(F.col("size"), F.col("i"))
    tried = tried.where((a + F.col("shift") >= 0) & (b + F.col("shift") <= n)).select("_q", "size", "i", piece(F.col("_q"), a + F.col("shift"), b + F.col("shift")).alias("piece")).distinct()
    pairs = tried.join(cut, ["size", "i", "piece"]).select("_q", "name", "low").distinct()
    near = pairs.withColumn("d", F.levenshtein("_q", "low", most)).where(F.col("d") >= 0)
    best = near.groupBy("_q").agg(F.min_by("name", F.struct("d", "name")).alias("resolved"))
    return df.select(key, candidate).join(best, F.lower(candidate) == F.col("_q"), "left").select(key, candidate, "resolved")
