"""Product facts from catalog text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from .text import brand_canonical, brand_display, squeeze


def _lits(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once: where it occurs several times, plans would else hold as many copies of its tree."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def title(text: Column) -> Column:
    """What follows Item Name: (or everything), up to the first strong delimiter."""
    named = lambda x: F.when(x.rlike(r"(?i)Item Name:"), F.regexp_extract(x, r"(?i)Item Name:\s*(.*)", 1)).otherwise(x)
    head = lambda x: F.trim(F.element_at(F.split(named(x), r"(?i)\s*(?:[-–—|,;/\n]|\(|\[|Pack of|Count|CT\b)\s*", 2), 1))
    return let(F.coalesce(text, F.lit("")), head)


def words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def _first_index(tokens: Column, test) -> Column:
    """1-based place of the first token that passes, or one more than there are."""
    flags = F.transform(tokens, lambda t: test(t))
    at = F.array_position(flags, True)
    return F.when(at == 0, F.size(tokens) + 1).otherwise(at).cast("int")


def before_noun(tokens: Column) -> Column:
    nouns = _lits(T.PRODUCT_NOUNS)
    at = _first_index(tokens, lambda t: F.array_contains(nouns, F.lower(F.regexp_replace(t, "[^A-Za-z]", ""))))
    return F.slice(tokens, 1, at - 1)


def proper_run(tokens: Column) -> Column:
    """The leading run of capitalised words, with and, n between them."""
    core = lambda t: F.regexp_replace(t, r"^\W+|\W+$", "")
    at = _first_index(tokens, lambda t: ~core(t).rlike(r"^[A-Z][\w\-.']*$|^[A-Z0-9]{2,}$|^(?:&|and|n)$"))
    return F.slice(tokens, 1, at - 1)


def prefixes(tokens: Column, most: int = 4) -> Column:
    """Leading word runs of 1 to `most` words, from 2 on after an article."""
    upto = F.least(F.size(tokens), F.lit(most))
    start = F.when((upto >= 2) & F.array_contains(_lits(T.ARTICLES), F.lower(F.element_at(tokens, 1))), 2).otherwise(1)
    runs = F.transform(F.sequence(start, upto), lambda k: F.array_join(F.slice(tokens, 1, k), " "))
    return F.when(upto >= start, runs).otherwise(F.array().cast("array<string>"))


def least_brand_words(tokens: Column) -> Column:
    first = F.element_at(tokens, 1)
    title_word = F.array_contains(_lits(T.HONORIFICS), F.lower(F.regexp_replace(first, "[^A-Za-z]", "")))
    second = (F.size(tokens) >= 2) & F.array_contains(_lits(T.BRAND_SECONDS), F.lower(F.try_element_at(tokens, F.lit(2))))
    return F.when(title_word | first.rlike(r"[’']s\b") | F.coalesce(second, F.lit(False)), 2).otherwise(1)


def rule_brand(text: Column) -> Column:
    """Words of the item name up to the first that can't be a brand's."""
    whole = F.coalesce(text, F.lit(""))
    named = F.regexp_extract(whole, r"(?i)Item\s*Name:\s*([^\n]+)", 1)
    lines = F.filter(F.transform(F.split(whole, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    line = F.when(F.trim(named) != "", F.trim(named)).otherwise(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")))
    name = F.trim(F.element_at(F.split(line, r"\s*,\s*|\s*[(/\[]\s*|\s+-\s+", 2), 1))
    return let(words(name), lambda raw: let(_brand_words(raw), _shown_brand))


def _shown_brand(kept: Column) -> Column:
    def short(shown: Column) -> Column:
        parts = words(shown)
        return F.when(F.size(parts) > 4, F.array_join(F.slice(parts, 1, 3), " ")).otherwise(shown)

    joined = F.regexp_replace(F.array_join(kept, " "), r"[ \-–—,:;|/\\]+$", "")
    whole = let(let(brand_display(joined), short), lambda shown: F.when(F.length(shown) >= 2, shown))
    return F.when(F.size(kept) > 0, whole)


def _brand_words(raw: Column) -> Column:
    """The fold: words kept until one ends the brand."""
    seq = F.zip_with(raw, F.transform(raw, lambda w, i: F.coalesce(F.try_element_at(raw, i + 2), F.lit(""))), lambda a, b: F.struct(a.alias("w"), b.alias("next")))
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(state: Column, x: Column) -> Column:
        w = F.regexp_replace(x["w"], r"[^\w&'+-]", "")
        low = F.lower(w)
        n = F.size(state["kept"])
        kept = state["kept"]
        more = F.struct(F.concat(kept, F.array(w)).alias("kept"), F.lit(False).alias("done"))
        last = F.struct(F.concat(kept, F.array(w)).alias("kept"), F.lit(True).alias("done"))
        stop = F.struct(kept.alias("kept"), F.lit(True).alias("done"))
        audience = F.array_contains(_lits(T.AUDIENCES), low)
        ends = F.array_contains(_lits(T.RULE_STOPS), low) & ~w.contains("-")
        short = (n == 1) & (F.length(low) <= 8) & (F.length(F.try_element_at(kept, F.lit(1))) <= 8)
        sea_salt = (low == "sea") & (F.regexp_replace(F.lower(x["next"]), r"^[:;,./-]+|[:;,./-]+$", "") == "salt")
        return (F.when(state["done"], state)
            .when(low.rlike(r"\d") | F.array_contains(_lits(T.RULE_UNITS), low), stop)
            .when(audience & (n == 0), state)
            .when(audience, stop)
            .when(ends & F.coalesce(short, F.lit(False)), last)
            .when(ends, stop)
            .when(F.array_contains(_lits(T.RULE_INGREDIENTS), low) & (n >= 1), stop)
            .when(sea_salt, stop)
            .otherwise(more))

    return F.aggregate(seq, zero, step, lambda s: s["kept"])


def valid_brand(c: Column) -> Column:
    low = F.lower(F.trim(c))
    bad = low.rlike("|".join(f"(?:{p})" for p in T.BAD_BRANDS)) | low.isin(T.BAD_WORDS)
    bad = bad | low.rlike(r"\b\d+\s*(?:oz|ounce|ml|g|gram|kg|lb|pound)\b") | low.rlike(r"\b(?:pack|case)\s*(?:of|count)\b")
    fields = reduce(lambda a, b: a + b, [F.contains(low, F.lit(f)).cast("int") for f in T.FIELD_NAMES])
    return F.coalesce((low != "") & ~bad & (F.size(words(c)) <= 5) & (fields < 2), F.lit(False))


def suspicious_brand(c: Column) -> Column:
    low = F.lower(c)
    odd = low.rlike(r"\b\d+\s*(?:oz|ounce|ml|g|gram|kg|lb|%)\b") | low.rlike(r"\b(?:pack|case)\s*(?:of|count)")
    return F.coalesce((low == "") | (low == "unknown") | odd | (F.size(words(c)) > 5), F.lit(True))


PACK_PATTERNS = [
    r"(?i)pack\s*of\s*([A-Za-z0-9]+)",
    r"(?i)\b([A-Za-z0-9]+)\s*pack\b",
    r"(?i)\b([A-Za-z0-9]+)\s*[- ]?count\b",
    r"(?i)\b([0-9]+)\s*x\s*[0-9]+(?:\.[0-9]+)?\s*(?:oz|ounce|fl\s*oz|ml|g|gram|lb|pound)s?\b",
    r"(?i)case\s*of\s*([A-Za-z0-9]+)",
]


def _number(word: Column) -> Column:
    low = F.lower(F.trim(word))
    spelled = F.create_map(*[F.lit(x) for kv in T.NUMBER_WORDS.items() for x in (kv[0], float(kv[1]))])
    return F.when(low.rlike(r"^\d+$"), low.cast("double")).otherwise(F.try_element_at(spelled, low))


def pack_count(text: Column) -> Column:
    """The first pattern whose first match is a number or number word."""
    return F.coalesce(*[_number(_found(text, p)) for p in PACK_PATTERNS])


def value_unit(text: Column) -> Column:
    """struct(value, unit), both or neither."""
    value = _found(text, r"(?i)\bValue:\s*([0-9]+(?:\.[0-9]+)?)").cast("double")
    unit = _found(text, r"(?i)\bUnit:\s*([A-Za-z ]+)")
    both = value.isNotNull() & unit.isNotNull()
    return F.struct(F.when(both, value).alias("value"), F.when(both, F.lower(F.trim(unit))).alias("unit"))


def to_mass_volume(value: Column, unit: Column) -> Column:
    """struct(mass_g, volume_ml); 0 for unknown units."""
    u = F.trim(F.replace(F.replace(F.lower(unit), F.lit("."), F.lit("")), F.lit("fluid"), F.lit("fl")))
    mass = volume = F.lit(0.0)
    for pattern, grams, ml in reversed(T.PAIR_UNITS):
        hit = u.rlike(f"^(?:{pattern})$")
        mass = F.when(hit, value * grams).otherwise(mass)
        volume = F.when(hit, value * ml).otherwise(volume)
    return F.struct(F.coalesce(mass, F.lit(0.0)).alias("mass_g"), F.coalesce(volume, F.lit(0.0)).alias("volume_ml"))


def totals(text: Column) -> Column:
    """struct(mass_g, volume_ml, count): all stated quantities, times the pack where it is more than one."""
    pattern = r"(\d+(?:\.\d+)?)\s*(fl oz|oz|ounce|lb|pound|g|gram|kg|ml|l|liter|ct|count|pcs|pack)\b"

    def facts(low: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), 1).alias("v"), F.regexp_extract_all(low, F.lit(pattern), 2).alias("u"))
        times = F.coalesce(_found(low, r"(?:pack of|case of|x|×)\s*(\d+)").cast("double"), F.lit(1.0))
        return F.struct(pairs.alias("pairs"), low.contains("fl oz").alias("fluid"), F.greatest(times, F.lit(1.0)).alias("many"))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), facts), _summed)


def _summed(x: Column) -> Column:
    table = lambda units: F.create_map(*[F.lit(v) for kv in units.items() for v in kv])
    add = lambda rate: F.aggregate(x["pairs"], F.lit(0.0), lambda s, p: s + p["v"].cast("double") * F.coalesce(rate(p["u"]), F.lit(0.0)))
    mass = add(lambda u: F.when(~((u == "oz") & x["fluid"]), F.try_element_at(table(T.TOTAL_MASS), u)))
    volume = add(lambda u: F.try_element_at(table(T.TOTAL_VOLUME), u))
    count = add(lambda u: F.when(u.isin(T.TOTAL_COUNT), 1.0))
    counted = let(count, lambda n: F.when(n != 0, n).otherwise(x["many"]))
    return F.struct((mass * x["many"]).alias("mass_g"), (volume * x["many"]).alias("volume_ml"), counted.alias("count"))


def keywords(text: Column) -> Column:
    """Keywords of the record profile, in list order, by substring."""
    found = lambda low: F.array_compact(F.array(*[F.when(_any(low, T.SYNONYMS.get(k, [k])), F.lit(k)) for k in T.KEYWORDS]))
    return let(F.lower(F.coalesce(text, F.lit(""))), found)


def flag_name(keyword: str) -> str:
    return "flag_" + keyword.replace(" ", "_")


def text_flags(text: Column) -> list[Column]:
    """One 0/1 column for each keyword of the text-flag profile."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return [F.contains(low, F.lit(k)).cast("int").alias(flag_name(k)) for k in T.FLAG_KEYWORDS]


def keyword_flags(found: Column) -> list[Column]:
    """One 0/1 column for each keyword of the record profile, from the keyword list."""
    return [F.array_contains(found, F.lit(k)).cast("int").alias(flag_name(k)) for k in T.KEYWORDS]


def category(text: Column) -> Column:
    """The first rule with a term in the text; order is the contract."""

    def rules(low: Column) -> Column:
        out = F.lit(T.FALLBACK)
        for name, terms in reversed(T.CATEGORY_RULES):
            out = F.when(_any(low, terms), F.lit(name)).otherwise(out)
        return out

    return let(F.lower(F.coalesce(text, F.lit(""))), rules)


def canonical_keywords(raw: Column) -> Column:
    """A comma list from a file as known keywords, first mention first."""
    low = F.lower(F.trim(raw))
    parts = F.filter(F.transform(F.split(low, ","), lambda k: F.trim(k)), lambda k: F.array_contains(_lits(T.KEYWORDS), k))
    return F.when(low.isNull() | low.isin("", "none", "n/a", "null", "0", "0.0"), F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def canonical_category(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for c in T.CATEGORIES for x in (c.lower(), c)])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(raw))), F.lit(T.FALLBACK))


def in_range(c: Column, low: float, high: float, default: float) -> Column:
    """c where it lies in [low, high], else (null too) the default."""
    return F.when(c.between(low, high), c).otherwise(F.lit(default))


def response_record(answer: Column) -> Column:
    """struct of the six fields of a `key: value` answer, guarded and with defaults."""
    label = r"(?:brand|pack_count|mass[_ ]?g|volume[_ ]?ml|keywords|category)"
    number = r"([0-9]+(?:\.[0-9]+)?)\b"
    text = F.coalesce(answer, F.lit(""))
    brand = brand_display(_found(text, r"(?im)^\s*brand\s*[:|-]\s*([^:\n]+?)(?:\s*[:]\s*[0-9])?(?=\n|$)"))
    pack = _found(text, rf"(?im)^\s*pack_count\s*[:|-]\s*{number}").cast("double")
    mass = _found(text, rf"(?im)^\s*(?:mass|weight|net[\s_-]*weight)[\s_]*g\s*[:|-]\s*{number}").cast("double")
    volume = _found(text, rf"(?im)^\s*(?:volume|vol)[\s_]*ml\s*[:|-]\s*{number}").cast("double")
    words_ = _found(text, rf"(?im)^\s*keywords\s*[:|-]\s*(.+?)(?=\n\s*{label}\s*[:|-]|$)")
    kind = _found(text, rf"(?im)^\s*category\s*[:|-]\s*(.+?)(?=\n\s*{label}\s*[:|-]|$)")
    return F.struct(
        let(brand, lambda b: F.when(valid_brand(b), b).otherwise(F.lit("Unknown"))).alias("brand"),
        in_range(pack, 0.1, 10000, 1.0).alias("pack_count"), in_range(mass, 0, 100000, 0.0).alias("mass_g"), in_range(volume, 0, 50000, 0.0).alias("volume_ml"),
        canonical_keywords(words_).alias("keywords"), canonical_category(kind).alias("category"))


def with_fallbacks(record: Column, text: Column) -> Column:
    """The record with what the catalog text knows better. Without text it stays. Keywords come sorted."""
    pair = let(value_unit(text), lambda p: to_mass_volume(p["value"], p["unit"]))
    facts = F.struct(record.alias("old"), rule_brand(text).alias("found"), pack_count(text).alias("pack"), pair.alias("amount"), keywords(text).alias("keywords"), category(text).alias("kind"))
    return let(facts, lambda x: F.when(F.coalesce(text, F.lit("")) == "", x["old"]).otherwise(_merged(x)))


def _merged(x: Column) -> Column:
    old, found, pack, amount, kind = x["old"], x["found"], x["pack"], x["amount"], x["kind"]
    brand = old["brand"]
    unknown = brand == "Unknown"
    look = unknown | ((F.size(words(brand)) <= 2) & ~F.lower(brand).rlike("^(?:mc|dr|st)"))
    longer = F.size(words(found)) > F.size(words(brand))
    better = found.isNotNull() & (found != "Unknown") & look & (unknown | (longer & F.startswith(F.lower(found), F.lower(brand))))
    empty = (old["mass_g"] == 0) & (old["volume_ml"] == 0)
    return F.struct(
        F.when(better, found).otherwise(brand).alias("brand"),
        F.when((old["pack_count"] == 1) & (pack > 1), pack).otherwise(old["pack_count"]).alias("pack_count"),
        F.when(empty & (amount["mass_g"] > 0), amount["mass_g"]).otherwise(old["mass_g"]).alias("mass_g"),
        F.when(empty & (amount["volume_ml"] > 0), amount["volume_ml"]).otherwise(old["volume_ml"]).alias("volume_ml"),
        F.sort_array(F.array_union(old["keywords"], x["keywords"])).alias("keywords"),
        F.when(kind != T.FALLBACK, kind).otherwise(old["category"]).alias("category"))


def sentence(brand: Column, kind: Column, pack: Column, mass: Column, volume: Column, found: Column) -> Column:
    parts = F.concat_ws(" ",
        F.when(brand.isNotNull(), F.format_string("Brand: %s.", brand)), F.when(kind.isNotNull(), F.format_string("Category: %s.", kind)),
        F.when(pack > 1, F.format_string("Pack of %d.", pack.cast("long"))), F.when(mass > 0, F.format_string("Weight: %.2fg.", mass)),
        F.when(volume > 0, F.format_string("Volume: %.2fml.", volume)), F.when(F.size(found) > 0, F.concat(F.lit("Features: "), F.array_join(found, ", "), F.lit("."))))
    return F.when(parts == "", F.lit("No description available.")).otherwise(parts)


def url_filename(url: Column) -> Column:
    return F.element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), -1)


def id_filename(key: Column, url: Column) -> Column:
    ext = _found(F.try_parse_url(url, F.lit("PATH")), r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(key.cast("string"), F.coalesce(ext, F.lit(".jpg")))


def brand_candidates(text: Column) -> Column:
    """Canonical prefixes of the title's proper run before its product noun."""
    made = lambda run: F.transform(prefixes(run), lambda p: brand_canonical(p, ascii_only=True))
    return let(words(title(text)), lambda t: let(before_noun(t), lambda b: let(proper_run(b), made)))
