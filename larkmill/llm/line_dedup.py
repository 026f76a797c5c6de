"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only DataFrame functions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, text_of, written

BLANKS = " \t\n\x0b\x0c\r"


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines dropped that many documents share; adds n_lines (before) and n_dropped.

    A line's key is the line without ASCII blanks at both ends and with A-Z lower-cased. A key of at least min_chars code points that
    at least min_docs distinct ids hold loses all its lines except in the largest id that holds it.

    Null or empty text is one empty line and stays as an empty text; an empty table gives an empty table; rows repeated under one id
    count as one document and are treated alike; a null id counts as one document below all others. Columns named like the added ones
    are replaced. The key is a pair of 64-bit hashes; a hash held by a third of all rows is counted after partial aggregation, and
    the join that marks its lines is an equi-join which adaptive execution may split. Positions are gathered by id and text, so that rows
    without an id don't meet. Each text is split into lines once to mark them and once to put the others together.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_lm_th", "_lm_drop", "_lm_id", "_lm_gone")]
    lines = F.split(text_of(text_col), "\n", -1)
    th = F.xxhash64(text_of(text_col))
    whole = docs.select(F.col(id_col).alias("id"), th.alias("th"), lines.alias("lines"))  # below the explode, so that a text is hashed once
    one = whole.select("id", "th", F.posexplode("lines").alias("pos", "line"))
    one = one.select("id", "th", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= min_chars)
    one = one.select("id", "th", "pos", ascii_lower(F.col("key")).alias("key"))
    one = written(one.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2")), "lines")
    common = one.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    # written, so that both sides of the join below are plain exchanges, which adaptive execution can split at a hot line
    common = written(common.where(F.col("n") >= min_docs).select("h1", "h2", "last"), "common-lines")
    gone = one.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("id").alias("_lm_id"), F.col("th").alias("_lm_gone")).agg(F.collect_set("pos").alias("_lm_drop"))
    gone = written(gone, "gone-lines")
    discard(one, common)
    base = docs.select(*[F.col(f"`{c}`") for c in keep], th.alias("_lm_th"))
    out = base.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_lm_id")) & (F.col("_lm_th") == F.col("_lm_gone")), "left")
    # a lambda's variable holds the lines, so that they are split once and not for each line that stays
    rest = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_lm_drop"))
    kept = F.transform(F.array(lines), lambda own: F.array_join(F.transform(rest(own), lambda i: F.element_at(own, i + 1)), "\n"))
    text = F.when(F.col("_lm_drop").isNull(), text_of(text_col)).otherwise(F.element_at(kept, 1))
    dropped = F.when(F.col("_lm_drop").isNull(), 0).otherwise(F.size("_lm_drop"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in keep], F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))
