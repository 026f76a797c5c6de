"""A training corpus from documents: toxicity, line deduplication, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the columns of
documents. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm import decontaminate, line_dedup, packing, similar, toxicity
from larkmill.llm.common import written


def _beside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """(docs with the columns that an operator would replace under other names, those names back to the callers')."""
    free = {c: f"_caller_{i}_{c}" for i, c in enumerate(docs.columns) if c in taken}
    return docs.select(*[F.col(f"`{c}`").alias(free.get(c, c)) for c in docs.columns]), {v: k for k, v in free.items()}


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects (score 0.5 or more) go. It learns from labels outside the held-out fifth. Null and empty
    texts get the score of no words, repeated rows are treated alike, and an empty table stays empty. The caller's columns stay as they
    are, also where they are named like the operator's (score, predicted)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    own, back = _beside(docs, ("score", "predicted"))
    scored = toxicity.score_documents(own, toxicity.train(docs.select("doc_id", "text"), labels))
    kept = scored.where(F.col("predicted") == 0).select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in own.columns])
    return written(kept, "kept")  # in small batches


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the last of them only; n_chars follows the text. A null text
    becomes an empty one; rows of one id count as one document; an empty table stays empty. The caller's other columns stay as they are, also
    where they are named like the operator's (n_lines, n_dropped)."""
    own, back = _beside(docs, ("n_lines", "n_dropped", "_lm_th", "_lm_drop", "_lm_id", "_lm_gone"))
    out = line_dedup.line_dedup(own, 20, 3)
    size = F.char_length("text")
    return out.select(*[size.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`").alias(back.get(c, c)) for c in own.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SimHash tiles, each link confirmed by an exact Jaccard similarity of 0.8 or more of distinct
    five-word shingles) one row stays, that with the least id (nulls last). Rows are judged, not ids; all null and wordless texts are
    copies of each other."""
    own, back = _beside(docs, ("_lm_th", "_lm_gone", "_lm_id", "_lm_of"))
    kept = similar.one_of_each(own)
    return kept.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in own.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with up to 8 edits in 100 characters, go. Null and empty texts stay, repeated rows are treated
    alike, and an empty table stays empty."""
    return written(decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "clean")  # in small batches


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: each piece with its ids and its place. Null and empty texts are the end id alone, repeated rows are
    packed as often as they come, and an empty table gives none."""
    return written(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0), "packed")


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The trained machine, the groups of near duplicates and the packing search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
