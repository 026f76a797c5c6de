"""TF-IDF in relational form: term rows, never a driver-side matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkmill.sources import scratch

from .relate import dealt

#: Texts counted by one task, where texts are short.
ROWS = 16_384
#: Terms of a vocabulary that every task holds; a greater one is joined. Rows of one batch of weights.
HELD, BATCH = 1 << 20, 1 << 16


def _runs(items: int, size: Column, take) -> Column:
    """take(place) for every place from which `items` neighbours are there."""
    places = F.sequence(F.lit(1), size - items + 1)
    return F.when(size >= items, F.transform(places, lambda i: take(i))).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Words of two letters or digits at least, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_terms(text: Column, most: int = 2) -> Column:
    """Words of two letters or digits at least, lower case, and their runs up to `most` words."""
    tokens = words(text)

    def joined(n: int) -> Column:
        return _runs(n, F.size(tokens), lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(tokens, *[joined(n) for n in range(2, most + 1)])


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """All character runs of least to most, lower case, white space as single blanks."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")

    def cut(n: int) -> Column:
        return _runs(n, F.length(low), lambda i: F.substring(low, i, F.lit(n)))

    return F.concat(*[cut(n) for n in range(least, most + 1)])


def counts(df: DataFrame, key: str, terms: Column, n: int | None = None, rows: int = ROWS, also: tuple[str, ...] = ()) -> DataFrame:
    """key, term, tf. Texts are dealt by key, `rows` a task, before they are made into terms, so what a task holds doesn't grow with the table, and
    a key's terms lie together from there on. n: the number of texts, where it is known; also: columns that belong to the key and are kept."""
    return dealt(df, key, rows, n).select(key, *also, F.explode(terms).alias("term")).groupBy(key, *also, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit(tf: DataFrame, n_docs: int, min_df: int = 1, max_share: float = 1.0, size: int | None = None, times: str | None = None) -> DataFrame:
    """term, df, idf of the training rows: ln((1 + n) / (1 + df)) + 1; the commonest `size` terms, ties by term. times: a column that says how many
    equal texts a key stands for."""
    n = F.lit(1).cast("long") if times is None else F.col(times)
    return _chosen(tf.groupBy("term").agg(F.sum(n).alias("df"), F.sum(F.col("tf") * n).alias("_total")), n_docs, min_df, max_share, size)


def _chosen(found: DataFrame, n_docs: int, min_df: int, max_share: float, size: int | None) -> DataFrame:
    found = found.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_share * n_docs)))
    if size is not None:
        found = found.orderBy(F.desc("_total"), "term").limit(size)
    return found.select("term", "df", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(tf: DataFrame, vocabulary: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """key, term, weight of unit length by key; terms outside the vocabulary go. A vocabulary that is small (as a written one is known to be) goes to
    all tasks, and a key's terms stay where they were counted."""
    weight = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    rows = tf.join(vocabulary, "term").select(key, "term", (weight * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return rows.select(key, "term", (F.col("w") / norm).alias("weight"))


# words and pairs of long texts


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, cut where a key ends."""
    rest = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        rest = own if rest is None else pa.concat_tables([rest, own])
        if not rest.num_rows:
            continue
        key = rest.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _counted(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, terms, and for each term of each key: key's place, term's place, tf) of rows (key, words): words and pairs of neighbours. Words are
    numbered once, so that only different terms are made into strings."""
    coded = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
    lists = rows.column(1).combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    told = lists.flatten().dictionary_encode()
    code, n = told.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(told.dictionary)
    near = row[1:] == row[:-1]
    ids, at = np.unique(np.concatenate([code, n + code[:-1][near] * n + code[1:][near]]), return_inverse=True)
    key = coded.indices.to_numpy().astype(np.int64)[np.concatenate([row, row[1:][near]])]
    both, tf = np.unique(key * max(len(ids), 1) + at, return_counts=True)
    one, two = ids[ids < n], ids[ids >= n] - n
    terms = pa.concat_arrays([told.dictionary.take(pa.array(one)), pc.binary_join_element_wise(told.dictionary.take(pa.array(two // max(n, 1))), told.dictionary.take(pa.array(two % max(n, 1))), " ")])
    return coded.dictionary, terms, both // max(len(ids), 1), both % max(len(ids), 1), tf


def _cut(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, BATCH):
        yield whole.slice(at, BATCH)


def _mapped(rows: DataFrame, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _by_key(batches):
            yield from fn(own)

    return rows.mapInArrow(run, schema)


def word_weights(df: DataFrame, key: str, text: str, n_docs: int, min_df: int, max_share: float, size: int | None = None, rows: int = ROWS, held: int = HELD) -> DataFrame:
    """key, term, weight as transform() gives them for the words and pairs of words of long texts. Texts are dealt by key, `rows` a task, and counted
    there, once for the vocabulary and once for the weights; only sums by term move. A vocabulary of at most `held` terms is read by each task
    from the shared folder (one that pyarrow can open), a greater one is joined."""
    kind = df.schema[key].dataType.simpleString()
    dealt_out = df.repartition(max(1, -(-n_docs // rows)), key).sortWithinPartitions(key).select(key, words(F.col(text)).alias("words"))

    def sums(own: pa.Table) -> Iterator[pa.RecordBatch]:
        _, terms, _, at, tf = _counted(own)
        found = [pa.array(np.bincount(at, w, len(terms)).astype(np.int64)) for w in (None, tf)]
        yield from _cut([terms, *found], ["term", "df", "total"])

    found = _mapped(dealt_out, sums, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("_total"))
    path = scratch.path(df.sparkSession, "vocabulary")
    _chosen(found, n_docs, min_df, max_share, size).write.parquet(path)
    vocabulary = df.sparkSession.read.schema("term string, df long, idf double").parquet(path)
    if vocabulary.count() > held:

        def each(own: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, terms, k, at, tf = _counted(own)
            yield from _cut([keys.take(pa.array(k)), terms.take(pa.array(at)), pa.array(tf.astype(np.int64))], [key, "term", "tf"])

        return transform(_mapped(dealt_out, each, f"{key} {kind}, term string, tf long"), vocabulary, key)
    known: list[pa.Table] = []

    def weighed(own: pa.Table) -> Iterator[pa.RecordBatch]:
        if not known:
            store, base = pafs.FileSystem.from_uri(path)
            known.append(pads.dataset(base, filesystem=store, format="parquet", schema=pa.schema([("term", pa.string()), ("idf", pa.float64())]), exclude_invalid_files=True).to_table().combine_chunks())
        if not known[0].num_rows:
            return
        names, idf = known[0].column(0).chunk(0), known[0].column(1).to_numpy()
        keys, terms, k, at, tf = _counted(own)
        place = pc.index_in(terms, value_set=names).fill_null(-1).to_numpy()[at]
        k, place, tf = (x[place >= 0] for x in (k, place, tf))
        w = (1 + np.log(tf)) * idf[place]
        norm = np.sqrt(np.bincount(k, w * w, len(keys)))
        yield from _cut([keys.take(pa.array(k)), names.take(pa.array(place)), pa.array(w / norm[k])], [key, "term", "weight"])

    return _mapped(dealt_out, weighed, f"{key} {kind}, term string, weight double")
