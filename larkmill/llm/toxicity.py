"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

Strings are compared by the gap-weighted subsequence kernel: common subsequences of three characters count, each less the longer its
spans, so gaps and inserted characters lower a match instead of hiding it. The kernel is normalised (1 of a string with itself) and taken
to a power, which keeps it positive semidefinite. A word counts by the best of its beginnings and the whole, with a mark at its start.
Kernel values against landmark strings, mapped by the inverse square root of the landmarks' own kernel matrix (Nystroem), give each
word's vector; a text is the mean of its words' vectors and their maximum. Landmarks and machine are learned from labelled texts."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, written

#: Kernel: subsequence length (the code below is for 3), the farthest that its neighbours may lie apart, decay of each spanned
#: character, the power, and the sizes (with the mark) of a word's beginnings that are compared.
ORDER, GAP, DECAY, POWER, STARTS = 3, 3, 0.7, 8, (6, 7, 8, 9)
#: Landmarks from toxic and from other texts, and labelled documents that the fit takes at most (about; chosen by a hash of the id).
LANDMARKS, PLAIN, SAMPLE = 32, 16, 20_000
MARK, WIDE = "^", 32
#: From this value on, norms are exact; lower ones, 0.0003 at most after the power, are normalised by length alone.
EXACT = 0.35
_CHUNK = 2048
_SIGNS = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_NO_SIGNS = str.maketrans("", "", _SIGNS)
_SPELLED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")


def _codes(strings: list[str]) -> np.ndarray:
    """Code points of strings of one length, a column for each string."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<i4")
    return np.ascontiguousarray(flat.reshape(len(strings), -1).T)


def _by_length(strings: list[str]) -> Iterator[tuple[int, list[int]]]:
    by: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(len(s), []).append(i)
    for length, idx in by.items():
        for at in range(0, len(idx), _CHUNK):
            yield length, idx[at : at + _CHUNK]


def weights(s: str) -> dict[tuple[str, str, str], float]:
    """The kernel's feature map: each subsequence of three characters with the sum of DECAY ** span over its places."""
    out: dict[tuple[str, str, str], float] = {}
    for i in range(len(s)):
        for j in range(i + 1, min(i + GAP + 1, len(s))):
            for k in range(j + 1, min(j + GAP + 1, len(s))):
                u = (s[i], s[j], s[k])
                out[u] = out.get(u, 0.0) + DECAY ** (k - i + 1)
    return out


@functools.cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all subsequences of a string of this length."""
    all_ = [(i, j, k) for i in range(length) for j in range(i + 1, min(i + GAP + 1, length)) for k in range(j + 1, min(j + GAP + 1, length))]
    i, j, k = np.array(all_, dtype=np.int64).reshape(-1, 3).T
    return i, j, k


def _norms(c: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Square roots of the kernel of beginnings of these sizes with themselves: strings (columns of c) x sizes."""
    i, j, k = _triples(len(c))
    code = (c[i].astype(np.int64) << 42) | (c[j].astype(np.int64) << 21) | c[k].astype(np.int64)
    order = np.argsort(code, axis=0, kind="stable")
    same = np.take_along_axis(code, order, axis=0)
    first = np.concatenate((np.ones((1, code.shape[1]), dtype=bool), same[1:] != same[:-1])).T.reshape(-1)
    at = np.flatnonzero(first)
    out = np.empty((code.shape[1], len(sizes)))
    for column, size in enumerate(sizes):
        w = np.where(k < size, DECAY ** (k - i + 1), 0.0)
        sums = np.add.reduceat(w[order].T.reshape(-1), at) ** 2
        out[:, column] = np.sqrt(np.bincount(at // len(i), weights=sums, minlength=code.shape[1]))
    return out


@functools.cache
def _plain_norm(size: int) -> float:
    """The norm of a string in which no subsequence comes twice."""
    i, _, k = _triples(size)
    return float(np.sqrt((DECAY ** (2.0 * (k - i + 1))).sum()))


class Kernel:
    """Normalised kernel of any strings, by the best of their beginnings and the whole, with fixed landmarks. Only subsequences that a
    landmark has can count, so a table of those picks them out of all triples of a string's characters."""

    def __init__(self, landmarks: list[str]):
        maps = [weights(s) for s in landmarks]
        self.count = len(landmarks)
        self.letters = np.array(sorted({ord(c) for m in maps for u in m for c in u}), dtype=np.int32)
        size = len(self.letters) + 1
        number = {chr(c): i + 1 for i, c in enumerate(self.letters.tolist())}
        used = sorted({u for m in maps for u in m})
        self.size = size
        self.table = np.zeros(size**3, dtype=np.int32)
        own: list[list[tuple[int, float]]] = [[]]  # of each triple: landmarks that have it, and its weight over their norm
        for r, u in enumerate(used, 1):
            a, b, c = (number[x] for x in u)
            self.table[(a * size + b) * size + c] = r
            own.append([(m, x[u] / sum(v * v for v in x.values()) ** 0.5) for m, x in enumerate(maps) if u in x])
        self.first = np.cumsum([0] + [len(o) for o in own])
        self.mark = np.array([m for o in own for m, _ in o], dtype=np.int64)
        self.weight = np.array([v for o in own for _, v in o])

    def __call__(self, strings: list[str]) -> np.ndarray:
        """0 to 1; strings too short for a subsequence are like nothing."""
        out = np.zeros((len(strings), self.count), dtype=np.float32)
        if not len(self.letters):
            return out
        decay = DECAY ** np.arange(2 * WIDE)
        for length, idx in _by_length(strings):
            if length < ORDER:
                continue
            c = _codes([strings[i] for i in idx])
            at = np.minimum(np.searchsorted(self.letters, c), len(self.letters) - 1)
            w = np.where(self.letters[at] == c, at + 1, 0).astype(np.int32)
            sizes = [s for s in STARTS if s < length] + [length]
            begun = np.searchsorted(sizes, np.arange(length), side="right")  # the first beginning that holds a character
            i, j, k = _triples(length)
            found = self.table[(w[i] * self.size + w[j]) * self.size + w[k]]
            at, row = np.nonzero(found)
            u, v, kind = found[at, row], decay[k - i + 1][at], begun[k][at]
            many = self.first[u + 1] - self.first[u]
            each = np.repeat(self.first[u] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = (np.repeat(row, many) * len(sizes) + np.repeat(kind, many)) * self.count + self.mark[each]
            sums = np.bincount(cell, weights=np.repeat(v, many) * self.weight[each], minlength=len(idx) * len(sizes) * self.count)
            sums = sums.reshape(len(idx), len(sizes), self.count)
            for k in range(1, len(sizes)):
                sums[:, k] += sums[:, k - 1]
            made = sums[:, 0] / _plain_norm(sizes[0])
            for k, s in enumerate(sizes[1:], 1):
                np.maximum(made, sums[:, k] / _plain_norm(s), out=made)
            near = np.flatnonzero(made.max(axis=1) >= EXACT)
            if len(near):
                made[near] = (sums[near] / _norms(c[:, near], sizes)[:, :, None]).max(axis=1)
            out[idx] = made
        return out


def _units(word: str) -> list[str]:
    """A word with its mark; a very long one as overlapping windows, so that nothing of it is left out."""
    marked = MARK + word
    return [marked] if len(marked) <= WIDE else [marked[a : a + WIDE] for a in range(0, len(marked) - WIDE // 2, WIDE // 2)]


def words_of(text: str) -> list[str]:
    """White-space words in lower case, and words spelled out with blanks ("b a d") as one more word each."""
    low = text.lower()
    return low.split() + [m.replace(" ", "") for m in _SPELLED.findall(low)]


def bare(word: str) -> str:
    """Signs around a word say nothing, nor do those within."""
    return word if word.isalnum() else word.translate(_NO_SIGNS) or word


@dataclass
class Model:
    landmarks: list[str]
    whiten: np.ndarray  # landmarks x landmarks
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: tuple[float, float]

    def decide(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.slope[0] * self.decide(features) + self.slope[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def powered(k: np.ndarray) -> np.ndarray:
    """k ** POWER, by squaring in place where that is enough."""
    if POWER & POWER - 1:
        return k**POWER
    for _ in range(POWER.bit_length() - 1):
        k *= k
    return k


class Pooler:
    """Features of texts: mean and maximum of their words' kernel rows, Nystroem-mapped. Rows of the words met so far are kept up to a
    limit."""

    def __init__(self, landmarks: list[str], whiten: np.ndarray, entries: int = 100_000):
        self.landmarks, self.whiten, self.entries = landmarks, whiten, entries
        self.kernel = Kernel(landmarks)
        self.at: dict[str, int] = {}
        self.rows, self.used = np.zeros((1 << 12, len(landmarks)), dtype=np.float32), 0

    def _learn(self, words: list[str]) -> None:
        """One row for each word without its signs; the words themselves point there."""
        of: dict[str, int] = {}
        at = [of.setdefault(bare(w), len(of)) for w in words]
        rows = self.kernel([MARK + w[: WIDE - 1] for w in of])
        long = [(i, u) for i, w in enumerate(of) if len(w) >= WIDE for u in _units(w)]
        if long:
            np.maximum.at(rows, [i for i, _ in long], self.kernel([u for _, u in long]))
        self.at.update(zip(words, (self.used + i for i in at), strict=True))
        if self.used + len(rows) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), self.used + len(rows)), rows.shape[1]), dtype=np.float32)
            more[: self.used] = self.rows[: self.used]
            self.rows = more
        self.rows[self.used : self.used + len(rows)] = powered(rows)
        self.used += len(rows)

    def features(self, texts: list[str]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(texts), 2 * m))
        split = [words_of(t) for t in texts]
        for a in range(0, len(split), 256):
            group = split[a : a + 256]
            new = list({w for ws in group for w in ws if w not in self.at})
            if len(self.at) + len(new) > self.entries:
                self.at, self.used = {}, 0
                new = list({w for ws in group for w in ws})
            if new:
                self._learn(new)
            for i, ws in enumerate(group):
                if ws:
                    k = self.rows[np.fromiter(map(self.at.__getitem__, ws), dtype=np.int64, count=len(ws))]
                    out[a + i, :m] = self.whiten @ k.mean(axis=0, dtype=np.float64)
                    out[a + i, m:] = self.whiten @ k.max(axis=0)
        return out


def _candidates(text: str) -> dict[str, int]:
    """Whole words and word beginnings of 5 to 8 characters, with how often they occur, 3 at most: a passing likeness weighs less."""
    out: Counter = Counter()
    for w, n in Counter(map(bare, words_of(text))).items():
        if 3 <= len(w) <= 16:
            out[MARK + w] += n
        for k in range(5, min(9, len(w))):
            out[MARK + w[:k]] += n
    return {s: min(n, 3) for s, n in out.items()}


def choose_landmarks(sample: DataFrame, count: int = LANDMARKS) -> list[str]:
    """Strings that toxic documents hold much oftener than others; none is the beginning of another, longer ones go first.

    Every task adds up its own documents' strings and gives out what it has after some hundred thousand; the driver gets the best few
    thousand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(set(sums[0]) | set(sums[1]))
            made = pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array([sums[1][k] for k in keys], type=pa.int64()), pa.array([sums[0][k] for k in keys], type=pa.int64())], names=["s", "pos", "neg"])
            sums[0].clear()
            sums[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[toxic].update(_candidates(text))
                if len(sums[0]) + len(sums[1]) > 300_000:
                    yield out()
        yield out()

    found = map_batches(sample.select("text", "toxic"), run, "s string, pos long, neg long").groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = sample.agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all")).first()
    pos, neg = n["pos"] or 0, (n["all"] or 0) - (n["pos"] or 0)
    if not pos:
        return []
    gain = F.col("pos") * F.log((F.col("pos") / F.lit(float(pos))) / ((F.col("neg") + 0.5) / F.lit(float(neg + 1)))) * (1 + 0.03 * F.char_length("s"))
    best = found.where(F.col("pos") >= 3).select("s", gain.alias("g")).orderBy(F.desc("g"), "s").limit(4000).collect()
    chosen: list[str] = []
    for r in best:
        if r["g"] > 0 and not any(r["s"].startswith(c) or c.startswith(r["s"]) for c in chosen):
            chosen.append(r["s"])
        if len(chosen) == count:
            break
    return chosen


def plain_landmarks(sample: DataFrame, count: int = PLAIN) -> list[str]:
    """Words (at most 8 characters of each) of texts that aren't toxic, chosen by a hash."""
    words = sample.where("toxic = 0").select(F.explode(F.slice(F.split(F.lower("text"), r"\s+"), 1, 20)).alias("w")).where(F.char_length("w").between(4, 16)).distinct()
    found = [r["w"] for r in words.orderBy(F.xxhash64("w"), "w").limit(4 * count).collect()]
    return list(dict.fromkeys(MARK + bare(w)[:8] for w in found if len(bare(w)) > 3))[:count]


def whitening(landmarks: list[str]) -> np.ndarray:
    """The inverse square root of the landmarks' kernel matrix, by which kernel values become Nystroem coordinates."""
    k = Kernel(landmarks)(landmarks).astype(np.float64) ** POWER
    w, v = np.linalg.eigh((k + k.T) / 2)
    return v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-2))) @ v.T


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    s = np.where(y == 1, 1.0, -1.0)
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    a = np.hstack((x, np.ones((len(x), 1))))
    lip = 2 * np.linalg.eigvalsh((a * c[:, None]).T @ a)[-1] + 2 * reg
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - s * (a @ z))
        grad = -2 * a.T @ (c * s * slack) + 2 * reg * np.append(z[:-1], 0)
        new = z - grad / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def fit_slope(d: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve through the decisions (Platt's targets), by Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        g = np.array([((p - target) * d).sum(), (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * d * d).sum(), (v * d).sum()], [(v * d).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from about `limit` labelled documents at most (all, where there are fewer), taken by a hash of their ids.

    Labels that are null or neither 0 nor 1 are left out, rows repeated under one id count once a text. Without both labels the model
    gives every text the share of toxic labels (0 without any)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * limit / n))
    # at most about `limit` ids and labels: small enough to send to every task by the documented bound
    sample = docs.select(F.col("doc_id"), text_of().alias("text")).join(F.broadcast(known), "doc_id")
    sample = written(sample.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    spread = sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = choose_landmarks(sample, landmarks)
    marks += [m for m in plain_landmarks(sample) if m not in marks] if marks else []
    white = whitening(marks) if marks else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooler(marks, white)
        for batch in batches:
            f = pool.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in f.astype("<f4")], type=pa.binary()), batch.column(1)], names=["f", "y"])

    rows = map_batches(spread.select("text", "toxic"), run, "f binary, y int").collect()  # `limit` rows of a few hundred bytes
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    m = len(marks)
    if not m or len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        odds = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Model([], np.zeros((0, 0)), np.zeros(0), np.ones(0), np.zeros(0), 0.0, (0.0, max(-40.0, min(40.0, odds))))
    x = np.array([np.frombuffer(r["f"], dtype="<f4") for r in rows], dtype=np.float64)
    order = np.lexsort(x.T[::-1])  # rows come in any order; sums don't
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    w, b = fit_svm((x - mean) / scale, y)
    d = ((x - mean) / scale) @ w + b
    return Model(marks, white, mean, scale, w, b, fit_slope(d, y))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5). Null and empty texts get the score of no words. Columns of these
    names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes) + ", score double, predicted int"
    text_at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooler(model.landmarks, model.whiten)
        for batch in batches:
            s = model.score(pool.features([t or "" for t in batch.column(text_at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return map_batches(docs.select(*[f"`{c}`" for c in keep]), run, schema)
