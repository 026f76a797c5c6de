"""Language-model scores by a subword lattice.

A word's probability is the sum over all ways to cut it into pieces of an existing vocabulary, each way weighing the product of its pieces'
probabilities; a forward recursion gives the sum, on scaled probabilities where these can't leave the range of doubles, else on logarithms.
The pieces' probabilities are learned from the training words by expectation-maximisation over the same lattice. Each training word is also
an arc of its own: absolute discounting takes a little from every seen word and gives it to the lattice, which so spells unseen words. A
document's probability is further summed over a few classes (languages, as training documents name them; a scored document's own is not
looked at), each with its own pieces and words. The probabilities of all words and of the end sum to one at most.

Words travel as (block, number) pairs: a block of documents numbers its own words, word counts meet by word, and come back to the
block; no task holds the whole vocabulary, and each word is priced once."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, discard, gathered, map_batches, text_of, written

#: Tokens of a block, and bytes of its words; with them its dictionary is bounded. Its documents are counted by PART_TOKENS. Words longer
#: than LONG bytes are scored one at a time, and learned from in stretches of so many bytes. ROUNDS of expectation-maximisation, and
#: CLASSES (the last takes all names but the commonest).
BLOCK_TOKENS, BLOCK_BYTES, PART_TOKENS, LONG, ROUNDS, CLASSES = 4_000_000, 1 << 26, 1 << 18, 96, 3, 5
_START, _STOP = b" ", b"\n"  # neither occurs in a word
_STRETCH = 1 << 14
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Bytes of words whose lattices are summed at once, and how far from 0 the logarithms of plain numbers may go (doubles reach to 708).
STEP, RANGE = 1 << 17, 600


@dataclass
class Pieces:
    """Pieces as bytes, in two classes that share no mass: those that begin a word (with a blank) and the others, the stop included."""

    strings: list[bytes]
    logp: np.ndarray  # natural logarithms

    def starts(self) -> np.ndarray:
        return np.array([s.startswith(_START) for s in self.strings])


def read_pieces(model_file: str) -> Pieces:
    """A sentencepiece file's vocabulary, with every single byte so that nothing is without a path. The first weights fall with the
    pieces' ranks in the file (its scores are ranks, where it is a merge vocabulary)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        s = sp.id_to_piece(i).replace("▁", " ").encode()
        if _START not in s[1:] and _STOP not in s and s.lower() == s:
            weight[s] = 1 / (100 + len(weight))
    low = min(weight.values(), default=1.0) / 100
    for b in range(256):
        for s in (bytes([b]), _START + bytes([b])):
            weight.setdefault(s, low)
    weight[_START] = weight.get(_START, low)
    weight[_STOP] = 0.2 * sum(v for s, v in weight.items() if not s.startswith(_START))
    strings = sorted(s for s in weight if s == _START or s == _STOP or _START not in s[1:])
    return normalised(strings, np.array([weight[s] for s in strings]))


def normalised(strings: list[bytes], weight: np.ndarray) -> Pieces:
    p = Pieces(strings, np.zeros(len(strings)))
    first = p.starts()
    for own in (first, ~first):
        p.logp[own] = np.log(weight[own] / weight[own].sum())
    return p


@dataclass
class Arcs:
    """The pieces found in some words, ordered by the level (bytes before it in its word) at which a piece begins. Sums are kept by place,
    the places of a level side by side: arcs of a level end at different places."""

    begins: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    words: np.ndarray  # each arc's word
    cuts: list[int]  # arcs of a level
    levels: list[int]  # places of a level
    stops: np.ndarray  # each word's last place

    def steps(self) -> list[tuple[int, slice]]:
        return [(k, slice(a, b)) for k, (a, b) in enumerate(itertools.pairwise(self.cuts)) if a < b]


class Lattice:
    """Log-probabilities and expected piece counts of many words at once: pieces are found by walking down a tree of their bytes from all
    places, then sums go from level to level, for all words together. Every single byte must be a piece (as read_pieces sees to), and a blank
    stands at a piece's beginning only."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.sizes = np.array([len(s) for s in pieces.strings])
        self.bytes = [i for i, s in enumerate(pieces.strings) if len(s) == 1 or (len(s) == 2 and s.startswith(_START))]
        flat, at = np.frombuffer(b"".join(pieces.strings), dtype=np.uint8), np.cumsum(self.sizes) - self.sizes
        node, edges, total = np.zeros(len(at), dtype=np.int64), [], 1
        for d in range(self.sizes.max()):
            own = np.flatnonzero(self.sizes > d)
            made, which = np.unique(node[own] * 256 + flat[at[own] + d], return_inverse=True)
            node[own] = total + which
            edges.append(made)
            total += len(made)
        keys = np.concatenate(edges)  # of the nodes from 1 on: parent and byte
        inner = np.zeros(total, dtype=bool)
        inner[keys >> 8] = True
        number = np.argsort(np.argsort(~inner, kind="stable"))  # nodes that go on come first; 0 is the root, so no node's child
        self.inner = int(inner.sum())
        self.next = np.zeros(self.inner << 8, dtype=np.int32)
        self.next[(number[keys >> 8] << 8) + (keys & 255)] = number[1:]
        self.piece = np.full(total, -1, dtype=np.int32)
        self.piece[number[node]] = np.arange(len(at))

    def _found(self, s: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of all pieces that begin at these places of s, which ends with a blank: no piece goes on with one."""
        out, node, m = [], np.zeros(len(begins), dtype=np.int64), 0
        while len(begins):
            m += 1
            node <<= 8
            node += s.take(begins + (m - 1))
            node = self.next.take(node)
            ids = self.piece.take(node)
            hit = np.flatnonzero(ids >= 0)
            own = begins.take(hit)
            out.append((own, own + m, ids.take(hit)))
            on = np.flatnonzero((node > 0) & (node < self.inner))
            begins, node = begins.take(on), node.take(on).astype(np.int64)
        x, y, z = zip(*out, strict=True)
        return np.concatenate(x), np.concatenate(y), np.concatenate(z).astype(np.int64)

    def _arcs(self, words: list[bytes]) -> Arcs:
        """The arcs of words of LONG bytes at most."""
        n = len(words)
        s = np.frombuffer(b"".join([_START + w + _STOP + _START for w in words]), dtype=np.uint8)
        size = np.array([len(w) for w in words]) + 3  # the blank between words stands for the place behind a word's end
        word = np.repeat(np.arange(n), size)
        level = (np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint8)
        place = np.empty(len(s), dtype=np.int64)
        place[np.argsort(level, kind="stable")] = np.arange(len(s))
        last = np.cumsum(size) - 1
        inside = np.ones(len(s), dtype=bool)
        inside[last] = False
        begins, ends, ids = self._found(s, np.flatnonzero(inside))
        at = level.take(begins)
        order = np.argsort(at, kind="stable")
        begins, ends, ids = begins.take(order), ends.take(order), ids.take(order)
        cuts, levels = ([0, *np.cumsum(np.bincount(x, minlength=size.max())).tolist()] for x in (at, level))
        return Arcs(place.take(begins), place.take(ends), ids, word.take(begins), cuts, levels, place.take(last))

    def _scale(self, table: np.ndarray) -> float:
        """What a byte adds to a piece's logarithm so that sums over s bytes lie within exp(-s * scale) and exp(s * scale): every string can
        be cut into single bytes, the first with its blank, and no sum of probabilities is over one."""
        return float(-table[:, self.bytes].min()) / 2

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        """Words of like length, about STEP bytes of them, with the greatest length; those of more than LONG bytes one at a time."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        part = np.where(size[order] > LONG, -np.arange(len(order)) - 1, np.cumsum(size[order] + 3) // STEP)
        for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
            yield own, int(size[own[-1]])

    def log_probs(self, words: list[bytes], weights: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural log of each word's marginal probability, a row for each set of piece weights."""
        table = np.stack([self.pieces.logp] if weights is None else weights)
        scale = self._scale(table)
        logs = np.ascontiguousarray(table.T)
        scaled = np.exp(logs + scale * self.sizes[:, None])
        out = np.zeros((len(words), len(table)))
        for own, most in self._groups(words):
            if most > LONG:
                out[own[0]] = self._one(words[own[0]], table)
                continue
            arcs, plain = self._arcs([words[i] for i in own.tolist()]), (most + 2) * scale < RANGE
            alpha = np.full((arcs.levels[-1], len(table)), 0.0 if plain else -np.inf)
            alpha[: arcs.levels[1]] = 1 if plain else 0
            for _, at in arcs.steps():
                before, w = alpha.take(arcs.begins[at], axis=0), (scaled if plain else logs).take(arcs.ids[at], axis=0)
                if plain:
                    before *= w
                    alpha[arcs.ends[at]] += before
                else:
                    alpha[arcs.ends[at]] = np.logaddexp(alpha[arcs.ends[at]], before + w)
            out[own] = alpha[arcs.stops]
            if plain:
                out[own] = np.log(out[own]) - scale * np.array([len(words[i]) + 2 for i in own.tolist()])[:, None]
        return out.T

    def _one(self, word: bytes, table: np.ndarray) -> np.ndarray:
        """The same for one long word: pieces are found for a stretch of places at once, and only the last few sums are kept."""
        s = np.frombuffer(_START + word + _STOP, dtype=np.uint8)
        most = int(self.sizes.max())
        alpha = np.full((len(s) + 1, len(table)), -np.inf)
        alpha[0] = 0
        for lo in range(0, len(s), _STRETCH):
            begun = max(0, lo - most)
            part = s[begun : lo + _STRETCH]
            froms, ends, ids = self._found(np.append(part, np.uint8(_START[0])), np.arange(len(part)))
            own = np.flatnonzero(ends + begun > lo)
            own = own[np.argsort(ends[own], kind="stable")]
            ends, froms, ids = ends[own] + begun, froms[own] + begun, ids[own]
            cuts = np.flatnonzero(np.diff(ends, prepend=-1)).tolist()
            add = table[:, ids].T
            for a, b in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                x = alpha[froms[a:b]] + add[a:b]
                top = x.max(axis=0)
                alpha[ends[a]] = top + np.log(np.exp(x - top).sum(axis=0))
        return alpha[-1]

    def expected(self, words: list[bytes], weights: list[np.ndarray] | None = None, sets: np.ndarray | None = None) -> np.ndarray:
        """Expected number of each piece over all cuts of the words, each word once, a row for each set of piece weights; `sets` names each
        word's (without it there is one, and a plain row comes back). Words of more than LONG bytes in stretches."""
        table = np.stack([self.pieces.logp] if weights is None else weights)
        of = np.zeros(len(words), dtype=np.int64) if sets is None else np.asarray(sets, dtype=np.int64)
        if any(len(w) > LONG for w in words):
            of = np.repeat(of, [max(1, -(-len(w) // LONG)) for w in words])
            words = [w[at : at + LONG] for w in words for at in range(0, max(1, len(w)), LONG)]
        scale, logs, out = self._scale(table), table.ravel(), np.zeros(table.size)
        scaled = np.exp(table + scale * self.sizes).ravel()
        for own, most in self._groups(words):
            arcs = self._arcs([words[i] for i in own.tolist()])
            ids = arcs.ids + (of[own] * table.shape[1]).take(arcs.words)
            plain = (most + 2) * scale < RANGE
            shares = self._shares(arcs, scaled.take(ids)) if plain else self._log_shares(arcs, logs.take(ids))
            out += np.bincount(ids, weights=shares, minlength=len(out))
        return out if sets is None else out.reshape(table.shape)

    def _shares(self, arcs: Arcs, w: np.ndarray) -> np.ndarray:
        """How often each arc is expected, by sums from the words' beginnings and from their ends."""
        alpha, beta, out = np.zeros(arcs.levels[-1]), np.zeros(arcs.levels[-1]), np.empty(len(w))
        alpha[: arcs.levels[1]] = 1
        for _, at in arcs.steps():
            out[at] = alpha.take(arcs.begins[at]) * w[at]
            alpha[arcs.ends[at]] += out[at]
        beta[arcs.stops] = 1 / alpha[arcs.stops]  # so that shares are of the whole sum
        for k, at in reversed(arcs.steps()):
            tail = beta.take(arcs.ends[at])
            out[at] *= tail
            tail *= w[at]
            a, b = arcs.levels[k : k + 2]
            beta[a:b] += np.bincount(arcs.begins[at] - a, weights=tail, minlength=b - a)
        return out

    def _log_shares(self, arcs: Arcs, w: np.ndarray) -> np.ndarray:
        """The same on logarithms, for words whose sums may leave the range of doubles."""
        alpha, beta, out = np.full(arcs.levels[-1], -np.inf), np.full(arcs.levels[-1], -np.inf), np.empty(len(w))
        alpha[: arcs.levels[1]] = 0
        for _, at in arcs.steps():
            out[at] = alpha[arcs.begins[at]] + w[at]
            alpha[arcs.ends[at]] = np.logaddexp(alpha[arcs.ends[at]], out[at])
        beta[arcs.stops] = -alpha[arcs.stops]
        for _, at in reversed(arcs.steps()):
            tail = beta[arcs.ends[at]]
            out[at] += tail
            np.logaddexp.at(beta, arcs.begins[at], tail + w[at])
        return np.exp(out)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def _classes(docs: DataFrame, class_col: str | None, classes: int | None) -> list:
    """The commonest few names among training documents (all, where `classes` is None); all others share one more class."""
    if class_col not in docs.columns or classes == 1:
        return []
    out = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")).cast("binary")) % 7 == 2
    found = docs.where(~out).groupBy(class_col).count().orderBy(F.desc("count"), F.asc_nulls_first(class_col))
    return [r[0] for r in (found if classes is None else found.limit(classes - 1)).collect()]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text as ascii_words gives them, for all at once: words a text, bytes a word, and these bytes."""
    data, at = _flat(texts)
    data = _LOWER[data]
    inner = np.zeros(len(data) + 2, dtype=bool)
    inner[1:-1] = ~_WHITE[data]
    starts, stops = inner[1:] & ~inner[:-1], inner[:-1] & ~inner[1:]
    edges = at[(at > 0) & (at < len(data))]  # a word ends with its text
    starts[edges], stops[edges] = inner[edges + 1], inner[edges]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops)
    return np.diff(np.searchsorted(starts, at)), stops - starts, data[inner[1:-1]]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins; the last number is their end."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(at, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of these sizes, side by side in data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))), pa.py_buffer(data)])


def _planes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Values under 2^32, so many a row: all lowest bytes of a row, then the next, as the upper ones are nearly all zero and compress."""
    at = np.cumsum(counts) - counts
    to = np.arange(len(values)) + np.repeat(3 * at, counts)
    width, data = np.repeat(counts, counts), np.empty(4 * len(values), dtype=np.uint8)
    for k in range(4):
        data[to + k * width] = (values >> 8 * k) & 255
    return _binary(data, 4 * counts).cast(pa.binary())


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What _planes was given, with where each row begins."""
    data, at = _flat(column)
    counts = np.diff(at) // 4
    to, width = np.arange(len(data) // 4) + np.repeat(3 * at[:-1] // 4, counts), np.repeat(counts, counts)
    return sum(data[to + k * width].astype(np.int64) << 8 * k for k in range(4)), at // 4


def _blocks(docs: DataFrame, classes: int) -> DataFrame:
    """Two kinds of rows. kind 0, a document: its words' numbers in its block (ascending, as steps from one to the next) and how often each
    occurs, its length and class. kind 1, a word of a block: its number and its training counts there, one for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tokens, size = TaskContext.get().partitionId() << 24, 0, 0
        held: list[tuple] = []

        def rows(kind: int, size: int, /, **given: pa.Array) -> pa.RecordBatch:
            fixed = {"kind": pa.array(np.full(size, kind, dtype=np.int8)), "block": pa.array(np.full(size, block, dtype=np.int64))} | given
            return pa.RecordBatch.from_arrays([fixed.get(k, pa.nulls(size, t)) for k, t in kinds], names=[k for k, _ in kinds])

        def rest() -> Iterator[pa.RecordBatch]:
            """The rows of the documents in `held`."""
            ids = pa.array([i for h in held for i in h[0]], type=pa.int64())
            out, kind, n, sizes, data = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            held.clear()
            found = _binary(data, sizes).dictionary_encode()
            number, own = found.indices.to_numpy(), found.dictionary
            at = np.concatenate(([0], np.cumsum(n)))
            counts = np.zeros(len(own) * classes, dtype=np.int64)
            cuts = np.flatnonzero(np.diff(at[:-1] // PART_TOKENS, prepend=-1)).tolist()
            for a, b in itertools.pairwise(sorted({*cuts, *range(0, len(n), BATCH_ROWS), len(n)})):
                now, doc = number[at[a] : at[b]].astype(np.int64), np.repeat(np.arange(b - a), n[a:b])
                pairs = np.sort(doc << 32 | now)  # a document's words in ascending order
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                times, used, doc = np.diff(first, append=len(pairs)), pairs[first] & 0xFFFFFFFF, pairs[first] >> 32
                learned = ~out[a:b][doc]
                np.add.at(counts, used[learned] * classes + kind[a:b][doc[learned]], times[learned])
                lengths = np.bincount(doc, minlength=b - a)
                new = np.flatnonzero(np.diff(doc, prepend=-1))
                steps = np.diff(used, prepend=0)  # small numbers, so that few bytes move
                steps[new] = used[new]
                yield rows(0, b - a, doc_id=ids[a:b], held_out=pa.array(out[a:b]), n=pa.array(n[a:b] + 1), class_no=pa.array(kind[a:b].astype(np.int32)),
                    ids=_planes(steps, lengths), times=_planes(times, lengths))
            counts = counts.reshape(-1, classes)
            for at in range(0, len(own), 50_000):
                part = own[at : at + 50_000].cast(pa.binary())
                yield rows(1, len(part), idx=pa.array(np.arange(at, at + len(part), dtype=np.int32)), word=part, **{f"n{k}": pa.array(counts[at : at + len(part), k]) for k in range(classes)})

        for batch in batches:
            n, sizes, data = _words(batch.column(1))
            if batch.num_rows:
                ids = batch.column(0).to_pylist()
                held.append((ids, np.array([held_out(i) for i in ids]), batch.column(2).to_numpy().copy(), n, sizes, data))
            tokens, size = tokens + len(sizes) + len(n), size + len(data)
            if tokens >= BLOCK_TOKENS or size >= BLOCK_BYTES:
                yield from rest()
                block, tokens, size = block + 1, 0, 0
        if held:
            yield from rest()

    kinds = [("kind", pa.int8()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("class_no", pa.int32()), ("ids", pa.binary()), ("times", pa.binary()), ("idx", pa.int32()), ("word", pa.binary())]
    kinds += [(f"n{k}", pa.int64()) for k in range(classes)]
    schema = "kind byte, block long, doc_id long, held_out boolean, n long, class_no int, ids binary, times binary, idx int, word binary, " + ", ".join(f"n{k} long" for k in range(classes))
    return written(map_batches(docs, run, schema), "blocks", "zstd")


@dataclass
class Class:
    """One class: log10 of its share of documents, its pieces' weights, and counts of words, ends, distinct words; discount."""

    share: float
    logp: np.ndarray
    words: int
    ends: int
    types: int
    discount: float
    arcs: bool = True  # whether seen words are arcs of their own

    def end(self) -> float:
        return (self.ends + 0.5) / (self.words + self.ends + 1)

    def word_log10(self, count: np.ndarray, spelled: np.ndarray, overall: np.ndarray) -> np.ndarray:
        """Discounted counts, and for what they leave half the lattice, half the words' shares in all classes."""
        stop = math.log10(1 - self.end())
        if not self.arcs:
            return stop + spelled / math.log(10)
        with np.errstate(divide="ignore"):
            rest = np.logaddexp(spelled, np.log(overall)) - (math.log(2) if self.words else 0.0)
            if not self.words:
                return stop + rest / math.log(10)
            own = np.log(np.maximum(count - self.discount, 0) / self.words)
            return stop + np.logaddexp(own, rest + math.log(self.discount * self.types / self.words)) / math.log(10)


@dataclass
class Model:
    pieces: Pieces
    classes: list[Class]

    def __post_init__(self) -> None:
        self.words = sum(c.words for c in self.classes)
        self.ends = sum(c.ends for c in self.classes)
        self.distinct = 0

    def base_log10(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.words + self.ends + (self.distinct + 1)))


def fit(types: DataFrame, ends: list[int], pieces: Pieces, rounds: int = ROUNDS, arcs: bool = True) -> Model:
    """Totals over all training words, and piece weights by `rounds` of expectation-maximisation over each class's distinct words: each
    round every task adds up expected counts, one row for each piece and class at most."""
    n = len(ends)
    sums = [f(k) for k in range(n) for f in (
        lambda k: F.sum(f"c{k}").alias(f"w{k}"), lambda k: F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"t{k}"),
        lambda k: F.sum((F.col(f"c{k}") == 1).cast("long")).alias(f"a{k}"), lambda k: F.sum((F.col(f"c{k}") == 2).cast("long")).alias(f"b{k}"))]
    total = sum(F.col(f"c{k}") for k in range(n))
    t = types.agg(*sums, F.sum((total > 0).cast("long")).alias("distinct")).first().asDict()
    t = {k: v or 0 for k, v in t.items()}
    weights = [pieces.logp] * n
    for _ in range(rounds if t["distinct"] else 0):

        def run(batches: Iterator[pa.RecordBatch], now: list = weights) -> Iterator[pa.RecordBatch]:
            lattice, made = Lattice(pieces), np.zeros((n, len(pieces.strings)))
            for batch in gathered(batches):
                words = batch.column(0).to_pylist()
                at, k = np.nonzero(np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(n)], axis=1))
                made += lattice.expected([words[i] for i in at.tolist()], now, k)
            k, at = np.nonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at), pa.array(made[k, at])], names=["k", "piece", "x"])

        found = map_batches(types.select("word", *[f"c{k}" for k in range(n)]), run, "k int, piece long, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).collect()
        weight = np.full((n, len(pieces.strings)), 0.01)  # no piece loses all its mass
        for r in found:
            weight[r["k"], r["piece"]] += r["x"]
        weights = [normalised(pieces.strings, w).logp for w in weight]
    papers = sum(ends)
    model = Model(pieces, [
        Class(math.log10((ends[k] + 0.5) / (papers + 0.5 * n)), weights[k], t[f"w{k}"], ends[k], t[f"t{k}"], min(0.95, max(0.05, t[f"a{k}"] / (t[f"a{k}"] + 2 * t[f"b{k}"]) if t[f"a{k}"] else 0.5)), arcs)
        for k in range(n)])
    model.distinct = t["distinct"] + (papers > 0)
    return model


def score_documents(docs: DataFrame, model_file: str, class_col: str | None = "lang", classes: int | None = CLASSES, arcs: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score over all whole texts.

    Learned from documents whose crc32(doc_id as text) mod 7 is not 2, their class names included. Null and empty texts hold the end
    alone; a null id counts as the text "None" would; repeated rows count as often as they come; an empty table gives an empty table;
    without class_col there is one class, and with classes=None each name has its own. arcs=False leaves the lattice of pieces alone.
    Scores are finite for any text."""
    names = _classes(docs, class_col, classes)
    n = len(names) + 1
    number = F.lit(len(names))
    for k in range(len(names) - 1, -1, -1):
        number = F.when(F.col(class_col).eqNullSafe(F.lit(names[k])), k).otherwise(number)
    blocks = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), number.cast("int").alias("class_no")), n)
    got = {r["class_no"]: r["n"] for r in blocks.where("kind = 0 AND NOT held_out").groupBy("class_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = blocks.where("kind = 1")
    types = written(words.groupBy("word").agg(*[F.sum(f"n{k}").alias(f"c{k}") for k in range(n)]), "words", "zstd")
    model = fit(types, [got.get(k, 0) for k in range(n)], read_pieces(model_file), arcs=arcs)
    weights = [c.logp for c in model.classes]

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.pieces)
        for batch in gathered(batches):
            c = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(n)])
            spelled = lattice.log_probs(batch.column(0).to_pylist(), weights)
            all_c = c.sum(axis=0)
            overall = all_c / max(1, model.words)
            lp = np.stack([own.word_log10(c[k], spelled[k], overall) for k, own in enumerate(model.classes)], axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_c), pa.array([r.tobytes() for r in lp], type=pa.binary())], names=["word", "c", "lp"])

    # written, so that both sides of the join below are plain exchanges: a word that all blocks hold can be split
    priced = written(map_batches(types.select("word", *[f"c{k}" for k in range(n)]), price, "word binary, c long, lp binary"), "priced", "zstd")
    discard(types)
    priced = words.select(F.col("block").alias("of"), "idx", "word").join(priced, "word").select(F.col("of").alias("block"), "idx", "c", "lp")
    end_score = np.array([math.log10(c.end()) + c.share for c in model.classes])
    end_base, end_known, total = float(model.base_log10(np.array([model.ends]))[0]), int(model.ends > 0), model.words + model.ends

    def add_up(doc_rows: pa.Table, word_rows: pa.Table) -> pa.Table:
        idx = word_rows.column("idx").to_numpy()
        c = word_rows.column("c").to_numpy()
        of_word = np.zeros((int(idx.max()) + 1 if len(idx) else 0, n + 2))  # a word's scores by class, its base score, whether it is known
        if len(idx):
            of_word[idx, :n] = _flat(word_rows.column("lp").combine_chunks())[0].view("<f4").reshape(-1, n)
            of_word[idx, n], of_word[idx, n + 1] = model.base_log10(c), c > 0
        rows = doc_rows.num_rows
        sums = np.zeros((rows, n + 2))
        for a in range(0, rows, BATCH_ROWS):
            steps, at = _values(doc_rows.column("ids").slice(a, BATCH_ROWS).combine_chunks())
            some = np.flatnonzero(np.diff(at))
            if len(some):
                times, ids = _values(doc_rows.column("times").slice(a, BATCH_ROWS).combine_chunks())[0], np.cumsum(steps)
                ids -= np.repeat((ids - steps)[at[some]], np.diff(at)[some])  # steps begin anew in each document
                sums[a + some] = np.add.reduceat(of_word.take(ids, axis=0) * times[:, None], at[some], axis=0)
        score = sums[:, :n] + end_score
        top = score.max(axis=1, initial=-np.inf)
        return pa.table({"doc_id": doc_rows.column("doc_id"), "held_out": doc_rows.column("held_out"), "n_tokens": doc_rows.column("n"), "n_known": pa.array(np.rint(sums[:, n + 1]).astype(np.int64) + end_known),
            "train_tokens": pa.array(np.full(rows, total, dtype=np.int64)), "base_score": pa.array(sums[:, n] + end_base), "score": pa.array(top + np.log10((10.0 ** (score - top[:, None])).sum(axis=1)))})

    papers = blocks.where("kind = 0").select("block", "doc_id", "held_out", "n", "ids", "times")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return papers.groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(add_up, schema)
