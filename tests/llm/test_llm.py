"""Training-data operators against brute force, exact round trips and held-out accuracy; edge rows for each."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkmill.llm import chunks, common, decontaminate, graph, lattice, licenses, line_dedup, packing, queries, similar, simhash, sketches, token_files, tokens, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines int, fp string, part int"


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = "word " * 30_000 + "x" * 20_000
    line = "this line is long enough to count\nand so is this other line here"
    rows = [(1, None), (2, ""), (3, long), (4, line), (5, line), (5, line), (6, line + "\nshort"), (7, " \t\n"), (None, "a null id with some words in it"), (None, None), (8, "ÉTÉ ünï 日本 <|endoftext|> a\x1cb it's"), (9, line)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch(list(texts), add_special_tokens=False)]


# tokens


def test_cached_ids_are_the_tokenizers(docs):
    e = tokens.Encoder(BPE)
    assert e.by_word
    odd = ["", "a\x1cb İstanbul ΑΣ é 'S it's <|endoftext|>x", "日本語 12ab ½ ẞß don't'll.'s", "x" * 200, "á b̧", "foo&&& bar### 3.14,--", "Straße GROẞ ẞ ß's", "ABC abc \x7fa"]
    for t, want in zip([t for _, t in docs] + odd, ids_of([t for _, t in docs] + odd), strict=True):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_cached_ids_on_any_text(t):
    e = tokens.encoder(BPE)
    assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aAzZéÉßẞÿŸ×÷ÃãªºİK'’sS#<|[`{~1½\u0301\u0331\x1c\x7f\x85\xa0\u3000\t\n\x0b  日")) | st.sampled_from(["<|endoftext|>", "it's", "é" * 32, "é" * 33, "a" * 64, "a" * 65, "ab##", "##ab"]), max_size=8))
def test_ids_of_many_texts(texts):
    e, got = tokens.encoder(BPE), []
    values, counts = e.encode_all(pa.array([None, *texts], pa.string()).slice(1), b"\x01\0\0\0")
    for t in texts:
        got += [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert values.tolist() == got and len(counts) == len(texts)
    assert [values[b - 1] for b in np.cumsum(counts)] == [1] * len(texts)


def test_each_different_piece_is_looked_up_once(docs, monkeypatch):
    """op6_token_files took 470 CPU seconds a GB, of 400, when every word of every text was looked up by itself."""
    texts = [t for _, t in docs] * 3
    e, asked = tokens.Encoder(BPE), []
    find = e.known.all
    monkeypatch.setattr(e.known, "all", lambda keys: (asked.append(keys), find(keys))[1])
    values, counts = e.encode_all(pa.array(texts))
    assert len(asked) == 1 and len(set(asked[0])) == len(asked[0]) < sum(len((t or "").split()) for t in texts) / 3
    want = ids_of([t or "" for t in texts])
    assert counts.tolist() == [len(w) for w in want] and values.tolist() == [i for w in want for i in w]


def test_a_full_cache_changes_no_ids(docs, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    texts, e = [t or "" for _, t in docs][:100], tokens.Encoder(BPE)
    for at in range(0, 100, 10):
        assert e.encode_all(pa.array(texts[at : at + 10]))[0].tolist() == [i for w in ids_of(texts[at : at + 10]) for i in w]
        assert len(e.known.new) <= 50 and len(e.known.older) <= 50


# op1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_piece_once(counts):
    plan = packing.plan_bins(counts, 40)
    placed = collections.Counter()
    for combo, bins in plan:
        assert bins > 0 and sum(n * t for n, t in combo) <= 40
        for n, t in combo:
            placed[n] += t * bins
    assert placed == collections.Counter(counts)
    table = packing.slots(plan)
    assert all((np.diff(table["rank"][table["length"] == n]) > 0).all() for n in counts)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = collections.Counter(rng.integers(1, 2049, 5000).tolist())
    bins = sum(b for _, b in packing.plan_bins(counts, 2048))
    least = max(-(-sum(n * c for n, c in counts.items()) // 2048), sum(c for n, c in counts.items() if n > 1024))
    assert bins <= least * 1.01 + 1


def check_packing(out, expected):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(expected)
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by)


def pieces_of(rows):
    out = []
    for i, own in zip([i for i, _ in rows], ids_of([t or "" for _, t in rows]), strict=True):
        a = np.array(own + [0], dtype="<u4")
        out += [(i is None, i or 0, k, s, len(a[s : s + 2048]), zlib.crc32(a[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(a), 2048))]
    return out


def test_op1(spark, sf, docs):
    out = queries.op1_packing(spark, sf).collect()
    want = pieces_of(docs)
    assert check_packing(out, want) <= -(-sum(w[4] for w in want) // 2048) * 1.01 + 1


def test_op1_edges(spark, edge, empty):
    out = packing.pack(edge, BPE).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(out, pieces_of([(r["doc_id"], r["text"]) for r in edge.collect()]))
    assert packing.pack(empty, BPE).count() == 0


# op2


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        m = len(t) // 4
        new, r = t[: len(t) - m] + after[:m], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        for a, b, x in ((t, new, r["near_edited"]), (t, after, r["near_next"])):
            want = jaccard(shingles(a), shingles(b))
            assert abs(x - want) < (1e-9 if len(shingles(a) | shingles(b)) <= sketches.K else 0.2)
        assert r["fingerprint"] == sketches.to_text(sketches.sketch(t.encode().lower().split()))


def test_op2_edges(spark, edge, empty):
    rows = sketches.with_neighbours(edge).collect()
    assert len(rows) == edge.count() and sketches.with_neighbours(empty).count() == 0
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    lone = sketches.with_neighbours(edge.where("doc_id = 4")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_sketches_merge(spark):
    rng = np.random.default_rng(3)
    words = [b"%d" % x for x in rng.integers(0, 500, 6000)]
    whole = sketches.sketch(words)
    cut = sketches.merge([sketches.sketch(words[:3004]), sketches.sketch(words[3000:])])
    assert (whole == cut).all()
    true = len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    assert abs(sketches.distinct_count(whole) / true - 1) < 0.2
    part = sketches.sketch(words[:3000])
    assert sketches.containment(part, whole) > 0.8
    df = spark.createDataFrame([("a", sketches.to_text(sketches.sketch(words[:3004]))), ("a", sketches.to_text(sketches.sketch(words[3000:]))), (None, sketches.to_text(part))], "g string, fingerprint string")
    got = {r["g"]: r["fingerprint"] for r in sketches.merge_groups(df, "g").collect()}
    assert got["a"] == sketches.to_text(whole) and got[None] == sketches.to_text(part)


# op3


def test_op3(spark, sf, docs):
    marks = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    want = sorted(i for i, t in docs for m in marks for _ in range(t.count(m)))
    assert sorted(r["doc_id"] for r in queries.op3_licenses(spark, sf).collect()) == want


def test_op3_differences(spark, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "intro text\n" + mit + "\nmore text here"), (2, mit.replace("any person", "any company")), (3, "we have no license to say this"), (4, None), (5, "a " * 5000 + "released under the mit license. " + "b " * 5000), (6, "Copyright 2020 nobody")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 5} and got[1]["license"] == got[2]["license"] == "MIT" and got[5]["license"] == "MIT-notice"
    assert got[1]["n_changed"] == 0 and got[2]["differences"] == ["-person", "+company"]
    assert licenses.scan_licenses(empty).count() == 0


def test_op3_notices_inside_prose(spark, docs):
    """A notice at a text's head, with prose of any length after it or around it, and two notices in one line."""
    prose = [" ".join(t.split()) for _, t in docs if len(t.split()) > 150 and not licenses.Scanner(licenses.TEMPLATES).hint.search(t)][:20]
    want, rows = [], []
    for k, p in enumerate(prose):
        w = p.split()
        for name in ("MIT-notice", "CC-BY-NC-4.0", "Apache-2.0-notice", "GPL-3.0"):
            for n in (5, 40, 100, 150):
                rows.append((len(rows), " ".join(w[: n * (k % 2)] + [licenses.TEMPLATES[name]] + w[:n])))
                want.append((len(rows) - 1, name))
    both = f"{prose[0]} {licenses.TEMPLATES['CC-BY-4.0']} {licenses.TEMPLATES['MIT-notice']} {prose[1]}"
    rows.append((len(rows), both))
    want += [(len(rows) - 1, "CC-BY-4.0"), (len(rows) - 1, "MIT-notice")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == sorted(want) and all(r["n_changed"] == 0 for r in got)
    text = dict(rows)
    assert all(text[r["doc_id"]][r["at"] :].startswith(licenses.TEMPLATES[r["license"]]) for r in got)


@pytest.mark.parametrize("text, want", [
    ("Released under the MIT License", ["MIT-notice"]), ("Released under the MIT license, see LICENSE.", ["MIT-notice"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("// SPDX-License-Identifier: MIT", ["SPDX:MIT"]), ("(Licensed under the GNU Lesser General Public License, version 2.1)", ["LGPL-2.1-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]), ("This work is licensed under the GNU General Public License, version 4.", []),
    ("This work is not licensed under the GNU General Public License, version 3.", []), ("SPDX-License-Identifier: Nothing", []), ("license licence copyright", []),
])
def test_op3_wording(text, want):
    assert [x[1] for x in licenses.Scanner(licenses.TEMPLATES).scan(text)] == want


def test_op3_every_template_in_prose(docs):
    """All templates, with and without a sign behind them, at any place of prose; long ones also with a word in ten changed."""
    scanner, rng = licenses.Scanner(licenses.TEMPLATES), np.random.default_rng(4)
    prose = [t.split() for _, t in docs if t and len(t.split()) > 150 and not scanner.hint.search(t)]
    for name, template in licenses.TEMPLATES.items():
        for k, end in enumerate(("", ".", ",", ".")):
            words = prose[rng.integers(len(prose))]
            at = int(rng.integers(0, 100))
            own = template.rstrip(".:").split()
            if k == 3:
                for i in range(5, len(own) - 5, 10):
                    own[i] = own[i] if any(c.isdigit() for c in own[i]) or scanner.hint.search(own[i]) else "changed"
            got = scanner.scan(" ".join(words[:at]) + "\n" + " ".join(own) + end + " " + " ".join(words[at : at + 200]))
            assert [x[1] for x in got] == [name] and (k == 3 or got[0][3] == 0), (name, end, got)


# op4


def test_lattice_is_the_sum_over_all_cuts():
    strings = sorted([b" ", b"\n", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"bab"] + [bytes([c]) for c in range(256) if c not in b" \nab"] + [b" " + bytes([c]) for c in range(256) if c not in b"a"])
    p = lattice.normalised(strings, np.array([1.0 + i % 7 for i in range(len(strings))]))
    prob = dict(zip(p.strings, np.exp(p.logp), strict=True))

    def brute(s):
        return 1.0 if not s else sum(prob[s[:n]] * brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in prob)

    words = [b"a", b"ab", b"abab", b"babba", "é".encode(), b"b" * 12]
    got = lattice.Lattice(p).log_probs(words)[0]
    assert np.allclose(np.exp(got), [brute(b" " + w + b"\n") for w in words], rtol=1e-9)
    rng = np.random.default_rng(2)
    long = [b"ab" * 60, bytes(rng.choice(list(b"ab"), 40_000).tolist())]  # one at a time, over several stretches

    def forward(s):
        alpha = [0.0]
        for j in range(1, len(s) + 1):
            own = [alpha[i] + math.log(prob[s[i:j]]) for i in range(max(0, j - 4), j) if s[i:j] in prob]
            alpha.append(max(own) + math.log(sum(math.exp(x - max(own)) for x in own)))
        return alpha[-1]

    assert np.allclose(lattice.Lattice(p).log_probs(long, [p.logp, p.logp]), [[forward(b" " + w + b"\n") for w in long]] * 2)
    e = lattice.Lattice(p).expected(words)
    assert abs(sum(x * len(s) for x, s in zip(e, p.strings, strict=True)) - sum(len(w) + 2 for w in words)) < 1e-6


def test_lattice_counts_by_set_without_logarithms(monkeypatch):
    """Expected pieces of words under their own set of weights, by enumeration of all cuts; logarithms are summed only for words whose
    probabilities may leave the range of doubles (before, for all), with the same result."""
    strings = sorted([b" a", b"ab", b"ba", b" ab", b"bab", b"bb"] + [bytes([c]) for c in range(256)] + [b" " + bytes([c]) for c in range(256) if c not in b"a"])
    first, second = (lattice.normalised(strings, np.array([1.0 + (i * f) % 11 for i in range(len(strings))])) for f in (3, 7))
    tables, where = [first.logp, second.logp], {s: i for i, s in enumerate(strings)}

    def cuts(s):
        return [[]] if not s else [[where[s[:n]], *rest] for n in range(1, min(4, len(s)) + 1) if s[:n] in where for rest in cuts(s[n:])]

    words, sets = [b"a", b"ab", b"abab", b"babba", "é".encode(), b"ab", b"bbbab"], np.array([0, 1, 1, 0, 1, 0, 1])
    want = np.zeros((2, len(strings)))
    for w, k in zip(words, sets, strict=True):
        found = cuts(b" " + w + b"\n")
        odds = np.exp([sum(tables[k][i] for i in c) for c in found])
        for c, x in zip(found, odds / odds.sum(), strict=True):
            np.add.at(want[k], c, x)
    model = lattice.Lattice(first)
    long = [b"ab" * 40, bytes([255]) * 96, b"a" * 300]
    slow, slow_logs = (f() for f in (lambda: model.expected(long, tables, np.array([0, 1, 1])), lambda: model.log_probs(long[:2], tables)))
    with monkeypatch.context() as m:
        m.setattr(lattice, "RANGE", 0)
        on_logs, logs = model.expected(words, tables, sets), model.log_probs(words, tables)
        assert np.allclose(model.expected(long, tables, np.array([0, 1, 1])), slow) and np.allclose(model.log_probs(long[:2], tables), slow_logs)

    def never(*args, **kwargs):
        raise AssertionError("a sum on logarithms")

    monkeypatch.setattr(np, "logaddexp", never)
    assert np.allclose(model.expected(words, tables, sets), want) and np.allclose(on_logs, want) and np.allclose(model.log_probs(words, tables), logs)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBÉ日 \n\t\x0b\x0c\r\x1c\x85\u2003", max_size=12), max_size=6))
def test_lattice_words_of_many_texts(texts):
    n, sizes, data = lattice._words(pa.array(["x y", *texts, "z"]).slice(1, len(texts)))
    words = [common.ascii_words(t) for t in texts]
    assert n.tolist() == [len(w) for w in words] and sizes.tolist() == [len(w) for ws in words for w in ws] and data.tobytes() == b"".join(w for ws in words for w in ws)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=5), max_size=6))
def test_lattice_planes_round_trip(rows):
    column = lattice._planes(np.array([x for r in rows for x in r], dtype=np.int64), np.array([len(r) for r in rows], dtype=np.int64))
    values, at = lattice._values(column)
    assert [values[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == rows


def test_op4(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.op4_lattice_score(spark, sf).collect()}
    split = {i: t.encode().lower().split() + [None] for i, t in docs}
    train = collections.Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in split.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(train[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 and -1e9 < r["score"] < 0


def test_op4_score_by_hand(spark, docs, monkeypatch):
    """Document scores from the model's definition: classes mixed, seen words discounted, the rest half lattice and half the words' shares,
    with the lattice's sum by enumeration of all cuts."""
    kept = []
    real = lattice.fit
    monkeypatch.setattr(lattice, "fit", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    rows = [(i, " ".join(w[:7] for w in t.split()[:40]), "ab"[i % 2]) for i, t in docs[:40]] + [(1000, "", None), (1001, "unseen wördz", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lattice.score_documents(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    model = kept[0]
    train = [(i, t.encode().lower().split(), g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    names = [g for g, _ in sorted(collections.Counter(g for _, _, g in train).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))][:4]
    assert len(model.classes) == len(names) + 1
    of = lambda g: names.index(g) if g in names else len(names)
    count = [collections.Counter(w for _, ws, g in train if of(g) == k for w in ws) for k in range(len(names) + 1)]
    every = sum(count, collections.Counter())
    papers = [sum(of(g) == k for _, _, g in train) for k in range(len(names) + 1)]

    def cuts(s, prob):
        return 1.0 if not s else sum(prob[s[:n]] * cuts(s[n:], prob) for n in range(1, len(s) + 1) if s[:n] in prob)

    for i, t, _ in rows:
        if i % 3 and i < 1000:
            continue
        sums = []
        for k, c in enumerate(model.classes):
            prob, w = dict(zip(model.pieces.strings, np.exp(c.logp), strict=True)), sum(count[k].values())
            end = (papers[k] + 0.5) / (w + papers[k] + 1)
            total = math.log(end * (papers[k] + 0.5) / (len(train) + 0.5 * len(papers)))
            for x in t.encode().lower().split():
                rest = cuts(b" " + x + b"\n", prob) + every[x] / max(1, sum(every.values()))
                p = max(0, count[k][x] - c.discount) / w + c.discount * len(count[k]) / w * rest / 2 if w else rest
                total += math.log((1 - end) * p)
            sums.append(total)
        want = (max(sums) + math.log(sum(math.exp(x - max(sums)) for x in sums))) / math.log(10)
        assert abs(got[i]["score"] - want) < 1e-4 * max(1, abs(want))
    alone = lattice.score_documents(df, public_tokenizers.path("piece_bpe_32k.model"), None, arcs=False).collect()
    assert len(kept[-1].classes) == 1 and all(math.isfinite(r["score"]) for r in alone)


def test_op4_edges(spark, edge, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = lattice.score_documents(edge, model).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1}
    assert lattice.score_documents(empty, model).count() == 0
    assert lattice.score_documents(edge.select("doc_id", "text"), model).count() == edge.count()


# op5


def lines_brute(rows, least=20, many=3):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                held[key(s)].add(i)
    drop = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) >= many}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if key(s) not in drop or drop[key(s)] == i]
        out.append((i is None, i or 0, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_op5(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.line_dedup(df).collect()
    assert sorted((False, r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == lines_brute(docs)


def test_op5_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, queries.op5_line_dedup(spark, sf).select("doc_id", "kept_sha256", "n_dropped", "n_lines").collect()))
    assert got == sorted(c.execute(f"SELECT doc_id, kept_sha256, n_dropped, n_lines FROM ({queries.ORACLES['op5_line_dedup']})").fetchall())


def test_op5_edges(spark, edge, empty):
    out = line_dedup.line_dedup(edge)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == lines_brute(rows)
    assert line_dedup.line_dedup(empty).count() == 0 and set(out.columns) == set(edge.columns) | {"n_dropped"}
    assert not [n for n in out._jdf.queryExecution().toString().split() if "Python" in n or "Arrow" in n]


# op6


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=200))
def test_values_round_trip(values):
    v = np.array(values, dtype=np.uint32)
    assert token_files.unpack_values(*token_files.pack_values(v), len(v)).tolist() == values
    blob = token_files.file_bytes([7, None], np.array([0, len(v)]), np.array([len(v), 0]), v)
    ids, _, counts, got = token_files.parse_file(blob)
    assert ids == [7, None] and counts.tolist() == [len(v), 0] and got.tolist() == values
    with pytest.raises(ValueError):
        token_files.parse_file(blob[:-1])


def tokens_brute(rows):
    out, at = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, _), own in zip(rows, ids_of([t or "" for _, t in rows]), strict=True):
        a = np.array(own + [1], dtype="<u4")
        out.append((i is None, i or 0, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    return sorted(out)


def test_op6(spark, sf, docs):
    got = sorted((False, *r) for r in queries.op6_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == tokens_brute(docs)


def test_op6_files_close_after_the_document_that_fills_them(spark, docs):
    path = common.scratch_path(spark, "tokens")
    made = token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), path, BPE, shard_tokens=500)
    got = sorted((r["part"], r["file"], r["docs"], r["values"]) for r in made.collect())
    lengths = {i: len(ids) + 1 for (i, _), ids in zip(docs, ids_of([t or "" for _, t in docs]), strict=True)}
    rest = [lengths[i] for i in sorted(lengths)]
    for k, (part, _, n, values) in enumerate(got):
        own, rest = rest[:n], rest[n:]
        assert sum(own) == values and sum(own[:-1]) < 500
        assert values >= 500 or k + 1 == len(got) or got[k + 1][0] > part
    assert not rest and len(got) > 20


def test_op6_takes_no_more_tasks_than_partitions(spark, docs):
    sc, n = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc.setJobGroup("op6 tasks", "op6 tasks")
    try:
        token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), common.scratch_path(spark, "tokens"), BPE)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(k) for j in seen.getJobIdsForGroup("op6 tasks") for k in seen.getJobInfo(j).stageIds]
    assert n in [s.numTasks for s in stages if s] and max(s.numTasks for s in stages if s) <= n


def test_op6_edges(spark, edge, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digest(edge, BPE).collect())
    assert got == tokens_brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert token_files.token_digest(empty, BPE).count() == 0


# op7


def simhash_brute(text, k=3):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_op7(spark, sf, docs):
    fps = np.array([simhash_brute(t) for _, t in docs], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.array([i for i, _ in docs])
    while (new := np.where(near, label[None], 2**62).min(axis=1)).tolist() != label.tolist():
        label = new
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{int(f):016x}", int(c)) for (i, _), f, c in zip(docs, fps, label, strict=True)}


def test_op7_edges(spark, edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5, 9)} == {4}
    assert simhash.near_duplicates(empty).count() == 0


def test_links_lose_nothing(spark):
    """All pairs within the radius, in a group larger than a block, against all-pairs comparison."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:10].tolist():
        for _ in range(280):
            x = b
            for bit in rng.choice(20, rng.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    while (new := np.where(near, label[None], 2**62).min(axis=1)).tolist() != label.tolist():
        label = new
    df = spark.createDataFrame([(i, [simhash._signed(int(f))]) for i, f in enumerate(fps)], "rep long, fp array<long>")
    old, simhash.BLOCK = simhash.BLOCK, 100
    try:
        found = graph.components(simhash.links(df, simhash.pigeonhole_keys(3, 5), 3, 1))
        got = {r["node"]: r["root"] for r in found.collect()}
    finally:
        simhash.BLOCK = old
    assert [got.get(i, i) for i in range(len(fps))] == label.tolist()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_wide_fingerprints_find_similar_texts(spark):
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 100000, 400)]
    rows = [(i, " ".join(f"u{x}" for x in rng.integers(0, 100000, 400))) for i in range(100, 140)] + [(1, " ".join(words))]
    for i, n in ((2, 2), (3, 4), (4, 6)):  # words changed: similarities of about 0.95, 0.9 and 0.86
        own = list(words)
        for at in np.linspace(20, 380, n).astype(int):
            own[at] = f"c{i}{at}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and all(got[i] == i for i in range(100, 140))


# op8


def edits_brute(item, text):
    """Least edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_op8_against_alignment(spark, sf, docs):
    bench = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()[:8]
    rng = np.random.default_rng(1)
    rows = []
    for k, (i, t) in enumerate(bench):
        for n in (0, 3, 8, 40):
            own = list(decontaminate.normalise(t))
            for at in rng.choice(len(own), n, replace=False):
                own[at] = "#" if rng.random() < 0.6 else ""
            rows.append((1000 + 10 * k + n % 10, docs[k][1][:300] + " " + "".join(own).upper() + " " + docs[k][1][300:500]))
    rows += docs[20:40]
    index = decontaminate.build_index(bench)
    got = decontaminate.find(index, [decontaminate.normalise(t) for _, t in rows])
    for (_, t), own in zip(rows, got, strict=True):
        found = {i: e for i, e, _, _ in own}
        for k, (i, item) in enumerate(bench):
            best = edits_brute(decontaminate.normalise(item), decontaminate.normalise(t))
            assert found.get(i) == (best if best <= index.edits[k] else None)


def test_op8_shared_prompts_and_passes(spark, docs, monkeypatch):
    """Items that begin alike, against a text that repeats that beginning; small limits on pairs and passes change nothing."""
    import time

    rng = np.random.default_rng(8)
    fresh = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    prompt = "answer the question below in one word and say nothing else please: "
    bench = [(i, prompt + fresh(30)) for i in range(50)]
    texts = [prompt * 60, prompt * 5 + bench[7][1] + prompt * 5, bench[3][1][:-4] + "x", fresh(300)]
    index = decontaminate.build_index(bench)
    begun = time.time()
    got = decontaminate.find(index, texts)
    assert time.time() - begun < 5
    assert [[r[:2] for r in own] for own in got] == [[], [(7, 0)], [(3, 4)], []]
    for t, own in zip(texts[1:3], got[1:3], strict=True):
        assert all(decontaminate.least_edits(dict(bench)[r[0]], t)[0] == r[1] == edits_brute(dict(bench)[r[0]], t) for r in own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.find_leaks(df, items).collect()))
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 3000)
    assert sorted(map(tuple, decontaminate.find_leaks(df, items).collect())) == whole and decontaminate.drop_leaks(df, items).count() == 2
    monkeypatch.setattr(decontaminate, "_PAIRS", 50)
    assert decontaminate.find(index, texts) == got


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=12), st.text("ab", max_size=30))
def test_least_edits(item, text):
    edits, end = decontaminate.least_edits(item, text)
    assert edits == edits_brute(item, text)


def test_op8_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "AND SO  is this other line here"), (5, "never there " * 9)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(edge, bench).collect()) == [(4, 4), (5, 4), (5, 4), (6, 3), (6, 4), (9, 4)]
    left = decontaminate.drop_leaks(edge, bench)
    assert left.columns == edge.columns and left.count() == edge.count() - 5
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(edge, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(edge, bench.limit(0)).count() == edge.count()


# op9


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_cover_the_text(data):
    ends = chunks.cut_points(data)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = np.diff([0, *ends])
    assert (sizes <= chunks.MOST).all() and (sizes[:-1] >= chunks.LEAST).all()


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(0).integers(0, 256, 500, dtype=np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear_hashes(data).tolist() == want


def test_op9_finds_shifted_passages(spark, edge, empty):
    rng = np.random.default_rng(4)
    words = lambda n, p: " ".join(f"{p}{x}" for x in rng.integers(0, 10**6, n))
    passages = [words(60, "p") for _ in range(12)]
    rows = [(i, words(80, "a")) for i in range(50)]
    rows += [(100 + 2 * k + side, words(5 + 7 * k + 31 * side, "b") + " " + p + " " + words(40, "c")) for k, p in enumerate(passages) for side in (0, 1)]
    got = {r["doc_id"]: r for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == set(range(100, 124)) and all(got[100 + 2 * k + 1]["other_ids"] == [100 + 2 * k] for k in range(12))
    text = dict(rows)
    for i, r in got.items():
        for s in r["spans"]:
            assert text[i].encode()[s["at"] : s["at"] + s["size"]].decode() in " ".join(passages)
    assert chunks.repeats(edge).count() == 0 and chunks.repeats(empty).count() == 0  # their common lines are short
    assert {r["doc_id"] for r in chunks.repeats(edge, within=True).collect()} == {3}
    assert {r["doc_id"] for r in chunks.repeats(edge, min_bytes=30).collect()} == {4, 5, 6, 9}


def test_op9_recall(spark, docs):
    """Passages of 51 to 100 words of prose, each put into two texts at different places: all are to be found, and texts that share
    40 words at most are to be left alone."""
    rng = np.random.default_rng(11)
    prose = [t.split() for _, t in docs if len(t.split()) > 400]
    rows, want = [], set()
    fill = lambda n: " ".join(f"z{x}" for x in rng.integers(0, 10**9, n))
    for k in range(400):
        n = int(rng.choice([51, 55, 60, 75, 100])) if k % 4 else 36
        own = prose[k % len(prose)]
        at = int(rng.integers(0, len(own) - n))
        passage = " ".join([f"q{k}", *own[at : at + n - 1]]) if k % 4 == 0 else " ".join(own[at : at + n])
        for _ in range(2):
            rows.append((len(rows), f"{fill(int(rng.integers(1, 60)))} {passage} {fill(int(rng.integers(1, 60)))}"))
        if k % 4:
            want |= {len(rows) - 2, len(rows) - 1}
    by = collections.defaultdict(set)  # passages may overlap: what shares 45 words or more in a row is to be found too
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 44):
            by[tuple(w[a : a + 45])].add(i)
    shared = {i for v in by.values() if len(v) > 1 for i in v}
    got = {r["doc_id"] for r in chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= shared and len(want - got) <= 0.005 * len(want) and got <= shared


def test_op9_brute_force(spark, docs):
    """Chunks grouped by their bytes and stretches grown over the words themselves, in Python, for all documents."""
    texts = [(i, t) for i, t in docs if t]
    held = collections.defaultdict(set)
    for i, t in texts:
        data, at = t.encode(), 0
        for end in chunks.cut_points(data):
            held[data[at:end]].add(i)
            at = end
    text = dict(texts)

    def around(i, piece):
        data = text[i].encode()
        at = 0
        for end in chunks.cut_points(data):
            if data[at:end] == piece:
                yield data[:at].split()[::-1][: chunks.REACH], data[end:].split()[: chunks.REACH]
            at = end

    def same(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for i, t in texts:
        data, at, spans, run = t.encode(), 0, [], []
        for end in [*chunks.cut_points(data), None]:
            piece = data[at:end] if end else None
            if end and len(held[piece]) > 1:
                run.append((at, end))
            elif run:
                a, b = run[0][0], run[-1][1]
                words = len(data[a:b].split())
                grown = []
                for (x, y), k in ((run[0], 0), (run[-1], 1)):
                    piece_ = data[x:y]
                    mine = (data[:x].split()[::-1], data[y:].split())[k][: chunks.REACH]
                    grown.append({same(mine, o[k]) for other in {min(held[piece_]), max(held[piece_])} - {i} for o in around(other, piece_)})
                spans.append((a, b - a, words, grown))
                run = []
            at = end
        want[i] = spans
    got = {r["doc_id"]: r["spans"] for r in chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, spans in want.items():
        own = {(s["at"], s["size"]): s["n_words"] for s in got.get(i, [])}
        for a, n, words, (left, right) in spans:
            least, most = words + min(left) + min(right), words + max(left) + max(right)
            if (a, n) in own:
                assert chunks.MIN_WORDS <= own.pop((a, n)) and most >= chunks.MIN_WORDS
            else:
                assert least < chunks.MIN_WORDS
        assert not own


# op10


def kernel_brute(a, b):
    p, q = toxicity.weights(a), toxicity.weights(b)
    return sum(v * q.get(u, 0) for u, v in p.items()) / (sum(v * v for v in p.values()) * sum(v * v for v in q.values())) ** 0.5 if p and q else 0.0


def word_brute(word, mark):
    return max(kernel_brute(word[:n], mark) for n in (*(s for s in toxicity.STARTS if s < len(word)), len(word)))


def test_string_kernel_is_the_feature_products():
    marks = ["^idiot", "^réeux", "^ab", "^banana"]
    words = ["^idiot", "^idxiot", "^idiooot", "^réeuxpa", "^réeuxellement", "^other", "^", "^a", "^bananabanana", "^aaaaaaaa", "^ananas"]
    got = toxicity.Kernel(marks)(words)
    for a, w in enumerate(words):
        for b, m in enumerate(marks):
            want = word_brute(w, m)
            assert abs(got[a, b] ** toxicity.POWER - want**toxicity.POWER) < 1e-3 and (want < toxicity.EXACT or abs(got[a, b] - want) < 1e-5)
    assert got[0, 0] > 0.999 and got[3, 1] > 0.999 and got[1, 0] > 0.5


def test_features_and_decision_by_hand():
    """Nystroem coordinates, their mean and maximum, and the machine's score of texts, from the kernel's definition."""
    marks = ["^idiot", "^clown", "^table"]
    k = np.array([[word_brute(a, b) ** toxicity.POWER for b in marks] for a in marks])
    w, v = np.linalg.eigh((k + k.T) / 2)
    root = v @ np.diag(w**-0.5) @ v.T
    assert np.allclose(toxicity.whitening(marks), root, atol=1e-4) and np.allclose(root @ k @ root, np.eye(3), atol=1e-6)
    texts = ["You IDIOT, you", "a c l o w n of id-iot", "", "tables and clowns " * 3]
    made = toxicity.Pooler(marks, root).features(texts)
    words = [["you", "idiot", "you"], ["a", "c", "l", "o", "w", "n", "of", "idiot", "aclown"], [], ["tables", "and", "clowns"] * 3]
    for row, ws in zip(made, words, strict=True):
        rows = np.array([[word_brute("^" + x, m) ** toxicity.POWER for m in marks] for x in ws]) if ws else np.zeros((1, 3))
        assert np.allclose(row, np.concatenate((root @ rows.mean(axis=0), root @ rows.max(axis=0))), atol=2e-3)
    model = toxicity.Model(marks, root, np.arange(6.0), np.full(6, 2.0), np.linspace(-1, 1, 6), 0.3, (2.0, -0.1))
    want = [1 / (1 + math.exp(-(2.0 * (sum((x - m) / 2.0 * g for x, m, g in zip(row, range(6), np.linspace(-1, 1, 6), strict=True)) + 0.3) - 0.1))) for row in made]
    assert np.allclose(model.score(made), want)


def test_op10_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op10_toxicity(spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").fetchall()
    held = [(rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert sum(p == y for p, y in held) / len(held) > 0.93 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())


def test_op10_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (5, 1), (9, 1), (6, 1), (3, 0), (8, 0), (2, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels)
    out = toxicity.score_documents(edge, model)
    assert out.count() == edge.count() and set(out.columns) == set(edge.columns) | {"predicted"}
    none = toxicity.train(edge, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(edge, none).collect()} <= {0.0} | {r["score"] for r in toxicity.score_documents(edge, none).collect() if r["score"] < 1e-8}
    assert toxicity.score_documents(empty, model).count() == 0
