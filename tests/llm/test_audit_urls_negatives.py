"""Filter audit, URL rules and hard negatives against plain Python and their SQL; edge rows for each."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.llm import filter_audit, negatives, queries, url_rules

BLANK = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_url_filters", "op13_hard_negatives"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    ran = con.execute(queries.ORACLES[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(ran.fetchall(), key=repr)


# filter audit

DOC = "doc_id long, text string, source string, part string, bits int, good string, kept string, step string"


def audited(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic). A plain walk through every order."""
    out = {}
    for part in {d[2] or "" for d in docs}:
        own = [d for d in docs if (d[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for step, name in enumerate(order, 1):
                bad = [i for i, d in enumerate(own) if fails(d, docs)[name]]
                here = [i for i in bad if i not in gone]
                redundant = len(bad) - len(here)
                gone |= set(here)
                unique = sum(fails(own[i], docs)[name] and sum(fails(own[i], docs).values()) == 1 for i in range(len(own)))
                marks = [(any(own[i][0] is not None and x[0] == own[i][0] and x[1] == 1 for x in labels), any(own[i][0] is not None and x[0] == own[i][0] and x[2] == 1 for x in labels)) for i in here]
                out[part, order, step] = [len(own) - len(gone), len(here), redundant, unique, sum(g for g, _ in marks), sum(t for _, t in marks)]
    return out


def fails(doc, docs):
    text = doc[1] or ""
    words = [w for w in BLANK.split(text) if w]
    copy = doc[0] is not None and any(d[0] is not None and d[0] < doc[0] and (d[1] or "") == text for d in docs)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(7)
    pool = ["", "a few WORDS", " ".join(f"w{i}" for i in range(300)), "same " * 250, "x|y " * 199 + "end here", "ÉÈ ü\x1c\u00a0日本 " * 80, "A" * 50 + " b" * 400, None]
    docs = [(i if i % 13 else None, rnd.choice(pool), rnd.choice(["web", "books", None])) for i in range(60)] + [(5, pool[2], "web"), (5, pool[2], "web")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 50, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_by_hand(spark, mixed, monkeypatch):
    docs, labels = mixed
    df = spark.createDataFrame([(i, t, s, "p", 3, "g", "k", "s") for i, t, s in docs], DOC)
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("bits", F.lit(1))
    want = audited(docs, labels)
    for parts in (128, 1):  # also where a task hands counts on early
        monkeypatch.setattr(filter_audit, "PARTS", parts)
        got = filter_audit.audit(df.repartition(3), named).collect()
        assert len(got) == len(want) == 3 * 600
        for r in got:
            assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] == want[r.part, r.filter_order, r.step]
            assert r.shapley == sum(v[1] for (part, order, step), v in want.items() if part == r.part and order[step - 1] == r.filter)


def test_first_failures():
    for bits, (at, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        assert filter_audit.FIRST[bits, at] == next((s for s, c in enumerate(order) if bits >> "ABCDE".index(c) & 1), 5)


def test_audit_edges(spark):
    empty = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    long = spark.createDataFrame([(1, "Word# " * 400_000, "s", None, None, None, None, None)], DOC)
    rows = filter_audit.audit(long, labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.removed for r in rows] == [0, 1, 0, 0, 0] and [r.redundant for r in rows] == [0, 0, 1, 1, 0]


# URL rules


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(raw) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], f[2], f[3] == "block"), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTPS://A.Example.ORG/en/12?x#y", "http://example.org/en/1", "http://notexample.org/en/1", "http://x.example.org/es", "http://x.example.org/es/a", "http://com/fr/x", "http://a.com#/de/", "http://a.com/de/?q", "ftp://u:p@a.b.com:80/de/", "a://b://c.org/", "http://É.org/ü\n/x", "http://.org/", "http://a..org/", "http://org./", "http://" + "a." * 3000 + "org/" + "p" * 9000]


def test_url_rules_by_hand(spark, monkeypatch):
    rnd = random.Random(3)
    hosts, ends = ["org", "com", "example.org", "a.com", "b.a.com", "É.org", "a.org"], ["", "/", "/e", "/en/", "/en/1", "/d"]
    urls = URLS + [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'WWW.x.'])}{rnd.choice(hosts)}{rnd.choice(ends)}{rnd.choice(['', '2', '/z', '?q=/en/', '#t'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(urls)] + [(0, urls[0], "own", "own")], "page_id long, url string, host string, verdict string")
    for size, shuffled in ((5, False), (40, True)):
        rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")][:size]
        if shuffled:
            monkeypatch.setattr(url_rules, "SENT_RULES", 0)
            rules = [(rnd.choice(["allow", "block"]), rnd.choice([*hosts, ""]), rnd.choice(ends)) for _ in range(size)] + [("block", "org", "never"), (None, "org", "/"), ("block", None, "/"), ("other", "com", "/")]
        usable = [(v, h, p) for v, h, p in rules if v in ("allow", "block") and h is not None and (p == "" or p.startswith("/"))]
        got = url_rules.judge_urls(pages, spark.createDataFrame(rules, url_rules.RULE_SCHEMA))
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        rows = got.collect()
        assert len(rows) == len(urls) + 1
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, usable), r.url


def test_url_digest_collisions(spark, monkeypatch):
    """With one digit of the digest, most expressions meet a rule, and none is confirmed wrongly."""
    monkeypatch.setattr(url_rules, "SHORT", 1)
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p{i}") for i in range(50)], "page_id long, url string")
    rules = spark.createDataFrame([("block", f"h{i}.net", "/p") for i in range(0, 50, 7)], url_rules.RULE_SCHEMA)
    rows = url_rules.judge_urls(pages, rules).collect()
    assert {r.page_id for r in rows if r.verdict == "block"} == set(range(0, 50, 7))


def test_url_edges(spark):
    rules = url_rules.rule_table(spark, queries.URL_RULES)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(empty, rules).count() == 0
    one = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert [tuple(r)[2:] for r in url_rules.judge_urls(one, rules.limit(0)).collect()] == [("example.org", "/es/", None, "allow")]


def test_url_filters_run_no_python(spark, sf):
    plan = queries.op12_url_filters(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# hard negatives

VEC = "id long, label int, vector array<double>, key string, vec string, block int"


def mined(rows, every=50, positives=5, negatives=3):
    seen = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        while q and q[-1] == 0:
            q.pop()
        if sum(x * x for x in q) <= 2**52 and (i, label, q) not in seen:
            seen.append((i, label, q))
    out = set()
    for i, label, q in (r for r in seen if r[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, r[2])), r[0], r[1]) for r in seen)
        near = [(-s, j) for s, j, other in scored if other == label and j != i][:positives]
        for p, j in near:
            hard = [(-s, k) for s, k, other in scored if other != label and 50 * p <= -100 * s <= 95 * p][:negatives]
            out |= {(i, j, rank, k, p, s) for rank, (s, k) in enumerate(hard, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "k", "v", 1) for i, label, v in rows], VEC)


@pytest.mark.parametrize("block_rows", [None, 40])
def test_negatives_by_hand(spark, block_rows):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 12))
    rows = [(int(i), int(i % 6), (centres[i % 6] * rnd.uniform(0.3, 1.2) + 0.5 * rnd.normal(size=12)).tolist()) for i in range(700)]
    rows += [(1000 + i, i % 3, centres[0].tolist()) for i in range(150)]  # one vector under three labels, many times
    rows += [(2000, 1, [0.0] * 12), (2050, 2, [0.0] * 12), (50, 3, centres[1].tolist()), (100, int(100 % 6), rows[100][2]), (2100, 4, centres[2].tolist()[:5])]
    got = negatives.hard_negatives(frame(spark, rows).repartition(3), F.col("id") % 50 == 0, block_rows=block_rows).collect()
    assert {tuple(r) for r in got} == mined(rows) and len(got) == len(mined(rows))


def test_walk_is_exact_and_leaves_parts_out(monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 3))
    x = np.floor(1000 * x / np.linalg.norm(x, axis=1)[:, None]).astype("<i4")
    labels, packed = [int(v) for v in rnd.integers(0, 4, 3000)], [v.tobytes() for v in x]
    space = negatives.Space(3, int((x.astype(int) ** 2).sum(axis=1).max()))
    monkeypatch.setattr(negatives, "LEAF", 96)
    block = negatives.Block(space, labels, packed, [[i] for i in range(3000)])
    starts = [n for n in block.tree.nodes if len(n) == 2]
    assert sorted(i for s, e in starts for i in range(s, e)) == list(range(3000))
    looked = []
    whole = block.rows
    block.rows = type("Seen", (), {"__getitem__": lambda self, key: looked.append(key) or whole[key]})()
    for i in range(0, 3000, 100):
        own, q, by = space.askers([packed[i]])
        s = x.astype(int) @ x[i].astype(int)
        lo, hi = int(0.4 * s[i]), int(0.8 * s[i])
        want = sorted((-int(s[j]), j) for j in range(3000) if labels[j] != labels[i] and lo <= s[j] <= hi)[:3]
        got = block.nearest(own[0], by[0], space.distances(q, block.tree.seen)[0], labels[i], False, lo, hi, -(2**62), 3)
        assert got == [(-a, j) for a, j in want]
    assert len(looked) < 0.5 * 30 * len(starts)


def test_negatives_edges(spark):
    every = F.col("id") % 50 == 0
    assert negatives.hard_negatives(frame(spark, []), every).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(None, 1, [1.0]), (0, None, [1.0]), (50, 1, None), (100, 1, [1.0, None]), (150, 1, [nan]), (200, 1, [inf]), (250, 1, [1e300]), (300, 1, []), (350, 2, [])]
    assert negatives.hard_negatives(frame(spark, rows), every).count() == 0
    rows += [(400, 1, [1.0, 0.0]), (401, 1, [1.0]), (402, 2, [0.9]), (403, 2, [0.2]), (404, 2, [0.9]), (450, 3, [-1.0])]
    assert {tuple(r) for r in negatives.hard_negatives(frame(spark, rows), every).collect()} == mined(rows)
    assert len(mined(rows)) == 18
