import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from kvlake.llm import decontaminate as dc
from kvlake.llm.fm_index import FMIndex, suffix_order


def words(t):
    return [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]


def brute(docs, bench, window=10):
    pats = {}
    for item, t in bench:
        w = [x[0] for x in words(t)]
        if item is not None:
            for k in range(max(1, len(w) - window + 1) if w else 0):
                pats.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for _, t in docs:
        w = words(t)
        hit, items = set(), set()
        for p, own in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(x[0] for x in w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= own
        out.append((len(w), len(hit), sorted(items)))
    return out


def tables(spark, seed=1, n=80):
    r = random.Random(seed)
    voc = ["Ab", "c1", "d", "été", "f", "g7", "h"]
    bench = [(k, " ".join(r.choice(voc) for _ in range(r.choice([3, 9, 10, 12, 25])))) for k in range(12)] + [(50, "..."), (51, None), (None, "ab c1 d"), (0, "ab d ab d")]
    docs = []
    for i in range(n):
        w = [r.choice([*voc, "other", "More"]) for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            at = r.randint(0, len(w))
            w[at:at] = r.choice(bench[:12])[1].upper().split()
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1]), (903, " ".join(["d"] * 3000))]
    return docs, bench


def test_same_as_brute_force(spark):
    docs, bench = tables(spark)
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, hits string").coalesce(1)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    for limit in ({}, {"block_bytes": 60}, {"shard_bytes": 500}):
        out, name = dc.searched(d, b, **limit)
        assert name == "hits_"
        got = sorted(out.collect(), key=lambda r: r.doc_id)
        for r, (n, hit, items), (i, t) in zip(got, [w for _, w in sorted(zip([x[0] for x in docs], want), key=lambda x: x[0])], sorted(docs, key=lambda x: x[0]), strict=True):
            assert (r[name].n_words, r[name].n_hit, list(r[name]["items"])) == (n, hit, items), (i, t)
            covered = sum(s.start <= a and e <= s.stop for _, a, e in words(t) for s in r[name].spans)
            assert covered == hit


def test_cleaned_texts_hold_nothing(spark):
    docs, bench = tables(spark, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    out, name = dc.searched(d, b, text="clean")
    rows = out.select("doc_id", "text", F.col(name)["n_hit"].alias("n")).collect()
    assert all(hit == 0 for _, hit, _ in brute([(r.doc_id, r.text) for r in rows], bench))
    before = dict(docs)
    assert all(r.text == before[r.doc_id] for r in rows if r.n == 0) and any(r.n for r in rows)


def test_cleaning_by_blocks_is_cleaning_by_one(spark):
    # overlapping windows of several items, items of one text, and a passage that a cut joins together
    said = [f"w{k}" for k in range(40)]
    bench = [(k, " ".join(said[5 * k : 5 * k + 12])) for k in range(5)] + [(10 + k, " ".join(said[:12])) for k in range(4)] + [(20, " ".join("abcdefghijkl"))]
    docs = [(1, " ".join(said)), (2, "x " + " ".join(said[3:16]) + " y"), (3, "a b c d e " + " ".join(said[:12]) + " f g h i j k l m"), (4, "none"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(bench, "item_id long, text string").coalesce(1)
    got = []
    for limit in ({}, {"block_bytes": 120}):
        out, name = dc.searched(d, b, text="clean", **limit)
        got.append(sorted(repr((r.doc_id, r.text, r[name])) for r in out.collect()))
    assert got[0] == got[1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out, name = dc.searched(d, none)
    assert tuple(out.first()[name])[:2] == (2, 0)
    assert dc.searched(d.where("doc_id > 5"), none)[0].count() == 0


def test_index_against_plain_search():
    r = np.random.default_rng(2)
    for sigma, n in ((2, 300), (5, 2000), (40, 500)):
        t = r.integers(1, sigma + 1, n)
        t[r.integers(0, n, n // 15)] = 0
        t[-1] = 0
        sa = suffix_order(t)
        assert sorted(sa) == list(range(n))
        index = FMIndex(t, sigma, 4)
        pats = np.stack([t[k : k + 3] for k in r.integers(0, n - 3, 60)])
        pats = np.unique(pats[(pats > 0).all(axis=1)], axis=0)
        lo, hi = index.search(pats.ravel(), np.arange(len(pats)) * pats.shape[1], pats.shape[1])
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [k for k in range(n - 2) if (t[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_a_full_block_stays_small():
    """Windows of a block near its bound take a few times its bytes."""
    tracemalloc.start()
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 50000, 400)) for _ in range(1000)]
    size = sum(map(len, texts))
    w = dc.Windows([str(k) for k in range(1000)], texts, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.groups) == 1 and len(w.groups[0][1]) == 1000 * 391 and peak < 22 * size
