import random

import numpy as np
import pyarrow as pa
import pytest

from kvlake.llm import near_dedup as nd
from kvlake.llm.components import components

SCHEMA = "doc_id long, text string, node string, n int"


def brute(docs, size, percent=80):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "block"), [(2, 256), (5, 2)])
def test_same_as_brute_force(spark, size, block):
    r = random.Random(size)
    docs, i = [], 0
    for _ in range(25):
        base = [r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.choice([1, 2, 4, 9, 30, 120]))]
        for _ in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 3])):
                w[r.randrange(len(w))] = "odd%d" % r.randrange(99)
            docs.append((i, " ".join(w)))
            i += 1
    chain = ["c%d" % k for k in range(200)]
    for k in range(8):  # neighbours are alike, the ends aren't
        docs.append((i, " ".join(chain[: 200 - 12 * k])))
        i += 1
    docs += [(i, None), (i + 1, ""), (i + 2, "  "), (i + 3, "x"), (i + 4, "X")]
    df = spark.createDataFrame([(a, t, "clash", 1) for a, t in docs], SCHEMA)
    got = {x.id: x for x in nd.classes(df, size=size, block=block).collect()}
    for a, (n, comp) in brute(docs, size).items():
        assert (got[a].n_shingles, got[a].component_id, got[a].kept) == (n, comp, a == comp)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", 1), (7, "a b c d e f", "", 1), (7, "a b c d e f", "", 1), (9, "A b c d e f", "", 1)], SCHEMA)
    got = sorted(map(tuple, nd.classes(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)], key=repr)
    assert nd.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_link_their_texts(spark):
    """As brute force over rows, with the rows of one id linked."""
    r = random.Random(8)
    bases = [[f"{k}w{j}" for j in range(r.choice([6, 20, 60]))] for k in range(12)]
    rows = []
    for _ in range(60):
        w = list(r.choice(bases))
        if r.random() < 0.4:
            w[r.randrange(len(w))] = "odd"
        rows.append((r.randrange(40), " ".join(w)))
    rows += [(103, bases[0][0]), (105, bases[0][0]), (105, "quite another text"), (109, "Quite another text")]
    n = len(rows)
    both = brute([(k, t) for k, (_, t) in enumerate(rows)], 5)
    comp = {k: both[k][1] for k in range(n)}
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if (rows[a][0] == rows[b][0] or comp[a] == comp[b]) and comp[a] != comp[b]:
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if c == high else c for k, c in comp.items()}
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    df = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    got = sorted((x.id, x.n_shingles, x.component_id) for x in nd.classes(df).collect())
    assert got == sorted((rows[k][0], both[k][0], least[comp[k]]) for k in range(n))


def test_estimates():
    r = np.random.default_rng(3)
    for n, share in ((5000, 0.9), (1000, 0.9), (1000, 0.5), (40, 0.9), (9, 0.9)):
        k = int(n * share)
        for _ in range(20):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[:k], r.integers(0, 2**63, n - k).astype(np.uint64)])
            x, y = nd.registers([a, b], nd.SKETCH, fill=False)
            guess, true = nd.estimate(x, y[None])[0][0], k / (2 * n - k)
            assert abs(guess - true) < 0.1
            assert nd.fair(x, n, y[None], np.array([n]), 0.8)[0] or true < 0.8
    assert not nd.registers([np.zeros(0, np.uint64)]).any()


def test_shingles():
    sets = nd.shingle_sets(pa.array(["a b c", "A  b\tc", "a b", None, "", "b a"]), 2)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and sets[2][0] in sets[0] and sets[5][0] != sets[2][0]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 105), (105, 103), (7, 7), (300, 301)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[103] == got[105] == 100 and got[301] == 300
