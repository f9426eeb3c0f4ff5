import math
import random
import re
from collections import Counter, defaultdict

from kvlake.llm import lm


def brute(train, docs):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    big, uni = Counter(), Counter()
    for _, t in train:
        prev = "<s>"
        for w in tok(t):
            big[prev, w] += 1
            uni[w] += 1
            prev = w
    disc = lambda c: lm.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])
    cont = Counter(w for _, w in big)
    d, du = disc(big), disc(cont)
    total, types, pairs = sum(uni.values()), len(uni), len(big)
    ctx = defaultdict(Counter)
    for (v, w), c in big.items():
        ctx[v][w] = c
    taken = lambda c, x: sum(x[min(k, 3)] for k in c.values())
    pu = lambda w: max(cont[w] - du[min(cont[w], 3)], 0) / pairs + taken(cont, du) / pairs / (types + 1)

    def p(v, w):
        if v not in ctx:
            return pu(w)
        t = sum(ctx[v].values())
        return max(ctx[v][w] - d[min(ctx[v][w], 3)], 0) / t + taken(ctx[v], d) / t * pu(w)

    out = {}
    for i, t in docs:
        prev, s, b = "<s>", 0.0, 0.0
        for w in tok(t):
            s += math.log10(p(prev, w))
            b += math.log10((uni[w] + 1) / (total + types + 1))
            prev = w
        out[i] = (len(tok(t)), sum(uni[w] > 0 for w in tok(t)), b, s)
    known = [p(v, w) for v in ("<s>", "a") for w in [*uni, "never seen"]]
    return out, known, (total, types, pairs)


def test_scores_as_brute_force(spark):
    random.seed(3)
    words = ["a", "b", "c", "d", "e", "f", "g", "hh", "The"]
    docs = [(i, " ".join(random.choices(words, weights=[9, 5, 3, 2, 2, 1, 1, 1, 1], k=random.randint(0, 40)))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "zzz qqq a"), (93, "x" * 5000 + " a b"), (93, "x" * 5000 + " a b")]
    train = [d for d in docs if d[0] < 50]
    train += [(i, "a a a") for i in range(300)]  # counts beyond a byte
    model = lm.train(spark.createDataFrame(train, "doc_id long, text string"))
    got = {r.id: r for r in lm.scored(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    want, known, (total, types, pairs) = brute(train, docs)
    assert (model.total, model.types, model.pairs) == (total, types, pairs)
    assert all(abs(sum(known[k :: 1][: types + 1]) - 1) < 1e-9 for k in (0, types + 1))
    for i, (n, k, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (n, k)
        assert abs(got[i].base_score - base) < 1e-9 * max(1, -base)
        assert abs(got[i].score - score) < 1e-9 * max(1, -score)


def test_frequent_contexts_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 1)
    monkeypatch.setattr(lm, "OFTEN", 10)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 100)
    random.seed(5)
    docs = [(i, " ".join(random.choice("abcdefgh") if k % 2 else "the" for k in range(40))) for i in range(80)]
    model = lm.train(spark.createDataFrame(docs, "doc_id long, text string"))
    assert len(model.often) and model.buckets > 8
    got = {r.id: r for r in lm.scored(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    want, _, _ = brute(docs, docs)
    assert all(abs(got[i].score - w[3]) < 1e-8 for i, w in want.items())


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(empty)
    r = lm.scored(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), model).collect()
    assert [(x.n_tokens, x.n_known, x.score) for x in sorted(r, key=lambda x: x.n_tokens)] == [(1, 0, 0.0), (3, 0, 0.0)]
    assert lm.scored(empty, model).count() == 0
