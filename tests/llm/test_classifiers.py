import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.llm import crf, lang_id, quality, toxicity
from kvlake.llm.sampling import per_class

SYLLABLES = {"en": ["th", "ing", "er", "an", "wh"], "de": ["sch", "ung", "ein", "ch", "keit"], "fr": ["eau", "oi", "que", "é", "tion"], "es": ["ción", "ado", "ñ", "os", "lla"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, r.choice([3, 10, 60])), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df.where("doc_id < 160"))
    out = lang_id.identified(df.where("doc_id >= 160"), model).join(df, "doc_id").collect()
    assert np.mean([x.lang == x.lang_pred for x in out]) > 0.95 and all(0 <= x.score <= 1 for x in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "ein " * 40000), (4, "ein " * 40000)], "doc_id long, text string")
    got = sorted((x.doc_id, x.lang_pred) for x in lang_id.identified(odd, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert [x.lang_pred for x in lang_id.identified(odd, lang_id.train(df.where("doc_id < 0"))).collect()] == ["und"] * 5
    one = lang_id.train(df.where("lang = 'fr'"))
    assert {x.lang_pred for x in lang_id.identified(df, one).collect()} == {"fr"}


def test_every_language_is_learned(spark):
    langs = [f"{code}-{k:02}" for code in "en fr ru fi tr hi ar id".split() for k in range(13)]
    df = spark.createDataFrame([(f"{x} word of {x}", x) for x in langs], "text string, lang string")
    assert sorted(c for vote in lang_id.train(df).within for c in vote.classes) == sorted(langs)


def test_copies_count_once_in_the_sample(spark):
    rows = [(f"{x} {w} text", x) for x in "de en es fr it nl pl pt".split() for w in ("first", "second") for _ in range(200)]
    seen = []

    def kept(x, langs):
        seen.extend(langs.tolist())

    real, lang_id.Identifier = lang_id.Identifier, kept
    try:
        lang_id.train(spark.createDataFrame(rows, "text string, lang string"), per_lang=10)
    finally:
        lang_id.Identifier = real
    # two distinct texts a language, each whole and in pieces
    assert {x: seen.count(x) for x in set(seen)} == {x: 2 * (1 + lang_id.PIECES) for x in {x for _, x in rows}}


def test_quality_of_held_out_texts(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        t = text(r, "en", r.randint(5, 80)) + "."
        good = i % 2
        rows.append((i, t if good else r.choice([t.upper(), "spam " * 40, t.replace(" ", "%%% ")]), good))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality").where("doc_id < 300"))
    out = quality.scored(df.where("doc_id >= 300").select("doc_id", "text"), model).join(df, "doc_id").collect()
    assert np.mean([x.quality == x.predicted for x in out]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 100000)], "doc_id long, text string")
    assert all(0 <= x.score <= 1 for x in quality.scored(odd, model).collect())
    none = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality").where("doc_id < 0"))
    assert {x.score for x in quality.scored(odd, none).collect()} == {0.5}


def test_quality_keeps_the_shares_of_a_thinned_class(spark):
    # the text doesn't tell the class, so the score is class 1's share of all labels
    df = spark.range(4000).selectExpr("id AS doc_id", "'same text for all' AS text", "CAST(id % 10 > 0 AS INT) AS quality")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), most=400)
    assert abs(quality.scored(df.limit(1), model).first().score - 0.9) < 0.03


def test_pairs_matter():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    assert ((quality.Gam(x, y).score(x) > 0.5) == y).mean() > 0.9


def test_marginals_by_enumeration():
    r = np.random.default_rng(5)
    e, first, start, move = r.normal(size=9), np.array([0, 4]), r.normal(size=2), r.normal(size=(2, 2))
    p = crf.marginals(e, first, start, move)[0]
    for a, z in ((0, 4), (4, 9)):
        total, on = 0.0, np.zeros(z - a)
        for y in itertools.product((0, 1), repeat=z - a):
            w = np.exp(start[y[0]] + sum(e[a + k] * s for k, s in enumerate(y)) + sum(move[i, j] for i, j in zip(y, y[1:], strict=False)))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[a:z], on / total)


def test_marginals_are_the_plain_ones_and_the_same_in_any_company():
    r = np.random.default_rng(6)
    size = [1, 64, 5000, 63, 129, 2, 700]
    e, start, move = r.normal(size=sum(size)) * 3, r.normal(size=2), r.normal(size=(2, 2))
    first = np.cumsum(size) - size
    p = crf.marginals(e, first, start, move)[0]
    m = crf.potentials(e, first, start, move)
    for a, n in zip(first.tolist(), size, strict=True):
        assert (crf.marginals(e[a : a + n], np.array([0]), start, move)[0] == p[a : a + n]).all()
        forward, backward = np.empty((n, 2)), np.empty((n, 2))
        v, w = np.array([0.5, 0.5]), np.array([0.5, 0.5])
        for k in range(n):
            v = v @ m[a + k]
            forward[k] = v = v / v.sum()
            backward[n - 1 - k] = w
            w = m[a + n - 1 - k] @ w
            w /= w.sum()
        both = forward * backward
        assert np.allclose(p[a : a + n], both[:, 1] / both.sum(axis=1))


def toxic_table(spark):
    r = random.Random(3)
    rows = []
    for i in range(500):
        t = text(r, "en", r.randint(5, 60)).split()
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(["badword", "vile" + r.choice("abcdef"), "awful"]))
        rows.append((i, " ".join(t), int(bad), "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, toxicity string")


def test_toxic_held_out_texts_and_spans(spark):
    df = toxic_table(spark)
    model = toxicity.train(df, df.select("doc_id", "toxic").where("doc_id < 400"))
    out, name = toxicity.tagged(df.where("doc_id >= 400"), model, text="keep")
    rows = out.collect()
    assert name == "toxicity_" and np.mean([x.toxic == x[name].predicted for x in rows]) > 0.95
    words = [x.text.encode()[s.start : s.stop].decode() for x in rows if x.toxic for s in x[name].spans]
    assert np.mean([all(w.startswith(("bad", "vile", "awful")) for w in run.split()) for run in words]) > 0.9
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "thing " * 30000 + "badword awful badword")], "doc_id long, text string")
    out, name = toxicity.tagged(odd, model)
    got = {x.doc_id: x[name] for x in out.collect()}
    assert got[1].score == got[2].score < 0.5 and got[1].spans == [] and got[3].spans
    assert toxicity.tagged(odd.where("doc_id > 9"), model)[0].count() == 0


def test_equal_texts_have_equal_toxicity_in_any_slice(spark):
    df = toxic_table(spark)
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    rows = [(i, f"{'x ' * (i % 7)}thing", 0, "") for i in range(300)] + [(1000 + i, "a vile badword and 64 more " * 9, 0, "") for i in range(40)]
    random.Random(4).shuffle(rows)
    out, name = toxicity.tagged(spark.createDataFrame(rows, df.schema).repartition(5), model)
    assert len({x[name].score for x in out.where("doc_id >= 1000").collect()}) == 1
    # a very long text in little memory, and nothing to learn from in an empty table
    long = pa.array(["thing badword other " * 200000])
    p = model.tag(*toxicity.words_of(long))
    assert len(p) == 600000 and p[1] > 0.5 > p[0]
    empty = df.where("doc_id < 0")
    assert toxicity.tagged(empty, toxicity.train(empty, empty.select("doc_id", "toxic")))[0].count() == 0


def test_toxic_without_labels(spark):
    df = toxic_table(spark)
    for labels in (df.where("doc_id < 0"), df.where("toxic = 0")):
        model = toxicity.train(df, labels.select("doc_id", "toxic"))
        out, name = toxicity.tagged(df.limit(5), model)
        assert {r.predicted for r in out.select(F.col(name)["predicted"].alias("predicted")).collect()} == {0}


def test_features_of_odd_texts():
    x = quality.features(pa.array([None, "", "A b!", "\n\n", "É x"], pa.string()))
    assert x.shape == (5, len(quality.FEATURES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert x[4, 3] > 0


def test_toxic_scores_as_brute_force(spark):
    """The query's operator against a forward-backward of Python numbers, text by text."""
    df = toxic_table(spark)
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    weight = dict(zip(model.lookup.keys.tolist(), model.weights.tolist(), strict=False))
    start, move = np.exp(model.start).tolist(), np.exp(model.move).tolist()
    for row in toxicity.tagged(df, model, text="keep")[0].collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", row.text.lower())
        e = [math.exp(model.weights[-1] + sum(weight.get(int(h), 0.0) for h in toxicity.token_features(pa.array([w]))[1][0])) for w in words]
        alpha, beta = [], [(0.5, 0.5)]
        for k, x in enumerate(e):
            a = (start[0], start[1] * x) if not k else (alpha[-1][0] * move[0][0] + alpha[-1][1] * move[1][0], (alpha[-1][0] * move[0][1] + alpha[-1][1] * move[1][1]) * x)
            alpha.append((a[0] / sum(a), a[1] / sum(a)))
        for x in e[:0:-1]:
            b = (move[0][0] * beta[0][0] + move[0][1] * x * beta[0][1], move[1][0] * beta[0][0] + move[1][1] * x * beta[0][1])
            beta.insert(0, (b[0] / sum(b), b[1] / sum(b)))
        p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, beta, strict=True)]
        z = model.link @ [math.log1p(sum(p)), max(p), math.log1p(len(p)), 1.0]
        got = row["toxicity_"]
        assert abs(got.score - 1 / (1 + math.exp(-z))) < 1e-9 and got.predicted == (got.score >= 0.5)
        at, spans = 0, []
        for w, x in zip(words, p, strict=True):
            at = row.text.lower().index(w, at)
            if x >= 0.5:
                if spans and spans[-1][2] == last:
                    spans[-1][1] = at + len(w)
                else:
                    spans.append([at, at + len(w), None])
                spans[-1][2] = at
            last, at = at, at + len(w)
        if row.text.isascii():
            assert [(s.start, s.stop) for s in got.spans] == [(a, z) for a, z, _ in spans]


def test_languages_as_brute_force(spark):
    """Predictions against grams counted one by one and duels decided one after the other."""
    r = random.Random(7)
    df = spark.createDataFrame([(i, text(r, x, r.choice([4, 12])), x) for i, x in enumerate(list(SYLLABLES) * 30)], "doc_id long, text string, lang string")
    model = lang_id.train(df)

    def vector(t):
        b = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or 97 <= c < 123 else 32 for c in t.encode())
        v = np.zeros(lang_id.DIM)
        for n in (2, 3, 4):
            for k in range(len(b) - n + 1):
                h = 0
                for c in b[k : k + n]:
                    h = h * 257 + c & 0xFFFFFFFF
                v[(h * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF) & 0xFFFFFFFF) >> 20] += 1
        return v / max(np.sqrt((v * v).sum()), 1e-9)

    def decide(vote, v):
        wins, sums = [0] * len(vote.classes), [0.0] * len(vote.classes)
        for k, (i, j) in enumerate(vote.pairs):
            m = float(v @ vote.w[:-1, k] + vote.w[-1, k])
            wins[i if m > 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        return vote.classes[max(range(len(wins)), key=lambda c: (wins[c], sums[c]))]

    for row in lang_id.identified(df, model).join(df, "doc_id").collect():
        v = vector(row.text)
        family = decide(model.families, v)
        assert row.lang_pred == decide(model.within[model.families.classes.index(family)], v)


def test_quality_scores_as_brute_force(spark):
    """Scores against tables looked up one by one; equal rows, no rows and columns with the result's names."""
    r = random.Random(5)
    rows = [(i, text(r, "en", r.randint(2, 60)) if i % 2 else "spam " * r.randint(3, 40), i % 2, "clash", 0.5) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, quality int, predicted string, score double")
    model = quality.train(df, df.select("doc_id", "quality"))
    got = quality.scored(df, model).join(df.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == 205 and len({(x.doc_id, x.score) for x in got}) == 200
    for x in got:
        f = quality.features(pa.array([x.text]))[0]
        place = lambda edges, v: sum(e <= v for e in edges)
        z = model.start + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, f, strict=True)) + sum(t[place(model.coarse[i], f[i])][place(model.coarse[j], f[j])] for i, j, t in model.pairs)
        assert abs(x.score - 1 / (1 + math.exp(-z))) < 1e-9 and x.predicted == (x.score >= 0.5)
    assert quality.scored(df.where("doc_id < 0"), model).count() == 0


def test_samples_are_bounded_and_never_empty(spark):
    rows = spark.range(20000).selectExpr("CAST(id % 3 AS INT) AS label", "id", "id % 7 AS few")
    got = {x.label: x["count"] for x in per_class(rows, "label", 50, F.col("id")).groupBy("label").count().collect()}
    assert set(got) == {0, 1, 2} and all(25 < n <= 50 for n in got.values())
    assert all(x["count"] <= 50 for x in per_class(rows, "label", 50, F.col("few")).groupBy("label").count().collect())


def test_kept_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(k, "ein text und mehr", "de", 1) for k in range(3)] + [(9, "some text", "en", 0)], "doc_id long, text string, lang string, quality int")
    keep = {"doc_id": F.col("doc_id"), **{c: F.lit("kept") for c in ("text", "letters", "Text", "score", "lang_pred", "predicted")}}
    keep.pop("Text")
    out = lang_id.identified(df, lang_id.train(df), keep=keep)
    assert out.columns == ["doc_id", "text", "letters", "predicted", "lang_pred", "score"] and {r.text for r in out.collect()} == {"kept"}
    assert {r.lang_pred for r in out.where("doc_id < 9").collect()} == {"de"} and lang_id.identified(df.where("doc_id > 99"), None).count() == 0
    out = quality.scored(df, quality.train(df, df.select("doc_id", "quality")), keep=keep)
    assert out.columns == ["doc_id", "text", "letters", "lang_pred", "score", "predicted"] and all(0 <= r.score <= 1 for r in out.collect())


def test_copies_of_a_toxic_text_make_none_of_its_words_toxic(spark):
    r = random.Random(11)
    df = toxic_table(spark)
    base = text(r, "de", 60).split()
    copies = []
    for k in range(40):
        w = list(base)
        w[r.randrange(60)] = "edit%d" % k
        copies.append((2000 + k, " ".join([*w, "badword"]), 1, ""))
    clean = [(3000, " ".join(base), 0, ""), (3001, " ".join(base[10:40]), 0, "")]
    both = df.unionByName(spark.createDataFrame(copies, df.schema))
    model = toxicity.train(both, both.select("doc_id", "toxic"))
    out, name = toxicity.tagged(spark.createDataFrame(copies + clean, df.schema), model)
    assert {x.doc_id: x[name].predicted for x in out.collect()} == {**{2000 + k: 1 for k in range(40)}, 3000: 0, 3001: 0}
    w = toxicity.weights_of(toxicity.least_hashes(pa.array([x[1] for x in copies] + ["all on its own here", "", None])))
    assert (w[:40] < 60000).all() and w[40] == 10**6


@pytest.mark.parametrize("clean", [(1,), (1, 5), (1, 3, 5)])
def test_toxic_words_are_learned_whatever_the_share_of_toxic_labels(spark, clean):
    """With as many labelled toxic texts as others, or twice as many, no feature could be frequent enough."""
    df = toxic_table(spark)
    labels = df.where("doc_id < 400").where((F.col("toxic") == 1) | (F.col("doc_id") % 8).isin(*clean)).select("doc_id", "toxic")
    model = toxicity.train(df, labels)
    out, name = toxicity.tagged(df.where("doc_id >= 400"), model, text="keep")
    rows = out.collect()
    assert len(model.lookup.keys)
    for y in (0, 1):
        assert np.mean([x[name].predicted == y for x in rows if x.toxic == y]) > 0.95
