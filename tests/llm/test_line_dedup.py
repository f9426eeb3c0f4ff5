import random

from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import line_dedup

SCHEMA = "doc_id long, text string, removed_lines string, id int"


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def brute(docs, min_words):
    lines = [((i is not None, i or 0, no), line.strip(" ").lower().split(" ")) for i, t in docs if t is not None for no, line in enumerate(t.split("\n"))]
    lines = sorted([x for x in lines if len(x[1]) >= min_words])
    first = {}
    for at, w in lines:
        first.setdefault(tuple(w), at)
    gone = {}
    for at, w in lines:
        if first[tuple(w)] != at or any(o < first[tuple(w)] and edit(w, list(v)) <= 1 for v, o in first.items()):
            gone.setdefault(at[1] if at[0] else None, set()).add(at[2])
    return gone


def test_same_as_brute_force(spark):
    r = random.Random(4)
    base = [[r.choice("abcdef") * r.randint(1, 3) for _ in range(r.randint(4, 9))] for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                r.choice([lambda: w.insert(k, "new"), lambda: w.__setitem__(k, "odd"), lambda: w.pop(k) if len(w) > 1 else None])()
            lines.append(r.choice(["", " "]) + " ".join(w) + r.choice(["", "  "]))
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[3][1])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA)
    out, name = line_dedup.deduplicated(df, min_words=5)
    assert name == "removed_lines_" and out.columns == [*df.columns, name]
    got = {r.doc_id: r for r in out.collect()}
    want = brute(docs, 5)
    for i, t in docs:
        assert set(got[i][name]) == want.get(i, set()), (i, t)
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))
        assert got[i].text == kept and got[i].removed_lines == "clash"


def test_long_lines_ties_and_empty(spark):
    long = " ".join("w%d" % (k % 50) for k in range(5000))
    rows = [(1, long), (2, long + " x"), (3, long.replace("w7 ", "y ", 1)), (4, long), (4, long)]
    df = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    out, name = line_dedup.deduplicated(df)
    assert sorted((r.doc_id, list(r[name])) for r in out.collect()) == [(1, []), (2, [0]), (3, [0]), (4, [0]), (4, [0])]
    out, name = line_dedup.deduplicated(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0


def test_pipeline_removes_short_repeats(spark):
    long = "one two three four five six seven eight nine ten"
    texts = ["Read on\n\n \t\nRead on ", f"read on\na\tb\n{long}", f"Read now\nA\tB\n{long} x\n東京は日本の首都です。", "\n東京は日本の首都です。\n\n", "東京は日本の首都です。", None, "\n \t\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    left = {0: "Read on\n\n \t", 1: f"a\tb\n{long}", 2: "Read now\n東京は日本の首都です。", 5: None, 6: "\n \t\n"}
    assert got == {k: (t, t and len(t)) for k, t in left.items()}
    r = random.Random(9)
    lines = [" ".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(60)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(6))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out, name = line_dedup.deduplicated(df, min_words=5, short=True)
    want, seen = brute(docs, 5), set()
    for i, t in docs:
        for no, line in enumerate(t.split("\n")):
            if line in seen:
                want.setdefault(i, set()).add(no)
            seen.add(line)
    assert {x.doc_id: set(x[name]) for x in out.collect() if x[name]} == want


def test_repeated_ids_lose_no_text(spark):
    a = "one two three four five six seven eight nine ten"
    own = "this text repeats nothing at all and so it has to stay whole"
    rows = [(1, a), (5, a), (5, a), (5, own), (5, own + "\n" + a + " eleven"), (None, own + " too"), (None, "short")]
    df = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA)
    out, name = line_dedup.deduplicated(df)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got[:2] == [(1, a), (5, "")] and (5, "") in got[2:]
    # the null id comes first, so that its near-equal line is the one that stays
    assert (None, own + " too") in got and (None, "short") in got
    left = {line for _, t in got for line in t.split("\n") if line}
    for _, t in rows:
        for line in t.split("\n"):
            assert any(edit(line.split(), x.split()) <= 1 for x in left), line
    # two documents of one id, each with a text of its own
    two = [(5, "alpha " + a), (5, "beta gamma delta " + a)]
    out, name = line_dedup.deduplicated(spark.createDataFrame([(i, t, "", 1) for i, t in two], SCHEMA))
    assert sorted(r.text for r in out.collect()) == sorted(t for _, t in two)
