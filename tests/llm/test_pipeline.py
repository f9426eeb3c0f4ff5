import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kvlake.llm import decontaminate, near_dedup, toxicity
from kvlake.llm.common import fold

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_no_unique_text_goes_with_a_repeated_or_missing_id(spark):
    a, b, z = (" ".join(f"{x}{k}" for k in range(30)) for x in "abz")
    rows = [(3, a), (5, a), (5, b), (9, b), (9, b + " more"), (11, z), (None, z), (None, "only here"), (None, "only here"), (7, ""), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_id string")
    out = cp.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    for _, t in rows:
        if t:
            assert sum(bool(u) and jaccard(t, u) >= 0.8 for _, u in left) == 1, t
    assert (3, a) in left and (11, z) in left
    # all stages over such rows, and over none at all
    for some in (docs, docs.where("doc_id > 99")):
        for name, stage in cp.STAGES[1:3] + cp.STAGES[4:]:
            stage(spark, some, "").collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == columns, name
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(fold(5) != 0))
            tagged, c = toxicity.tagged(docs, model)
            assert set(after) == {r.doc_id for r in tagged.collect() if r[c].predicted == 0}
        elif name == "near_dedup":
            assert set(after) == {r.id for r in near_dedup.classes(docs).where("kept").collect()}
            assert all(after[i].text == before[i].text for i in after)
        elif name == "line_dedup":
            assert all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != before[i].text)
        elif name == "decontamination":
            found, c = decontaminate.searched(out, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert set(after) == set(before) and all(r[c].n_hit == 0 for r in found.collect())
        else:
            assert set(after) == set(before)
            for s in {r.source for r in after.values()}:
                own = [r for r in after.values() if r.source == s]
                assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
        docs = out


@pytest.mark.parametrize("every", [2, 3])
def test_toxic_documents_go_where_labels_are_toxic_as_often_as_not(spark, tmp_path, every):
    """Half of the labels or two thirds of them are toxic, as in a sample of a large table, whose classes are cut to one size."""
    r = random.Random(7)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(7)) for _ in range(300)]
    rows = []
    for i in range(600):
        t = r.choices(words, k=r.randint(5, 60))
        toxic = i % every != 0
        for _ in range(3 * toxic):
            t.insert(r.randrange(len(t)), r.choice(["badword", "vilest", "awful"]))
        rows.append((i, " ".join(t), int(toxic)))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("n_chars", F.length("text").cast("long"))
    both.where("doc_id < 400").select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    left = {x.doc_id for x in cp.drop_toxic(spark, both.drop("toxic"), str(tmp_path)).collect()}
    for toxic in (0, 1):
        own = [i in left for i, _, y in rows if y == toxic]
        assert sum(k != toxic for k in own) > 0.95 * len(own)
