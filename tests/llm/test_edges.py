"""All ten queries and the pipeline's stages over odd rows (nulls in any column, empty and very long texts, repeats, extra columns) and over empty tables."""

import pytest

import corpus_pipeline as cp
from kvlake.llm import registry

EXTRA = "id string, Text_hash string, at string, rank string, cut string, s string, node string, key string, comp string, score string, predicted string, held_out string, tie string, count string, removed_lines string, hits string"
SCHEMAS = {
    "documents": f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}",
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, hits string",
    "pages": "page_id long, url string, html string, text string",
}
TEN = [n for n in registry.QUERIES if n.startswith("op")]
#: Columns that hold for every text without words, by query.
BLANK = {
    "op1_language_id": {"lang_pred": "und"},
    "op2_mix_sources": {"size": 0, "taken": 0},
    "op5_decontaminate": {"n_words": 0, "n_hit": 0, "contaminated": False},
    "op6_line_dedup": {"n_removed": 0, "removed_lines": ""},
    "op7_lm_scoring": {"n_tokens": 1, "n_known": 1},
    "op9_near_dedup": {"n_shingles": 0, "kept": True},
}


def odd_rows():
    line = " ".join(f"word{k}" for k in range(14))
    toxic = "you are a vile fool and " + line
    texts = [None, "", " \t\n ", "\n" * 5000, "x" * 400_000, f"{line}\n" * 3000, "é" * 10 + " ünïcode \U0001f600 ok", line, line, line + " more", toxic, toxic, "no letters 123", "123 456", "A"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(7, line), (7, "another text of the same id"), (None, line), (None, None), (None, "alone")]  # equal rows, an id's two texts, no id
    rows += [(100 + k, f"{line} tail{k} " + "bad " * (k % 2)) for k in range(30)]
    return [(i, t, None if k % 5 == 0 else "de" if k % 2 else "en", None if k % 4 == 0 else "hot", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Two folders of tables: one with odd rows, one with none."""
    docs = odd_rows()
    names = EXTRA.count(" string")
    tables = {
        "documents": [r + (None if k % 2 else "own",) * names for k, r in enumerate(docs)],
        "labels": [(i, None if k % 7 == 0 else k % 2, None if k % 6 == 0 else k % 2, None) for k, (i, *_) in enumerate(docs)] + [(None, None, None, None), (999, 1, 1, "none such")],
        "benchmark": [(1, None, None), (2, "", ""), (3, "word3 word4", None), (4, "another TEXT of", None), (4, "another TEXT of", None), (None, "alone", None), (5, "x" * 400_000, None)],
        "pages": [(1, None, None, None), (2, "u", "", ""), (None, None, "<p>" + "long text " * 40_000, None), (3, "u", "<html><body><p>One &amp; two</p></body></html>", "own"), (3, "u", "</p><<a <", None)],
    }
    odd, none = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    for name, rows in tables.items():
        df = spark.createDataFrame(rows, SCHEMAS[name]).coalesce(2)
        df.write.parquet(f"{odd}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return odd, none


@pytest.mark.parametrize("name", TEN)
def test_every_row_comes_back_once(spark, folders, name):
    odd, none = folders
    of, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    expected = spark.read.parquet(f"{odd}/{of}.parquet").select(key, "html" if of == "pages" else "text").collect()
    out = registry.QUERIES[name](spark, odd)
    got = out.collect()
    text_ids = lambda rows: sorted(str(r[0]) for r in rows)
    assert text_ids([(r[key],) for r in got]) == text_ids(expected)
    alone = {i for i, t in map(tuple, expected) if i in (0, 1, 2, 3)}
    for r in got:
        if "score" in out.columns and name != "op7_lm_scoring":
            assert 0 <= r.score <= 1
        if of == "documents" and r[key] in alone:
            want = BLANK.get(name, {})
            assert {c: r[c] for c in want} == want, r[key]
    empty = registry.QUERIES[name](spark, none)
    assert empty.columns == out.columns and empty.collect() == []


def test_stages_over_odd_rows_and_none(spark, folders, tmp_path):
    for k, folder in enumerate(folders):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for name, stage in cp.STAGES:
            stage(spark, docs, folder).write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name != "mixing":
                assert docs.columns == columns, name
        assert (docs.count() > 0) == (k == 0)
