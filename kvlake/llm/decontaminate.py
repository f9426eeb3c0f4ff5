"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents of a few megabytes. Its words become symbols of the benchmark's vocabulary; a
word outside it can't take part in any occurrence and ends a run, and runs shorter than the shortest window are
left out. Backward search finds all windows at once, sampled suffix positions locate their occurrences, and
overlapping occurrences merge into removal spans.

Benchmark windows reach the workers as broadcasts of at most ``block_bytes`` of item text each. A benchmark above
that bound is searched block by block and the spans are merged by document.

Defined results: null and empty texts have no words and no hits; items without words or without an item_id are
not searched for; items that repeat count once; extra columns of either table pass through or are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import textnum
from kvlake.llm.common import arrow_map, fresh, table, written
from kvlake.llm.fm_index import FMIndex

WINDOW, SHARD_BYTES, BLOCK_BYTES = 10, 6 << 20, 8 << 20
SEARCHED = 1 << 18  # windows searched for at once


class Windows:
    """The distinct windows of a block of items, by length, as places in the items' words (symbols of the block's vocabulary).

    Windows are told apart by 128-bit hashes and never copied out, so a block takes some twenty times its bytes while it is built.
    """

    def __init__(self, ids: list[str], texts: list[str], window: int):
        _, _, _, first, h = textnum.words(pa.array(texts, pa.string()), textnum.WORD)
        self.ids = np.array(ids, object)
        self.vocabulary, symbols = np.unique(h, return_inverse=True)
        self.symbols = (symbols + 1).astype(np.int32)
        count = np.diff(first)
        width = np.minimum(count, window)
        n = np.where(count > 0, count - width + 1, 0)
        start = (np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))).astype(np.int32)
        item, width = np.repeat(np.arange(len(ids), dtype=np.int32), n), np.repeat(width.astype(np.int32), n)
        # length, a place of each distinct window; and for each (window, item) pair the window's number and the item's
        self.groups = []
        for size in np.unique(width).tolist():
            own = np.flatnonzero(width == size)
            one = two = np.zeros(len(own), np.uint64)
            for k in range(size):
                word = self.symbols[start[own] + k].astype(np.uint64)
                one, two = textnum.pair(one, word), textnum.mix(two * np.uint64(0x9E3779B97F4A7C15) + word)
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            number = np.cumsum(new) - 1
            pairs = np.unique(number * len(ids) + item[own[order]])
            self.groups.append((size, start[own[order[new]]], pairs // len(ids), (pairs % len(ids)).astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0


def shard_hits(texts: pa.Array, windows: Windows, step: int = 8):
    """Bytes, word starts, word ends, first word of each row; covered words (bool); pairs (row, item) that meet."""
    buf, starts, ends, first, h = textnum.words(texts, textnum.WORD)
    covered = np.zeros(len(h), bool)
    nothing = np.zeros(0, np.int64)
    met = [(nothing, nothing)]
    if len(h) and windows.groups:
        place = np.searchsorted(windows.vocabulary, h)
        place[place == len(windows.vocabulary)] = 0
        known = windows.vocabulary[place] == h
        head = known & ~np.concatenate([[False], known[:-1]])
        rows = first[:-1][first[:-1] < len(h)]
        head[rows] = known[rows]
        tail = known & ~np.concatenate([known[1:], [False]])
        tail[first[1:][first[1:] > 0] - 1] = known[first[1:][first[1:] > 0] - 1]
        a, b = np.flatnonzero(head), np.flatnonzero(tail) + 1
        long = b - a >= windows.shortest
        a, b = a[long], b[long]
        if len(a):
            size = b - a + 1
            to = np.cumsum(size) - size
            words = np.repeat(a - to, size) + np.arange(int(size.sum()))  # the word of each text position; a run's separator has the word after it
            t = np.zeros(len(words), np.int64)
            inside = np.ones(len(words), bool)
            inside[to + size - 1] = False
            t[inside] = place[words[inside]] + 1
            index = FMIndex(t, len(windows.vocabulary), step)
            for width, w, which, item in windows.groups:
                for part in range(0, len(w), SEARCHED):
                    lo, hi = index.search(windows.symbols, w[part : part + SEARCHED], width)
                    count = hi - lo
                    found = np.flatnonzero(count)
                    if not len(found):
                        continue
                    n = count[found]
                    at = words[index.locate(np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))]
                    edge = np.zeros(len(h) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    covered |= np.cumsum(edge[:-1]) > 0
                    # (row, window) pairs, then their items
                    row = np.searchsorted(first, at, "right") - 1
                    pairs = np.unique(row * len(w) + np.repeat(part + found, n))
                    row, win = pairs // len(w), pairs % len(w)
                    left, right = np.searchsorted(which, win), np.searchsorted(which, win, "right")
                    many = right - left
                    met.append((np.repeat(row, many), item[np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]))
    return buf, starts, ends, first, covered, np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])


def removal_spans(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, covered: np.ndarray):
    """Byte spans of maximal runs of covered words, and each row's first span (with the total at the end)."""
    if not len(covered):
        return starts, ends, np.zeros(len(first), np.int64)
    head = covered & ~np.concatenate([[False], covered[:-1]])
    rows = first[:-1][first[:-1] < len(covered)]
    head[rows] = covered[rows]
    tail = covered & ~np.concatenate([covered[1:], [False]])
    last = first[1:][first[1:] > 0] - 1
    tail[last] = covered[last]
    heads = np.flatnonzero(head)
    return starts[heads], ends[np.flatnonzero(tail)], np.searchsorted(heads, first)


def _ids(rows: np.ndarray, items: np.ndarray, n: int, names: np.ndarray) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for key in np.unique(np.stack([rows, items]), axis=1).T if len(rows) else ():
        out[key[0]].append(names[key[1]])
    return [sorted(set(x)) for x in out]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """The number of blocks, and each block's items: about ``block_bytes`` of text. The driver holds one block at a time."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    n = -(-(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield n, [(r.item, r.text) for r in part.collect()]


def _within(spans: pa.Array, base: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words lie inside the rows' byte spans."""
    inside = np.zeros(len(starts) + 1, np.int64)
    flat, size = spans.flatten(), np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1])
    own = np.repeat(base, size)
    np.add.at(inside, np.searchsorted(starts, flat.field(0).to_numpy() + own), 1)
    np.add.at(inside, np.searchsorted(starts, flat.field(1).to_numpy() + own), -1)
    return np.cumsum(inside[:-1]) > 0


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    raw, at, out = text.encode(), 0, []
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


def _without_spans(docs: DataFrame, text_col: str, hits: str) -> DataFrame:
    """``docs`` with the spans of column ``hits`` cut out of the texts."""
    at, of = docs.columns.index(text_col), docs.columns.index(hits)
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(s["start"], s["stop"]) for s in x] for x in batch.column(of).field(3).to_pylist()]
        texts = [_cut(t, x) if x else t for t, x in zip(batch.column(at).to_pylist(), spans, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names)

    return arrow_map(docs, cut, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes), at)


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, text: str = "keep") -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and that column's name (``hits``, lengthened where docs has such a column).

    hits: n_words, n_hit, items (sorted strings of the items that occur), spans (start and stop bytes, in UTF-8, of the
    passages to remove). text: ``keep``, ``drop`` (leave the column out) or ``clean`` (cut the spans out, again until
    nothing is found; then hits tells of the text as it was). All blocks search a text before it is cut.
    """
    name = fresh(docs, "hits")
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,stop:int>>>"
    at = docs.columns.index(text_col)
    sc = docs.sparkSession.sparkContext
    none = F.from_json(F.lit('{"n_words":0,"n_hit":0,"items":[],"spans":[]}'), kind)
    out = docs.withColumn(name, none)
    for k, (n, block) in enumerate(blocks(benchmark, item_col, item_text, block_bytes)):
        shared = sc.broadcast(block)
        last = k == n - 1
        alone = n == 1 and text == "clean"
        kept = [c for c in out.columns if c != text_col or not (last and text == "drop")]

        def shard(batch: pa.RecordBatch, shared=shared, kept=kept, alone=alone, made=[]) -> pa.RecordBatch:  # noqa: B006
            if not made:
                made.append(Windows([x[0] for x in shared.value], [x[1] for x in shared.value], window))
            array, had = batch.column(at), batch.column(batch.num_columns - 1)
            _, starts, ends, first, covered, row, item = shard_hits(array, made[0])
            base = textnum.raw_bytes(array)[1][:-1]
            covered |= _within(had.field(3), base, starts)
            s, e, spans_first = removal_spans(starts, ends, first, covered)
            own = np.repeat(base, np.diff(spans_first))
            s, e = s - own, e - own
            items = [sorted({*a, *b}) for a, b in zip(had.field(2).to_pylist(), _ids(row, item, batch.num_rows, made[0].ids), strict=True)]
            n_hit = textnum.row_sums(covered.astype(np.int64), first)
            spans = pa.ListArray.from_arrays(pa.array(spans_first, pa.int32()), pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["start", "stop"]))
            n_words = np.maximum(np.diff(first), had.field(0).to_numpy())
            hits = pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), spans], ["n_words", "n_hit", "items", "spans"])
            cols = [hits if c == name else batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept]
            if alone and len(s):
                texts = array.to_pylist()
                todo = {r: list(zip(s[spans_first[r] : spans_first[r + 1]].tolist(), e[spans_first[r] : spans_first[r + 1]].tolist(), strict=True)) for r in np.flatnonzero(np.diff(spans_first))}
                while todo:
                    for r, own_spans in todo.items():
                        texts[r] = _cut(texts[r], own_spans)
                    rows = sorted(todo)
                    again = pa.array([texts[r] for r in rows], pa.string())
                    _, starts, ends, first, covered, _, _ = shard_hits(again, made[0])
                    base = textnum.raw_bytes(again)[1]
                    s, e, f = removal_spans(starts, ends, first, covered)
                    todo = {r: [(int(x - base[j]), int(y - base[j])) for x, y in zip(s[f[j] : f[j + 1]], e[f[j] : f[j + 1]], strict=True)] for j, r in enumerate(rows) if f[j] < f[j + 1]}
                cols[at] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays(cols, kept)

        schema = ", ".join(f"`{c}` {kind if c == name else t}" for c, t in [*docs.dtypes, (name, kind)] if c in kept)
        out = arrow_map(out, shard, schema, at, shard_bytes)
        if not last:
            out = written(out, "search-block")
    if text != "clean" or n == 1:
        return out, name
    # the merged spans of all blocks are cut at once; texts that were cut are searched by all blocks again
    out = written(_without_spans(out, text_col, name), "search-cut")
    done, left = out.where(F.col(name)["n_hit"] == 0), out.where(F.col(name)["n_hit"] > 0)
    while not left.isEmpty():
        found, again = searched(left, benchmark, text_col, item_col, item_text, window, block_bytes, shard_bytes)
        found = written(_without_spans(found, text_col, again), "search-cut")
        done = done.unionByName(found.where(F.col(again)["n_hit"] == 0).drop(again))
        left = found.where(F.col(again)["n_hit"] > 0).drop(again)
    return done, name


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, hits = searched(docs, table(spark, sf_dir, "benchmark"), text="drop")
    h = F.col(hits)
    return out.select("doc_id", h.n_words.alias("n_words"), h.n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), (h.n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) u(i) WHERE len(ws) > 0),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(ws) - n + 2)) u(i)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT w) AS n_hit FROM m, unnest(range(i, i + n)) u(w) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
