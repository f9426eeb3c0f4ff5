"""Interpolated modified Kneser-Ney language model (bigrams), counted in Spark and scored from memory-mapped arrays.

Counting. Each slice of text yields its distinct bigrams with counts, packed by context into a few binary columns
and dealt to buckets by the context's hash; contexts that are frequent in a sample are dealt by both words, so no
bucket depends on one word's frequency (the sample decides the place of a count, never its value). A bucket merges
its slices, writes sorted hash arrays to the shared folder, and passes on what it knows of each word: its count
and in how many contexts it occurs. Those are merged by word in the same way. The driver gets a few numbers a bucket.

Model. With c the count of a bigram (v, w) and n1..n4 the numbers of bigrams counted once to four times,
D1, D2, D3+ are the modified Kneser-Ney discounts, and p(w | v) = (c - D(c)) / c(v) + g(v) p(w), where p(w) is
the discounted share of contexts in which w occurs, interpolated with 1 / (V + 1) for a word never seen. A context
never seen leaves p(w). The first word's context is the text's start; the end is a word.

Defined results: null and empty texts are an end alone; a training set without texts gives every word 1; rows that
repeat count each time; extra columns are not looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import store, textnum
from kvlake.llm.common import arrow_map, fold, fresh, scratch_dir, table, unused, written

START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
SLICE_BYTES, BUCKET_TOKENS, HOT_PARTS = 16 << 20, 1 << 21, 64  # a slice is a whole Arrow batch at most
PLACES = 1 << 14  # partitions that buckets are dealt to at most, unless the session has more
READ_BYTES = 256 << 20  # arrays that a worker holds where they can't be mapped
SAMPLE, OFTEN = 64, 2000  # a context with more than 1 / OFTEN of the tokens of 1 / SAMPLE of the texts is dealt by both words
_SPREAD = np.uint64(0xD1B54A32D192ED03)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words (each text's end included) and each text's first token (with the total at the end)."""
    _, _, _, first, h = textnum.words(texts, textnum.NON_SPACE)
    n = len(first) - 1
    first = first + np.arange(n + 1)
    word = np.empty(first[-1], np.uint64)
    ends = np.zeros(len(word), bool)
    ends[first[1:] - 1] = True
    word[~ends], word[ends] = h, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = START
    return context, word, first


def bucket_of(context: np.ndarray, word: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """The bucket (of ``n``, up to 2^31) of each bigram."""
    h = textnum.mix(context ^ _SPREAD)
    if len(often):
        hot = often[np.minimum(np.searchsorted(often, context), len(often) - 1)] == context
        h[hot] = textnum.pair(context[hot], word[hot])
    return share_of(h, n)


def share_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes dealt to ``n`` equal ranges."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _slices(often: np.ndarray, n: int):
    """Text -> (bucket, contexts, run lengths, words, counts). A count or run beyond its byte width comes in several entries."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        context, word, _ = tokens(batch.column(0))
        bucket = bucket_of(context, word, often, n)
        low = np.uint64((1 << 24) - 1)
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(48) | ((context >> np.uint64(8)) & low) << np.uint64(24) | (word & low))
        bucket, context, word = bucket[order], context[order], word[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1])]) if len(word) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(word)))
        extra = (times - 1) // 255  # full entries of 255 besides the last
        bucket, context, word = (np.repeat(x[at], extra + 1) for x in (bucket, context, word))
        count = np.full(len(word), 255, np.int64)
        last = np.cumsum(extra + 1) - 1
        count[last] = times - 255 * extra
        head = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])])) if len(word) else np.zeros(0, np.int64)
        b_at = runs(bucket)
        rows = []
        ends = np.append(b_at[1:], len(word))
        for a, z in zip(b_at.tolist(), ends.tolist(), strict=True):
            own = head[np.searchsorted(head, a) : np.searchsorted(head, z)]
            rows.append((int(bucket[a]), context[own].tobytes(), np.diff(np.append(own, z)).astype("<u4").tobytes(), word[a:z].tobytes(), count[a:z].astype(np.uint8).tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "context", "run", "word", "times"])

    return count


def _merge(path: str, often: np.ndarray, words_n: int):
    """One bucket's bigrams -> files, and rows (part, kind, words, counts, contexts) for the next step."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[1].as_py()
        get = lambda c, t: np.frombuffer(b"".join(group.column(c).to_pylist()), t)
        context = np.repeat(get("context", np.uint64), get("run", "<u4").astype(np.int64))
        word, times = get("word", np.uint64), get("times", np.uint8)
        h = textnum.pair(context, word)
        order = np.argsort(h)
        at = runs(h[order])
        times = np.add.reduceat(times[order].astype(np.int64), at)
        h, context, word = h[order[at]], context[order[at]], word[order[at]]
        store.save(f"{path}/bigram-{bucket}.key", h)
        store.save(f"{path}/bigram-{bucket}.count", np.minimum(times, 255).astype(np.uint8))
        big = np.flatnonzero(times >= 255)
        store.save(f"{path}/bigram-{bucket}.big", np.stack([h[big], times[big].astype(np.uint64)], 1).ravel())

        # contexts: total and how many words follow once, twice, oftener
        order = np.argsort(context)
        c, t = context[order], times[order]
        at = runs(c)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (t, t == 1, t == 2, t > 2)], 1)
        c = c[at]
        hot = np.isin(c, often)
        store.save(f"{path}/context-{bucket}.key", c[~hot])
        store.save(f"{path}/context-{bucket}.stat", stats[~hot].ravel())

        # words: count and contexts, dealt by hash
        order = np.argsort(word)
        w, t = word[order], times[order]
        at = runs(w)
        t, contexts, w = np.add.reduceat(t, at), np.diff(np.append(at, len(w))), w[at]
        part = share_of(textnum.mix(w), words_n)
        order = np.argsort(part, kind="stable")
        at = runs(part[order])
        rows = []
        for a, z in zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True):
            own = order[a:z]
            rows.append((int(part[own[0]]), w[own].tobytes(), _packed(t[own]), _packed(contexts[own])))
        counts = np.array([bucket, *[(times == k).sum() for k in (1, 2, 3, 4)]], np.int64)
        rows.append((-1, b"", b"", counts.tobytes()))
        # contexts that lie in several buckets, dealt by hash
        c, stats = c[hot], stats[hot]
        part = share_of(textnum.mix(c), HOT_PARTS)
        for p in np.unique(part).tolist():
            rows.append((-2 - p, c[part == p].tobytes(), stats[part == p].tobytes(), b""))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["part", "word", "times", "contexts"])

    return merge


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers, each a byte, and the ones from 255 on again as 64 bits after that."""
    return np.concatenate([np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype("<i8").view(np.uint8)]).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(raw, "<i8", (len(raw) - n) // 8, n)
    return x


def _merge_words(path: str):
    """One part of the words -> files, and a row of figures; part -1 passes on the buckets' figures, those below it sum up contexts that lie in several buckets."""

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        part = key[1].as_py()
        names = ["part", "context", "figures"]
        if part == -1:
            counts = np.stack([np.frombuffer(x, np.int64) for x in group.column("contexts").to_pylist()])
            figures = [*counts[:, 1:].sum(axis=0).tolist(), *counts[:, 0].tolist()]
            return pa.table([pa.array([-1]), pa.array([0]), pa.array([figures], pa.list_(pa.int64()))], names=names)
        if part < -1:
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("word").to_pylist()])
            stats = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in group.column("times").to_pylist()])
            unique, inverse = np.unique(keys, return_inverse=True)
            total = np.zeros((len(unique), 4), np.int64)
            np.add.at(total, inverse, stats)
            return pa.table([pa.array([part] * len(unique)), pa.array(unique.view(np.int64)), pa.array(total.tolist(), pa.list_(pa.int64()))], names=names)
        raw = group.column("word").to_pylist()
        word = np.frombuffer(b"".join(raw), np.uint64)
        times, contexts = (np.concatenate([_unpacked(x, len(w) // 8) for x, w in zip(group.column(c).to_pylist(), raw, strict=True)]) for c in ("times", "contexts"))
        order = np.argsort(word)
        at = runs(word[order])
        if len(at):
            times, contexts, word = np.add.reduceat(times[order], at), np.add.reduceat(contexts[order], at), word[order[at]]
        store.save(f"{path}/word-{part}.key", word)
        store.save(f"{path}/word-{part}.stat", np.stack([times, contexts], 1).ravel())
        figures = [len(word), int(times.sum()), int(contexts.sum()), *[int((contexts == k).sum()) for k in (1, 2, 3, 4)]]
        return pa.table([pa.array([part]), pa.array([0]), pa.array([figures], pa.list_(pa.int64()))], names=names)

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more; without the counts that the formula needs, 0.5, 1 and 1.5 at most."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1)]])


class Model:
    """Paths and figures of a trained model; small whatever the corpus. Arrays are mapped where they are used."""

    def __init__(self, path: str, buckets: int, parts: int, often: dict[int, list[int]], counts: list[int], full: set[int], full_words: set[int], types: int, total: int, pairs: int, word_counts: list[int]):
        self.path, self.buckets, self.parts, self.full, self.full_words, self.types, self.total, self.pairs = path, buckets, parts, full, full_words, types, total, pairs
        self.often = np.array(sorted(often), np.uint64)
        self.often_stat = np.array([often[k] for k in sorted(often)], np.int64).reshape(-1, 4)
        self.d, self.d_word = discounts(*counts), discounts(*word_counts)
        n1, n2, n3 = word_counts[0], word_counts[1], types - word_counts[0] - word_counts[1]
        self.word_rest = float(self.d_word[1] * n1 + self.d_word[2] * n2 + self.d_word[3] * n3) / pairs if pairs else 1.0
        self._open: dict = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"} | {"_open": {}}

    def _get(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = store.load(f"{self.path}/{name}", dtype)
            if store.local(self.path) is None:
                while len(self._open) > 1 and sum(x.nbytes for x in self._open.values()) > READ_BYTES:
                    self._open.pop(next(iter(self._open)))
        return self._open[name]

    def _find(self, kind: str, place: np.ndarray, h: np.ndarray, read) -> None:
        """For each file of ``kind`` that is asked for: calls read(number, asked rows that are found, their places)."""
        order = np.argsort(place, kind="stable")
        at = runs(place[order])
        for a, z in zip(at.tolist(), np.append(at[1:], len(order)).tolist(), strict=True):
            n = int(place[order[a]])
            if n not in (self.full_words if kind == "word" else self.full):
                continue
            keys = self._get(f"{kind}-{n}.key", np.uint64)
            if len(keys):
                own = order[a:z]
                to = np.minimum(np.searchsorted(keys, h[own]), len(keys) - 1)
                hit = keys[to] == h[own]
                read(n, own[hit], to[hit])

    def words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of contexts of words."""
        out = np.zeros((len(word), 2), np.int64)
        if self.total:
            def read(n, rows, to):
                out[rows] = self._get(f"word-{n}.stat", np.int64).reshape(-1, 2)[to]

            self._find("word", share_of(textnum.mix(word), self.parts), word, read)
        return out[:, 0], out[:, 1]

    def logs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p(word | context), log10 of the add-one unigram, and counts of the words."""
        w, back = np.unique(word, return_inverse=True)
        count, contexts = self.words(w)
        base = np.log10((count + 1) / (self.total + self.types + 1))
        p = self.word_rest / (self.types + 1) + np.maximum(contexts - self.d_word[np.minimum(contexts, 3)], 0) / max(self.pairs, 1)
        p = p[back]
        if self.total:
            c, c_back = np.unique(context, return_inverse=True)
            stat = np.zeros((len(c), 4), np.int64)
            if len(self.often):
                k = np.minimum(np.searchsorted(self.often, c), len(self.often) - 1)
                hot = self.often[k] == c
                stat[hot] = self.often_stat[k[hot]]

            def read(n, rows, to):
                stat[rows] = self._get(f"context-{n}.stat", np.int64).reshape(-1, 4)[to]

            nobody = np.zeros(0, np.uint64)
            self._find("context", bucket_of(c, c, nobody, self.buckets), c, read)
            total = stat[:, 0].astype(float)
            rest = np.where(total > 0, (stat[:, 1:] * self.d[1:]).sum(axis=1) / np.maximum(total, 1), 1.0)
            times = np.zeros(len(word), np.int64)

            def read_pairs(n, rows, to):
                t = self._get(f"bigram-{n}.count", np.uint8)[to].astype(np.int64)
                if (t == 255).any():
                    big = np.asarray(self._get(f"bigram-{n}.big", np.uint64)).reshape(-1, 2)
                    at = np.flatnonzero(t == 255)
                    t[at] = big[np.searchsorted(big[:, 0], hashed[rows[at]]), 1].astype(np.int64)
                times[rows] = t

            hashed = textnum.pair(context, word)
            self._find("bigram", bucket_of(context, word, self.often, self.buckets), hashed, read_pairs)
            seen = np.maximum(times - self.d[np.minimum(times, 3)], 0) / np.maximum(total[c_back], 1)
            p = np.where(times > 0, seen, 0) + rest[c_back] * p
        return np.log10(p), base[back], count[back]


def _dealt(rows: DataFrame, number: str, n: int) -> GroupedData:
    """``rows`` grouped by ``number`` (``n`` of them) and dealt to partitions by it, one each up to ``PLACES`` or the session's shuffle partitions.

    By hash, some partitions would get several groups while others get none.
    """
    places = min(n, max(PLACES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = fresh(rows, "place")
    rows = rows.withColumn(place, F.pmod(number, F.lit(places)).cast("int"))
    return rows.repartitionById(places, place).groupBy(place, number)


def train(docs: DataFrame, text_col: str = "text", path: str | None = None) -> Model:
    """Count the texts of ``docs`` and write the model below ``path`` (default: a new folder of the shared one)."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/lm-{uuid.uuid4().hex[:8]}"
    texts = docs.select(F.col(text_col).alias("text"))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, n = np.unique(tokens(batch.column(0))[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    sample = written(arrow_map(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-sample")
    size = texts.select(F.sum(F.octet_length("text") / 6 + 1)).first()[0] or 0
    seen = sample.agg(F.sum("n")).first()[0] or 0
    # fewer than OFTEN words have more than 1 / OFTEN of all
    most = sample.where(F.col("n") > max(20, seen / OFTEN)).select("word")
    often = np.sort(np.array([r.word for r in most.collect()], np.int64).view(np.uint64))
    buckets = 8
    while buckets * BUCKET_TOKENS < size:
        buckets *= 2
    parts = buckets

    counted = arrow_map(texts, _slices(often, buckets), "bucket bigint, context binary, run binary, word binary, times binary", 0, SLICE_BYTES)
    merged = _dealt(counted, "bucket", buckets).applyInArrow(_merge(path, often, parts), "part bigint, word binary, times binary, contexts binary")
    figures = _dealt(merged, "part", parts).applyInArrow(_merge_words(path), "part bigint, context bigint, figures array<bigint>").collect()
    hot = {int(np.int64(r.context).view(np.uint64)): r.figures for r in figures if r.part < -1}
    counts = next((r.figures for r in figures if r.part == -1), [0] * 4)
    total = np.array([r.figures for r in figures if r.part >= 0], np.int64).reshape(-1, 7).sum(axis=0).tolist()
    return Model(path, buckets, parts, hot, counts[:4], set(counts[4:]), {r.part for r in figures if r.part >= 0}, total[0], total[1], total[2], total[3:])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: id, n_tokens, n_known, base_score, score (log10), perplexity, and ``extra`` columns but those of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = {k: c for k, c in (extra or {}).items() if k.lower() not in ("id", "n_tokens", "n_known", "base_score", "score", "perplexity")}
    names = ["id", *more]
    rows = docs.select(F.col(text_col).alias(unused("text", names)), F.col(id_col).alias("id"), *[c.alias(k) for k, c in more.items()])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        context, word, first = tokens(batch.column(0))
        p, base, count = shared.value.logs(context, word)
        n = np.diff(first)
        total = textnum.row_sums(p, first)
        cols = [n, textnum.row_sums((count > 0).astype(np.int64), first), textnum.row_sums(base, first), total, 10 ** (-total / n)]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], *map(pa.array, cols)], [*names, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"])
    return arrow_map(rows, score, schema, 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(7) == 2
    model = train(docs.where(~held_out))
    out = scored(docs, model, extra={"held_out": held_out})
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_lm_scoring`` that SQL can tell."""
    return op7_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


# held_out: crc32 of the id's text, bit by bit: each byte is one event, eight shifts follow

BASE_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, doc_id, text, flatten(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1), lambda k: [ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS ev FROM documents),
d AS (SELECT r, doc_id, xor(list_reduce(ev, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), '') AS ws FROM e),
t AS (SELECT r, doc_id, held_out, w FROM d, unnest(ws) u(w)),
c AS (SELECT w, count(*) AS n FROM t WHERE NOT held_out GROUP BY w),
a AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS types FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.n)::BIGINT AS n_known, any_value(total) AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 1)::DOUBLE / (total + types + 1))), 3) AS base_score
FROM t LEFT JOIN c USING (w), a GROUP BY r, doc_id, held_out
"""
