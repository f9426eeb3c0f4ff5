"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give a score and offsets.

Tokens are words; their features are the whole word and its first 3 to 6 bytes. The labels say which texts are toxic,
not which words are. Token labels come from the labelled texts: a token of a toxic text is toxic if one of its features
occurs in so many toxic texts and so few others that chance would not bring forth one such feature among all. The
field is trained on these tags. Forward-backward marginals of a text's tokens are summed up to the expected number of
toxic tokens and their maximum, which a logistic function, fitted on the labelled texts, turns into the score.

Copies are no evidence of their own: a labelled text weighs one over the number of sampled texts that it is a near copy
of, told by the least hashes of its word triples. Else all words of a toxic text that was copied often would be toxic.

Training sees ``PER_CLASS`` labelled texts of each class at most, and ``FIELD_TEXTS`` of them of each class for the field.

Defined results: null and empty texts have no tokens and the score of a text without toxic tokens; without labelled
rows of both classes the score is the share of class 1 (0 without rows); extra columns are not looked at; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import crf, textnum
from kvlake.llm.common import arrow_map, fold, fresh, table, written
from kvlake.llm.sampling import labelled

PER_CLASS, FIELD_TEXTS, HASHES = 3000, 600, 8
PIECE_BYTES, STEP = 1 << 20, 1 << 15  # text tagged at once, words whose features are made at once
PREFIXES = (3, 4, 5, 6)
SURE = -12.0  # log probability below which a feature isn't toxic by chance among some 100,000


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The feature hashes of words, one row a word. buf: lower-cased bytes."""
    h = textnum.hashes(buf, starts, ends)
    out = np.empty((len(h), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = h
    if len(h):
        padded = np.zeros(len(buf) + 8, np.uint8)
        padded[: len(buf)] = buf
        eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))[starts]
        for k, n in enumerate(PREFIXES):
            out[:, 1 + k] = textnum.mix((eight & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 56))
            out[ends - starts <= n, 1 + k] = h[ends - starts <= n]  # a prefix is shorter than its word
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all rows, word starts and ends in them, and each row's first word."""
    buf, at = textnum.raw_bytes(texts)
    buf = textnum.LOWER[buf]
    return buf, *textnum.spans(buf, at, textnum.WORD)


def token_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first word, and the feature hashes of each word (one row a word)."""
    buf, starts, ends, first = words_of(texts)
    return first, features(buf, starts, ends)


def least_hashes(texts: pa.Array) -> np.ndarray:
    """``HASHES`` least hashes of each text's word triples (of its words where it has fewer than three); zeros without words."""
    _, _, _, first, h = textnum.words(texts, textnum.WORD)
    triples = textnum.pair(textnum.pair(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else h[:0]
    out = np.zeros((len(first) - 1, HASHES), np.uint64)
    for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = triples[a : z - 2] if z - a > 2 else h[a:z]
        if len(own):
            out[k] = [textnum.mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1)).min() for j in range(HASHES)]
    return out


def weights_of(hashes: np.ndarray) -> np.ndarray:
    """One over the mean number of texts that share a text's least hash, in millionths."""
    same = np.zeros(len(hashes))
    for column in hashes.T:
        _, back, n = np.unique(column, return_inverse=True, return_counts=True)
        same += n[back]
    return np.round(1e6 * hashes.shape[1] / np.maximum(same, 1)).astype(np.int64)


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array([x.tobytes() for x in least_hashes(batch.column(0))], pa.binary())], ["h", "label", "least"])


def _counts(known: np.ndarray, weight: np.ndarray):
    """Texts -> how much toxic and other texts of the batch weigh that each feature occurs in."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, feats = token_features(batch.column(0))
        label, own = batch.column(1).to_numpy(), weight[np.searchsorted(known, batch.column(2).to_numpy())]
        found = [(np.zeros(0, np.uint64), 0, 0)] + [(np.unique(feats[a:z]), label[k], own[k]) for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]
        h, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        n = np.zeros((2, len(h)), np.int64)
        np.add.at(n, (np.repeat([f[1] for f in found], [len(f[0]) for f in found]), back), np.repeat([f[2] for f in found], [len(f[0]) for f in found]))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n[1]), pa.array(n[0])], ["feature", "toxic", "other"])

    return count


class Lookup:
    """Positions of hashes in a sorted table; a bit table settles most of those that aren't in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` (flat) that are in the table, and their positions in it."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[to] == h[at]
        return at[hit], to[hit]


class Tagger:
    """Features, the field's weights, and the logistic function of a text's expected toxic tokens and their maximum."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, start: np.ndarray, move: np.ndarray, link: np.ndarray):
        self.lookup, self.weights, self.start, self.move, self.link = Lookup(keys), weights, start, move, link

    def tag(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each word. Features are made for ``STEP`` words at a time."""
        e = np.full(len(starts), self.weights[-1])
        for a in range(0, len(starts), STEP):
            z = min(a + STEP, len(starts))
            low = starts[a]
            feats = features(buf[low : ends[z - 1]], starts[a:z] - low, ends[a:z] - low)
            at, to = self.lookup(feats.ravel())
            np.add.at(e, a + at // feats.shape[1], self.weights[to])
        return crf.marginals(e, heads(first), self.start, self.move)[0]

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = sums(p, first)
        z = x[:, 0] * self.link[0] + x[:, 1] * self.link[1] + x[:, 2] * self.link[2] + x[:, 3] * self.link[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def heads(first: np.ndarray) -> np.ndarray:
    """The first words of the rows that have any."""
    return first[:-1][np.diff(first) > 0]


def sums(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log(1 + expected toxic tokens), the largest marginal, log(1 + tokens) and 1 for each row."""
    most = np.zeros(len(first) - 1)
    has = np.flatnonzero(np.diff(first) > 0)
    if len(has):
        most[has] = np.maximum.reduceat(p, first[has])
    return np.stack([np.log1p(textnum.row_sums(p, first)), most, np.log1p(np.diff(first)), np.ones(len(most))], 1)


def logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; rows weigh ``c`` each."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (c * (y - p)) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _tokens(keys: np.ndarray):
    """Texts -> (label, number of words, places of words with known features, those features)."""
    lookup = Lookup(keys)

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, feats = token_features(batch.column(0))
        at, to = lookup(feats.ravel())
        at //= feats.shape[1]
        cut = np.searchsorted(at, first)
        rows = [((at[a:z] - w).astype("<i4").tobytes(), to[a:z].astype("<i4").tobytes()) for a, z, w in zip(cut[:-1].tolist(), cut[1:].tolist(), first[:-1].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "n", "at", "feature"]).append_column("h", batch.column(2))

    return tokens


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = PER_CLASS) -> Tagger:
    """Learn from ``most`` labelled rows of each class at most."""
    rows, given = labelled(docs, labels, label_col, id_col, text_col, most)
    rows = written(rows.select("text", "label", F.xxhash64("text").alias("h")), "toxic-sample")
    all1, all0 = given.get(1, 0), given.get(0, 0)
    size = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    nothing = np.zeros(0, np.uint64)
    if not n1 or not n0:
        share = 1 - 1e-6 if n1 else 1e-6
        return Tagger(nothing, np.array([-10.0]), np.zeros(2), np.zeros((2, 2)), np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    sample = arrow_map(rows, _hashed, "h bigint, label int, least binary", 0, PIECE_BYTES).collect()
    sample.sort(key=lambda r: (r.h, r.label))
    known = np.array([r.h for r in sample], np.int64)
    weight = weights_of(np.stack([np.frombuffer(r.least, np.uint64) for r in sample]))
    of_class = [int(weight[[r.label == y for r in sample]].sum()) for y in (0, 1)]
    millionth = lambda c: (F.sum(c) / 1e6).alias(c)
    counted = arrow_map(rows, _counts(known, weight), "feature bigint, toxic bigint, other bigint", 0, PIECE_BYTES).groupBy("feature").agg(millionth("toxic"), millionth("other"))
    # the log probability that chance deals this few of the texts to the other class; below 1 / features it isn't chance
    share = of_class[1] / sum(of_class)
    total = F.col("toxic") + F.col("other")
    rate = F.greatest(F.col("toxic") / total, F.lit(share))
    chance = -total * (rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    # over twice as frequent in toxic texts as in others: a ratio that can be reached whatever the classes' shares are
    often = F.col("toxic") * of_class[0] > 2 * F.col("other") * of_class[1]
    counted = counted.where("toxic >= 3").withColumn("chance", chance).where((F.col("chance") < -4) & often)
    kept = counted.orderBy("chance", "feature").collect()
    at = np.array([r.feature for r in kept], np.int64).view(np.uint64)
    order = np.argsort(at)
    keys = at[order]
    sure = np.array([r.chance for r in kept])[order] < SURE

    texts = arrow_map(rows, _tokens(keys), "label int, n bigint, at binary, feature binary, h bigint", 0, PIECE_BYTES).collect()
    texts.sort(key=lambda r: (r.label, r.n, bytes(r.at), bytes(r.feature), r.h))
    pick = np.random.default_rng(11)
    chosen = [pick.permutation([k for k, r in enumerate(texts) if r.label == y and r.n])[:FIELD_TEXTS] for y in (0, 1)]

    def chain(which) -> tuple:
        n = np.array([texts[k].n for k in which], np.int64)
        base = np.cumsum(n) - n
        tok = [np.frombuffer(texts[k].at, "<i4") + b for k, b in zip(which, base.tolist(), strict=True)]
        feat = [np.frombuffer(texts[k].feature, "<i4") for k in which]
        return np.append(base, n.sum()), np.concatenate(tok or [np.zeros(0, np.int64)]), np.concatenate(feat or [np.zeros(0, np.int64)]).astype(np.int64)

    first, tok, feat = chain(np.concatenate(chosen).astype(int))
    y = np.zeros(first[-1], np.int64)
    y[tok[sure[feat]]] = 1
    y[: first[len(chosen[0])]] = 0
    w, start, move = crf.fit((tok, feat), len(keys), int(first[-1]), first[:-1], y)
    tagger = Tagger(keys, w, start, move, np.zeros(4))
    x, labels_of = [], []
    for a in range(0, len(texts), 500):
        part = range(a, min(len(texts), a + 500))
        first, tok, feat = chain(part)
        e = np.full(first[-1], w[-1])
        np.add.at(e, tok, w[feat])
        p = crf.marginals(e, heads(first), start, move)[0]
        x.append(sums(p, first))
        labels_of += [texts[k].label for k in part]
    y = np.array(labels_of, float)
    # rows count as in the table they are a sample of, and copies as one
    alone = weight[np.searchsorted(known, np.array([r.h for r in texts], np.int64))] / 1e6
    tagger.link = logistic(np.concatenate(x), y, alone * np.where(y > 0, all1 / n1, all0 / n0))
    return tagger


def tagged(docs: DataFrame, model: Tagger, text_col: str = "text", text: str = "drop", span_at: float = 0.5) -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and its name: score, predicted, and spans (start and stop bytes in UTF-8 of runs of words with P(toxic) >= ``span_at``)."""
    name = fresh(docs, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c != text_col or text == "keep"]

    def tag(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        buf, starts, ends, first = words_of(batch.column(at))
        p = model.tag(buf, starts, ends, first)
        score = model.score(p, first)
        bad = np.flatnonzero(p >= span_at)
        row = np.searchsorted(first, bad, "right") - 1
        new = np.concatenate([[True], (bad[1:] != bad[:-1] + 1) | (row[1:] != row[:-1])]) if len(bad) else np.zeros(0, bool)
        runs = np.flatnonzero(new)
        last = np.append(runs[1:], len(bad)) - 1 if len(runs) else runs
        base = textnum.raw_bytes(batch.column(at))[1][:-1][row[runs]]
        spans = pa.StructArray.from_arrays([pa.array(starts[bad[runs]] - base, pa.int32()), pa.array(ends[bad[last]] - base, pa.int32())], ["start", "stop"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[runs], np.arange(batch.num_rows + 1)), pa.int32()), spans)
        out = pa.StructArray.from_arrays([pa.array(score), pa.array((score >= 0.5).astype(np.int32)), spans], ["score", "predicted", "spans"])
        return pa.RecordBatch.from_arrays([batch.column(k) for k, c in enumerate(batch.schema.names) if c in kept] + [out], [*kept, name])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{name}` struct<score:double,predicted:int,spans:array<struct<start:int,stop:int>>>"])
    return arrow_map(docs, tag, schema, at, PIECE_BYTES), name


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    out, name = tagged(docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model)
    t = F.col(name)
    return out.select("doc_id", "held_out", t["score"].alias("score"), t["predicted"].alias("predicted"), F.size(t["spans"]).cast("long").alias("n_spans"), t["spans"].alias("spans"))
