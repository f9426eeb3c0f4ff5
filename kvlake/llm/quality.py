"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting cycles over the features; a round fits a tree of at most four
leaves over one feature's bins to the residual and adds it to that feature's table. Then the pairs whose joint
table explains most of what is left are boosted in the same way (a cut in either feature, four leaves). Scoring
is a sum of table entries. The tables can be read: they are the whole model.

Training sees about ``PER_CLASS`` labelled texts of each class at most.

Defined results: null and empty texts are scored by the features of an empty text; without labelled rows, or with one
class alone, the score is that class's share (0.5 without rows); repeated rows get equal scores; extra columns are
not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import textnum
from kvlake.llm.common import arrow_map, fold, table, unused
from kvlake.llm.sampling import labelled

PER_CLASS, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 6000, 64, 16, 6, 60, 0.15
FEATURES = ["log_words", "word_length", "symbols", "capitals", "digits", "punctuation", "exclamations", "distinct", "most_frequent", "short_words", "line_breaks", "pure_words"]

_KIND = np.zeros((256, 6), bool)  # symbols, capitals, digits, punctuation, exclamations, line breaks
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"], 0] = True
_KIND[65:91, 1] = True
_KIND[48:58, 2] = True
_KIND[[ord(c) for c in ".,;:?\"'()-"], 3] = True
_KIND[ord("!"), 4] = True
_KIND[10, 5] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text, over the whole text."""
    buf, at = textnum.raw_bytes(texts)
    starts, ends, first = textnum.spans(buf, at, textnum.NON_SPACE)
    low = textnum.LOWER[buf]
    h = textnum.hashes(low, starts, ends)
    rows, n, size = len(at) - 1, np.maximum(np.diff(first), 1), np.maximum(np.diff(at), 1)
    out = np.zeros((rows, len(FEATURES)))
    out[:, 0] = np.log1p(np.diff(first))
    # characters, not bytes: continuation bytes don't count
    char = (buf & 0xC0) != 0x80
    length = np.concatenate([[0], np.cumsum(char)])
    out[:, 1] = textnum.row_sums((length[ends] - length[starts]).astype(float), first) / n
    for k, kind in enumerate((0, 1, 2, 3, 4)):
        total = np.concatenate([[0], np.cumsum(_KIND[:, kind][buf])])
        out[:, 2 + k] = (total[at[1:]] - total[at[:-1]]) / size
    upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) if len(buf) else np.zeros(0, int)
    out[:, 3] += np.bincount(np.searchsorted(at, upper, "right") - 1, minlength=rows)[:rows] / size
    for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if z > a:
            own = np.sort(h[a:z])
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            out[k, 7], out[k, 8] = (len(cut) - 1) / (z - a), np.diff(cut).max() / (z - a)
    out[:, 9] = textnum.row_sums((length[ends] - length[starts] <= 3).astype(float), first) / n
    breaks = np.concatenate([[0], np.cumsum(_KIND[:, 5][buf])])
    out[:, 10] = (breaks[at[1:]] - breaks[at[:-1]]) / n
    odd = np.concatenate([[0], np.cumsum(~textnum.WORD[low])])
    out[:, 11] = textnum.row_sums((odd[ends] == odd[starts]).astype(float), first) / n
    return out


def _tree(g: np.ndarray, n: np.ndarray, leaves: int = 4, least: float = 5.0) -> np.ndarray:
    """A piecewise constant fit over bins: sums ``g`` and weights ``n`` of the bins in, values out. Best-first splits."""
    parts = [(0, len(g))]
    G, N = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(n)])
    gain = lambda a, z: (G[z] - G[a]) ** 2 / (N[z] - N[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, z in parts:
            for c in range(a + 1, z):
                if min(N[c] - N[a], N[z] - N[c]) >= least:
                    v = gain(a, c) + gain(c, z) - gain(a, z)
                    if v > best[0]:
                        best = (v, (a, z), c)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (G[z] - G[a]) / (N[z] - N[a] + 1)
    return out


def _pair_tree(g: np.ndarray, n: np.ndarray, least: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut in one feature followed by the best cut in the other on either side."""
    best, out = 0.0, np.zeros(g.shape)
    for axis in (0, 1):
        G, N = (g, n) if axis == 0 else (g.T, n.T)
        for c in range(1, len(G)):
            values, total = np.zeros(G.shape), 0.0
            for side in (slice(0, c), slice(c, len(G))):
                tree = _tree(G[side].sum(axis=0), N[side].sum(axis=0), 2, least)
                values[side] = tree
                total += float((tree * G[side].sum(axis=0)).sum())
            if total > best:
                best, out = total, values if axis == 0 else values.T
    return best, out


class Gam:
    """Bin edges, a table a feature, a table a chosen pair, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        # weights have mean 1
        weight = np.ones(len(y)) if weight is None or not len(y) else weight / weight.mean()
        share = float(np.sum(weight * y) / np.sum(weight)) if len(y) else 0.5
        self.start = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))) if 0 < share < 1 else (0.0 if not len(y) else (13.8 if share == 1 else -13.8))
        k = x.shape[1]
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid)) if len(x) else np.zeros(0) for j in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not 0 < share < 1:
            return
        bins, f = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], np.full(len(y), self.start)
        for _ in range(ROUNDS):
            for j in range(k):
                p = 1 / (1 + np.exp(-f))
                w = p * (1 - p)
                m = len(self.tables[j])
                t = RATE * np.clip(_tree(np.bincount(bins[j], weight * (y - p), m), np.bincount(bins[j], weight * w, m)), -4, 4)
                self.tables[j] += t
                f += t[bins[j]]
        low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]

        def joint(i, j, v):
            a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
            return np.bincount(low[i] * b + low[j], weight * v, a * b).reshape(a, b)

        p = 1 / (1 + np.exp(-f))
        gains = sorted(((_pair_tree(joint(i, j, y - p), joint(i, j, p * (1 - p)))[0], i, j) for i, j in itertools.combinations(range(k), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for g, i, j in gains[:PAIRS] if g > 0]
        for _ in range(ROUNDS // 6):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                add = RATE * np.clip(_pair_tree(joint(i, j, y - p), joint(i, j, p * (1 - p)))[1], -4, 4)
                t += add
                f += add[low[i], low[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += t[np.searchsorted(e, x[:, j], "right")]
        low = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for p in self.pairs for j in p[:2]}
        for i, j, t in self.pairs:
            f += t[low[i], low[j]]
        return 1 / (1 + np.exp(-f))


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(features(batch.column(0))), pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = PER_CLASS) -> Gam:
    """Learn from ``most`` labelled rows of each class at most, which weigh as all labels of their class. Labels that repeat count once."""
    rows, counts = labelled(docs, labels, label_col, id_col, text_col, most)
    found = arrow_map(rows, _rows, "label int, x array<double>", 0).collect()
    found.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in found]) if found else np.zeros((0, len(FEATURES)))
    # one over the share that the sample took of the class
    return Gam(x, np.array([r.label for r in found], float), np.array([max(1.0, counts[r.label] / most) for r in found]))


def scored(docs: DataFrame, model: Gam, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """``keep`` columns, then score and predicted of each row's whole text. A kept column of these names is replaced."""
    keep = {k: c for k, c in (keep or {"doc_id": F.col("doc_id")}).items() if k.lower() not in ("score", "predicted")}
    rows = docs.select(F.col(text_col).alias(unused("text", keep)), *[c.alias(k) for k, c in keep.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(features(batch.column(0)))
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows, score, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int", 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return scored(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": fold(3) == 1})
