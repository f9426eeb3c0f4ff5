"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte 2-, 3- and 4-grams of the lower-cased text, as an L2-normalised vector. Families are told
apart, and then the languages of the chosen family, by one-versus-one linear support vector machines that vote;
equal votes go to the larger sum of margins. Training sees a bounded sample of each language (``PER_LANG`` texts)
as whole texts and as short pieces of them, so that short texts are told apart too.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without a language to learn from every
text is ``und``; a single language is predicted for all texts with letters; extra columns are not looked at; rows that repeat get equal results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import textnum
from kvlake.llm.common import arrow_map, fold, table, unused, written
from kvlake.llm.sampling import per_class

PER_LANG, PIECES, DIM = 300, 4, 4096

#: ISO 639-1 codes of common languages by family. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Byte -> byte of a text as it is seen here: A-Z lower-cased, other ASCII than letters a space.
_SEEN = textnum.LOWER.copy()
_SEEN[:0x61] = 0x20
_SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)
_SEEN[0x7B:0x80] = 0x20


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def vectors(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """L2-normalised counts of hashed byte 2- to 4-grams inside each row."""
    rows = len(at) - 1
    out = np.zeros(rows * DIM, np.float32)
    if len(buf):
        b = _SEEN[buf].astype(np.uint32)
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at)) * DIM
        ends = np.repeat(at[1:], np.diff(at))
        for n in (2, 3, 4):
            if len(b) < n:
                break
            h = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(257) + b[k : len(b) - n + 1 + k]
            h = (h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
            inside = np.arange(n, len(b) + 1) <= ends[: len(h)]
            out += np.bincount(row[: len(h)][inside] + h[inside], minlength=rows * DIM)
    out = out.reshape(rows, DIM)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """A linear support vector machine (hinge loss, bias as a last constant feature) by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    q = (x * x).sum(axis=1)
    # both classes weigh the same
    top = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    w, a, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(a[i] - g / q[i], 0.0), top[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w.astype(np.float32)


class Rows:
    """Sparse vectors, (indices, values) each, which stay so until a machine learns from some of them."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors

    def of(self, which: np.ndarray) -> Rows:
        return Rows([self.vectors[k] for k in which])

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), DIM), np.float32)
        for row, k in zip(out, which, strict=True):
            row[self.vectors[k][0]] = self.vectors[k][1]
        return out


class Vote:
    """One-versus-one machines over classes."""

    def __init__(self, x: Rows, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        own = {c: np.flatnonzero(labels == c) for c in self.classes}
        w = []
        for i, j in self.pairs:
            a, b = own[self.classes[i]], own[self.classes[j]]
            w.append(svm(x[np.concatenate([a, b])], np.concatenate([np.ones(len(a)), -np.ones(len(b))])))
        self.w = np.stack(w).T if w else np.zeros((DIM + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and in (0, 1) how clear the weakest of the winner's duels is."""
        m = x @ self.w[:-1] + self.w[-1]
        votes, sums = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += m[:, k] > 0
            votes[:, j] += m[:, k] <= 0
            sums[:, i] += m[:, k]
            sums[:, j] -= m[:, k]
        best = (votes + np.tanh(sums / (1 + np.abs(sums).max(initial=0))) * 0.5).argmax(axis=1)
        weakest = np.full(len(x), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            weakest = np.where(best == i, np.minimum(weakest, m[:, k]), np.where(best == j, np.minimum(weakest, -m[:, k]), weakest))
        return best, 1 / (1 + np.exp(-3 * np.minimum(weakest, 20)))


class Identifier:
    """The family vote and a vote within each family."""

    def __init__(self, x: Rows, langs: np.ndarray):
        families = np.array([family(x) for x in langs])
        self.families = Vote(x, families)
        self.within = [Vote(x.of(np.flatnonzero(families == f)), langs[families == f]) for f in self.families.classes]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, score = self.families.predict(x)
        lang = np.empty(len(x), object)
        for k, vote in enumerate(self.within):
            own = np.flatnonzero(f == k)
            if len(own):
                best, s = vote.predict(x[own])
                lang[own] = np.array(vote.classes, object)[best]
                score[own] = score[own] * s
        return lang, score


def _examples(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text and some pieces of it as sparse vectors: (lang, indices, values)."""
    langs, index, value = [], [], []
    for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
        words = (text or "").split()
        if not words:
            continue
        rng = np.random.default_rng(len(text) * 31 + len(words))
        parts = [text]
        for k in range(PIECES):
            n = int(rng.integers(1 + 3 * k, 4 + 6 * k))
            a = int(rng.integers(0, max(1, len(words) - n + 1)))
            parts.append(" ".join(words[a : a + n]))
        v = vectors(*textnum.raw_bytes(pa.array(parts, pa.string())))
        for row in v:
            at = np.flatnonzero(row)
            if len(at):
                langs.append(lang)
                index.append(at.astype(np.uint16).tobytes())
                value.append(row[at].astype(np.float16).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["lang", "at", "value"])


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Identifier | None:
    """Learn from about ``per_lang`` distinct texts of each language at most; None without any."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # only hashes are made distinct over all rows; of the texts chosen, one copy each comes along
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = per_class(written(rows.select("lang", "h").distinct(), "lang-texts"), "lang", per_lang, F.col("h"))
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")
    found = arrow_map(sample, _examples, "lang string, at binary, value binary", 0, 1 << 20).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.value)))
    x = Rows([(np.frombuffer(r.at, np.uint16), np.frombuffer(r.value, np.float16)) for r in found])
    return Identifier(x, np.array([r.lang for r in found], object))


def identified(docs: DataFrame, model: Identifier | None, text_col: str = "text", keep: dict | None = None) -> DataFrame:
    """``keep`` columns, then lang_pred and score of each row's whole text. A kept column of these names is replaced."""
    keep = {k: c for k, c in (keep or {"doc_id": F.col("doc_id")}).items() if k.lower() not in ("lang_pred", "score")}
    rows = docs.select(F.col(text_col).alias(unused("text", keep)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(unused("letters", keep)), *[c.alias(k) for k, c in keep.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        letters = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        lang, score = np.full(n, "und", object), np.zeros(n)
        if shared.value is not None:
            buf, at = textnum.raw_bytes(batch.column(0))
            for a in range(0, n, 512):  # bounds the matrix
                z = min(n, a + 512)
                part, s = shared.value.predict(vectors(buf[at[a] : at[z]], at[a : z + 1] - at[a]))
                lang[a:z], score[a:z] = np.where(letters[a:z], part, "und"), np.where(letters[a:z], s, 0.0)
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(2, batch.num_columns)], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows, predict, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double", 0)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    model = train(docs.where(~held_out))
    return identified(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out})
