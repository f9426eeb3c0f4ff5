"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is summarised by ``BANDS * ROWS`` registers. A shingle's hash picks a register,
which keeps the smallest second hash as its count of leading zeros (4 bits) and the mantissa bits that follow
(4 bits); empty registers take over another's by a fixed sequence of probes, so short texts can be banded too.
Documents that agree in a whole band are candidates. The share of equal registers, corrected for chance equality
of compressed values, estimates Jaccard similarity; candidates with a fair estimate are verified on full sets. Documents that
share a bucket get a second, longer row of registers (``SKETCH``) for that estimate.

With 40 bands of 5 registers a link at similarity 0.8 is missed with probability 1.3e-7, one above it with less.

Groups are never expanded into pairs. Equal sets become one node. A bucket's leader is the node that shares most buckets
with others (in a group of copies that is the text they stem from). Each node is first verified against one leader, the
one it meets most often; only buckets whose nodes are still in different components after that are looked at node by
node, in blocks of bounded size, and pairs within a component are left out. Jaccard distance is a metric: two nodes
whose known distances to one leader differ by more than the links' bound can't be linked, and aren't compared.

Defined results: null or empty texts have no set and are linked with nothing; texts of fewer words than a shingle are
one shingle; rows that repeat a doc_id are told apart by their texts but are one document: links of any of its texts
count for the id, so all of them get one component_id; a null doc_id is a document of its own class (component_id
null, kept); ids must be integers, others are read as null; extra columns are not looked at; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import textnum
from kvlake.llm.common import arrow_map, table, written
from kvlake.llm.components import components

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, MANTISSA = 40, 5, 4
REGISTERS = BANDS * ROWS
SKETCH = 640
DEVIATIONS = 6  # standard deviations below the link's similarity from which on an estimate is too low
BLOCK, SMALL_ROWS = 256, 2048
BLANK = 255
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted; empty without words."""
    _, _, _, first, h = textnum.words(texts, textnum.NON_SPACE)
    out = []
    grams = h
    for k in range(1, size):
        grams = textnum.pair(grams[: len(h) - k], h[k:]) if len(h) > k else grams[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = h[a : a + 1]
            for k in range(a + 1, b):
                whole = textnum.pair(whole, h[k : k + 1])
            out.append(textnum.mix(whole + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray], size: int = REGISTERS, fill: bool = True) -> np.ndarray:
    """``size`` HyperMinHash registers, one row a set; a set without shingles has a row of zeros. Without ``fill`` empty registers hold ``BLANK``."""
    n = len(sets)
    least = np.full(n * size, _EMPTY)
    if n and sum(map(len, sets)):
        x = np.concatenate(sets)
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        at = ((textnum.mix(x ^ np.uint64(0x5851F42D4C957F2D + size)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, row * size + at, textnum.mix(x ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(1))
    frac, exp = np.frexp((least >> np.uint64(10)).astype(np.float64))  # 53 significant bits
    zeros = np.clip(53 - exp, 0, 15)
    code = (zeros << MANTISSA | np.clip((frac * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)).astype(np.uint8).reshape(n, size)
    empty = (least == _EMPTY).reshape(n, size)
    if not fill:
        return np.where(empty, BLANK, np.minimum(code, BLANK - 1)).astype(np.uint8)
    some = ~empty.all(axis=1)
    code[~some] = 0
    r, c = np.nonzero(empty & some[:, None])
    probe, filled = np.uint64(0), code.copy()
    while len(r):
        to = (textnum.mix(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + probe) % np.uint64(size)).astype(np.int64)
        hit = ~empty[r, to]
        filled[r[hit], c[hit]] = code[r[hit], to[hit]]
        r, c = r[~hit], c[~hit]
        probe += np.uint64(1)
    return filled


def band_keys(code: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    c = code.reshape(len(code), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(textnum.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(code), BANDS))
    for k in range(ROWS):
        key = textnum.pair(key, c[:, :, k])
    return key.view(np.int64)


def estimate(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of a sketch and each of some others, and how many registers tell of it.

    It is the share of equal registers among those that either fills, less chance equality of compressed values
    (ln 2 / 4 per mantissa value).
    """
    same, none = others == one, (others == BLANK) & (one == BLANK)
    blank = none.sum(axis=1)
    used = np.maximum(one.size - blank, 1)
    chance = np.log(2) / 4 / (1 << MANTISSA)
    return ((same.sum(axis=1) - blank) / used - chance) / (1 - chance), used


def fair(one: np.ndarray, n: int, others: np.ndarray, m: np.ndarray, bound: float) -> np.ndarray:
    """Which of the others may have a similarity of ``bound``: its estimate lies less than ``DEVIATIONS`` below. n, m: set sizes.

    Registers sample the union without replacement, so the variance falls with the share of the union that they hold.
    """
    guess, used = estimate(one, others)
    union = np.maximum((n + m) / (1 + bound), 1)
    used = np.minimum(used, union)
    deviation = np.sqrt(bound * (1 - bound) / used * np.maximum(1 - used / union, 0.02))
    return guess >= bound - DEVIATIONS * deviation - 0.01


def _summaries(size: int):
    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        code = registers(sets)
        s = [np.array([np.add.reduce(textnum.mix(x ^ np.uint64(seed))) for x in sets], np.uint64).view(np.int64) for seed in (0x1234567, 0x89ABCDEF)]
        cols = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(s[0], pa.int64()), pa.array(s[1], pa.int64()), pa.array([x.tobytes() for x in code], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["id", "n", "s1", "s2", "code"])

    return summarise


def _keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, REGISTERS)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(band_keys(code).ravel())], ["node", "key"])


def _sketches(size: int):
    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        code = registers(sets, SKETCH, fill=False)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in code], pa.binary()), pa.array([len(x) for x in sets], pa.int64())], ["node", "text", "code", "sketch", "n"])

    return sketch


def _rows(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def _verifier(size: int, percent: int):
    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, ta, tb = (batch.column(k) for k in range(4))
        good, far = [], []
        for x, y in zip(shingle_sets(ta, size), shingle_sets(tb, size), strict=True):
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            good.append(100 * common >= percent * (len(both) - common))
            far.append(1 - common / max(len(both) - common, 1))
        return pa.RecordBatch.from_arrays([a, b, pa.array(good, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "good", "far"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, good (similar enough), far (Jaccard distance) of pairs of nodes, on the full sets of their texts."""
    t = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias("text" + s))
    x = pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "texta", "textb")
    return arrow_map(x, _verifier(size, percent), "a bigint, b bigint, good boolean, far double", 2, 2 << 20)


def _block_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of the two sides of a bucket's block, or of one side of each of some small buckets, that are in different
    components and have a fair estimate. A pair that meets in several bands counts in the first."""
    rows = rows.sort_values(["key", "node"], kind="stable")
    side, key = rows["side"].to_numpy(), rows["key"].to_numpy()
    node, comp = rows["node"].to_numpy(), rows["comp"].to_numpy()
    n = rows["n"].to_numpy()
    sketch, bands = _rows(rows["sketch"], SKETCH), band_keys(_rows(rows["code"], REGISTERS))
    two = rows["ci"].iloc[0] != rows["cj"].iloc[0]
    lead, far, bound = rows["lead"].to_numpy(), rows["far"].to_numpy(), rows["bound"].to_numpy()
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, end in zip(heads.tolist(), np.append(heads[1:], len(key)).tolist(), strict=True):
        own = np.arange(at, end)
        others = own[side[own] == 1] if two else own
        for i in own[side[own] == 0] if two else own:
            j = others[comp[others] != comp[i]]
            if not two:
                j = j[j > i]
            if lead[i] >= 0:  # with one leader, distances that differ too much rule a link out
                j = j[(lead[j] != lead[i]) | (np.abs(far[j] - far[i]) <= bound[i])]
            j = j[fair(sketch[i], n[i], sketch[j], n[j], 1 - bound[i])] if len(j) else j
            if len(j):
                meet = bands[j] == bands[i]
                j = j[bands[i][meet.argmax(axis=1)] == key[i]]
                left.append(np.full(len(j), node[i]))
                right.append(node[j])
    return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of ``docs`` (integer ids)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sums = written(arrow_map(rows, _summaries(size), "id bigint, n bigint, s1 bigint, s2 bigint, code binary", 1), "near-sums")
    # equal sets have equal registers, so any row's will do
    sets = written(sums.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("node"), F.first("code").alias("code")), "near-sets")
    nodes = sets.select("node", "code")
    placed_rows = written(sums.select("id", "n", "s1", "s2").join(sets.select("s1", "s2", "node"), ["s1", "s2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")), "near-rows")
    # an id with several texts links their nodes
    several = placed_rows.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b < c").select("id", "b")
    own = placed_rows.join(several, "id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()

    # buckets of more than one node, led by the node that meets most others
    keys = arrow_map(nodes, _keys, "node bigint, key bigint", 1, 1 << 20)
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = written(keys.join(shared, "key"), "near-members")
    degree = written(members.groupBy("node").agg(F.sum(F.col("m") - 1).alias("degree")), "near-degrees")
    leads = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", -F.col("node"))).alias("x")).select("key", (-F.col("x")["col2"]).alias("lead"))
    near = degree.select(F.col("node").alias("near_node"))
    texts = rows.join(near, rows.id == F.col("near_node"), "left_semi").distinct().join(nodes, F.col("id") == F.col("node")).select("node", "text", "code")
    texts = written(arrow_map(texts, _sketches(size), "node bigint, text string, code binary, sketch binary, n bigint", 1, 1 << 20), "near-texts")

    # one leader a node
    best = members.join(leads, "key").where("node <> lead").groupBy("node", "lead").count().groupBy("node").agg(F.max(F.struct("count", -F.col("lead"))).alias("x"))
    tried = written(_verified(best.select(F.col("node").alias("a"), (-F.col("x")["col2"]).alias("b")), texts, size, percent), "near-tried")
    first = tried.where("good").select("a", "b").distinct()
    comps = written(components(first), "near-comps")
    # a node's leader and distance from it; a leader is its own. With several texts under one id nothing is known
    known = tried.select(F.col("a").alias("node"), F.col("b").alias("lead"), "far", F.lit(0).alias("own")).unionByName(tried.select(F.col("b").alias("node"), F.col("b").alias("lead"), F.lit(0.0).alias("far"), F.lit(1).alias("own")).distinct())
    known = known.groupBy("node").agg(F.max(F.struct("own", "lead", "far")).alias("x"), F.count("*").alias("c"), F.max("own").alias("leads"))
    known = known.join(texts.groupBy("node").agg(F.count("*").alias("texts")), "node").select("node", F.when((F.col("texts") == 1) & (F.col("c") <= 1 + F.col("leads")), F.col("x.lead")).alias("lead"), F.col("x.far").alias("far"))

    # buckets that still hold several components
    placed = members.join(comps, "node", "left").select("key", "node", "m", F.coalesce("comp", "node").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    still = written(placed.join(open_keys, "key"), "near-open")
    slots = still.count() // SMALL_ROWS + 1
    parts = F.ceil(F.col("m") / block).cast("int")
    still = still.withColumn("g", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    still = still.withColumn("slot", F.when(F.col("g") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(slots))))
    still = still.join(known, "node", "left").withColumn("lead", F.coalesce("lead", F.lit(-1))).withColumn("far", F.coalesce("far", F.lit(0.0)))
    dealt = still.join(texts.select("node", "code", "sketch", "n"), "node").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("g", "slot", "key", "node", "comp", "code", "sketch", "n", "lead", "far", F.lit(1 - percent / 100 + 1e-9).alias("bound"), F.least("own", "c").alias("ci"), F.greatest("own", "c").alias("cj"), (F.col("own") > F.col("c")).cast("int").alias("side"))
    pairs = dealt.groupBy("g", "slot", "ci", "cj").applyInPandas(_block_pairs, "a bigint, b bigint").distinct()
    more = written(_verified(written(pairs, "near-pairs"), texts, size, percent).where("good").select("a", "b").distinct(), "near-links")
    comps = written(components(first.unionByName(more).unionByName(own)), "near-comps")

    out = placed_rows.join(comps, "node", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "node", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), size=2).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g FROM d, unnest(range(1, greatest(len(ws), 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT k, min(doc_id) AS r FROM sig GROUP BY k),
rs AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id) WHERE s.doc_id IN (SELECT r FROM rep)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
w(a, b) AS (SELECT r, r FROM rep UNION SELECT w.a, e.y FROM w JOIN e ON w.b = e.x),
c AS (SELECT a AS r, min(b) AS comp FROM w GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN rep USING (k) LEFT JOIN c ON c.r = rep.r
"""
