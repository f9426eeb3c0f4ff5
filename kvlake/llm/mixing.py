"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words; the ratio of target to size says how many copies of a document the mix
holds on average. Its whole part is allocated as certain copies. The rest is an unequal-probability sample:
a document with inclusion probability p and a uniform u ranks at ``(u / (1 - u)) / (p / (1 - p))`` (Rosen's
Pareto order sampling) and the source takes documents in rank order up to the fixed size in words that is
still open. The cut is found by two histograms of the ranks, so no task ever sorts a whole source; a source with
nothing open (one at its bound) has no cut. Rows of one rank (null or repeated ids) are cut in ``TIES`` parts by their
text's hash, one after the other, and rows of one text in as many by their place in the input: only rows that don't differ
change places between reruns. The windows over sources run over one row a source in one task.

Defined results: null texts have size 0 and are never repeated in words; a null source is a source of its
own, last in order; sources of size 0 have target 0; rows that repeat an id have the same rank and are cut one
after the other, in an order that their texts decide; extra columns of the input are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.llm.common import table, written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST_COPIES, BINS, TIES = (1, 2, 3), 3, 4096, 256


def uniform(id_text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    return (F.conv(F.substring(F.md5(F.concat(id_text, F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row a source: source, source_size, target. The weights repeat over the sources in code point order.

    Water-filling: sources in order of ``most * size / weight`` reach their bound one after the other; the first
    that doesn't gives the level for all after it. The windows run over one row a source, not over documents.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("long"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_bound = Window.orderBy(F.col("source_size") * most / F.col("w"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("open_size", F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
    s = s.withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("bound", F.col("w") * F.col("open_size") > F.col("source_size") * most * F.col("open_w"))
    level = lambda c: F.min(F.when(~F.col("bound"), F.struct(F.col("source_size") * most / F.col("w"), F.col("open_w") * -1, c))).over(every)[c]
    s = s.withColumn("level_size", level("open_size")).withColumn("level_w", level("open_w"))
    target = F.when(F.col("bound"), (F.col("source_size") * most).cast("double")).otherwise((F.col("w") * F.col("level_size")).cast("double") / F.col("level_w"))
    return s.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix-1") -> DataFrame:
    """One row a document: id, source, size, source_size, target, copies (0 to ``most``), taken = size * copies."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("hash"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TIES)).alias("salt"))
    sized = sized.withColumn("tie", F.pmod(F.xxhash64("hash"), F.lit(TIES)))
    sized = written(sized, "mix-sizes")
    sources = written(source_targets(sized, weights, most), "mix-sources").withColumnRenamed("source", "s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    p = F.col("ratio") - F.col("certain")
    u = uniform(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    x = sized.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("ratio", ratio)
    x = x.withColumn("certain", F.floor("ratio")).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    # the rank as a number below 1: q / (1 + q) for q = (u / (1 - u)) / (p / (1 - p))
    x = x.withColumn("u", u).withColumn("rank", F.when(p > 0, F.col("u") * (1 - p) / (F.col("u") * (1 - p) + (1 - F.col("u")) * p)).otherwise(F.lit(1.0)))
    x = x.withColumn("bin", F.least(F.floor(F.col("rank") * BINS * BINS), F.lit(BINS * BINS - 1)))
    x = x.withColumn("coarse", F.floor(F.col("bin") / BINS)).drop("u", "ratio")

    # where each source's running size crosses what is still open: first among coarse bins, then among the fine ones of that bin
    def crossing(counted: DataFrame, key: str, start: Column) -> DataFrame:
        run = F.sum("words").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("upto", start + run)
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct(key, F.col("upto") - F.col("words"))))
        return counted.groupBy("source").agg(first.alias("c"))

    coarse = crossing(x.where("rest > 0").groupBy("source", "rest", "coarse").agg(F.sum("size").alias("words")), "coarse", F.lit(0))
    coarse = coarse.select(F.col("source").alias("s"), F.col("c.coarse").alias("cut"), F.col("c.col2").alias("before")).where("cut is not null")
    inside = x.join(coarse, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("cut"))).drop("s")
    fine = crossing(inside.groupBy("source", "rest", "bin", "before").agg(F.sum("size").alias("words")), "bin", F.col("before"))
    cuts = written(fine.select(F.col("source").alias("s"), F.col("c.bin").alias("cut"), F.col("c.col2").alias("before")), "mix-cuts")

    x = x.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    clear = F.col("cut").isNull() | (F.col("bin") != F.col("cut"))
    # a document on the border is taken if that brings the sum nearer to the target. Sums run over parts of the rows of one rank
    # and id, then over equal texts and their salts in each part, then over rows that don't differ
    def ahead(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
        groups = rows.groupBy(*by, *order).agg(F.sum("size").alias("total"))
        before = F.sum("total").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        groups = groups.select(*[F.col(c).alias("part_" + c) for c in by + order], F.coalesce(before, F.lit(0)).alias(name))
        same = F.lit(True)
        for c in by + order:
            same &= F.col(c).eqNullSafe(F.col("part_" + c))
        return rows.join(groups, same).select(*rows.columns, name)

    edge, one, cell = written(x.where(~clear), "mix-edge"), ["source", "rank", "id", "tie"], ["size", "hash", "salt"]
    edge = ahead(ahead(edge, one[:1], one[1:], "parts"), one, cell, "cells")
    own = F.sum("size").over(Window.partitionBy(*one, *cell).orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", F.col("before") + F.col("parts") + F.col("cells") + own - F.col("size") / 2 <= F.col("rest"))
    edge = edge.select(*x.columns, "extra")
    sure = x.where(clear).withColumn("extra", F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    out = sure.unionByName(edge)
    copies = (F.col("certain") + (F.col("extra") & (F.col("certain") < most) & (F.col("rest") > 0)).cast("long")).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix-1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS open_size, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_w
      FROM w WINDOW b AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * open_size > 3 * source_size * open_w AS bound FROM o),
l AS (SELECT open_size AS ls, open_w AS lw FROM f WHERE NOT bound ORDER BY 3 * source_size / w, source ASC NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN bound THEN (3 * source_size)::DOUBLE ELSE (w * (SELECT ls FROM l))::DOUBLE / (SELECT lw FROM l)::DOUBLE END AS target FROM f),
r AS (SELECT d.*, t.source_size, t.target, floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS certain,
        (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) - floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS p
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - certain * source_size AS rest, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE 1.0 END AS rank FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM q),
k AS (SELECT *, (certain + (CASE WHEN run - size / 2 <= rest AND certain < 3 AND rest > 0 THEN 1 ELSE 0 END))::INTEGER AS copies FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM k
"""
