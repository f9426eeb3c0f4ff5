"""A corpus pipeline of five stages: toxicity, line de-duplication, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of documents; a stage that changes texts sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from kvlake.llm.common import fold, fresh, table, written


#: Numbers from here on are no ids but those of rows that have no id to themselves.
OWN_ROW = 1 << 62


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger predicts toxic go. It learns from the labelled documents of its input but a held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    model = toxicity.train(docs, labels)
    out, name = toxicity.tagged(docs, model, text="keep")
    return out.where(F.col(name)["predicted"] == 0).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, short lines too; a document goes if none of its text is left."""
    out, gone = line_dedup.deduplicated(docs, short=True)
    changed = F.size(gone) > 0
    out = out.where(~changed | F.col("text").rlike(r"(?U)\S"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (five words a shingle, similarity 0.8) stays: the one with the smallest doc_id.

    Classes are those of rows. Rows whose doc_id is null or occurs more than once are told apart by a number of their own,
    from id and text, above all ids; of such rows that are equal in both, one stays.
    """
    row, again = fresh(docs, "row_id"), fresh(docs, "repeated_id")
    repeated = written(docs.groupBy(F.col("doc_id").alias(again)).count().where(F.col(again).isNull() | (F.col("count") > 1)).select(again, F.lit(True).alias(again + "_")), "near-repeated")
    if repeated.isEmpty():
        rows = docs.withColumn(row, F.col("doc_id").cast("bigint"))
    else:
        own = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2).bitwiseOR(F.lit(OWN_ROW))
        rows = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated[again]), "left").withColumn(row, F.when(F.col(again + "_"), own).otherwise(F.col("doc_id").cast("bigint")))
    gone = near_dedup.classes(rows, id_col=row).where("not kept").select(F.col("id").alias("gone_id"))
    left = rows.join(gone, rows[row] == gone["gone_id"], "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    return left.where(F.col(row) < OWN_ROW).unionByName(left.where(F.col(row) >= OWN_ROW).dropDuplicates([row])).select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    out, hits = decontaminate.searched(docs, table(spark, sf_dir, "benchmark"), text="clean")
    hit = F.col(hits)["n_hit"] > 0
    return out.withColumn("n_chars", F.when(hit, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's decision for each document: copies taken and words taken, with its source's size and target."""
    return mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("mixing", mix),
]

#: The tagger isn't expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else written(out, f"stage-{name}")
    return docs
