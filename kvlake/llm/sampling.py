"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_class(rows: DataFrame, label: str, most: int, by: Column) -> DataFrame:
    """``most`` rows of each class at most, chosen by the hash of ``by``, so that reruns agree; classes below ``most`` come whole.

    ``rows`` should be distinct in ``by``, or rows that repeat fall in or out together; the bound holds in any case. The
    classes' counts come to the driver: one row a class.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    share = F.when(F.lit(False), 0.0)  # one flat case, however many classes
    for value, n in counts.items():
        share = share.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n)))
    share = share.otherwise(0.0)
    hashed = F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(1 << 20))
    # the hash alone leaves about ``most`` of a class; the window sees no more than those
    thin = rows.where(hashed < share * (1 << 20))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hashed, by))
    return thin.withColumn("sample_rank", rank).where(F.col("sample_rank") <= most).drop("sample_rank")


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """text and label of ``most`` labelled documents of each class 0 and 1 at most, and the classes' counts in ``labels``.

    The sample of ids is broadcast: its size is bounded by ``most``, whatever the size of either table.
    """
    labels = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and label_id is not null").distinct()
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    known = F.broadcast(per_class(labels, "label", most, F.col("label_id")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("label_id")).select("text", "label")
    return rows, counts
