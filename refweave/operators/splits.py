"""Splits by paper, and the truth and predictions kept for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paper_rows(rows: DataFrame) -> DataFrame:
    """(paper_id, n_rows) over rows with all three ids."""
    return rows.where("paper_id <> '' and bib_key <> '' and cand_id <> ''").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_rows"))


def split_map(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """(paper_id, partition): test takes the largest manual and the largest other paper, val the next ones, train the rest.

    The ranks run over one row a paper and keep two a kind, so the sort stays small wherever it runs.
    """
    sizes = paper_rows(rows).join(manual.select("paper_id").distinct().withColumn("is_manual", F.lit(1)), "paper_id", "left").withColumn("is_manual", F.coalesce("is_manual", F.lit(0)))
    order = Window.partitionBy("is_manual").orderBy(F.desc("n_rows"), "paper_id")
    top = sizes.withColumn("n", F.row_number().over(order)).where("n <= 2").select("paper_id", F.when(F.col("n") == 1, "test").otherwise("val").alias("partition"))
    return sizes.select("paper_id").join(top, "paper_id", "left").withColumn("partition", F.coalesce("partition", F.lit("train")))


def fixed_split_map(rows: DataFrame, test: list[str], val: list[str]) -> DataFrame:
    where = F.when(F.col("paper_id").isin(test), "test").when(F.col("paper_id").isin(val), "val").otherwise("train")
    return paper_rows(rows).select("paper_id", where.alias("partition"))


def with_partition(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.where("paper_id <> '' and bib_key <> '' and cand_id <> ''").join(parts, "paper_id")


def split_report(split: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(partition, n_rows, n_papers, target_rows): what a share of all rows would be, beside what there is."""
    counted = split.groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("paper_id").alias("n_papers"))
    rest = 1 - sum(shares.values())
    share = F.when(F.col("partition") == "test", shares.get("test", 0.0)).when(F.col("partition") == "val", shares.get("val", 0.0)).otherwise(rest)
    return counted.withColumn("target_rows", F.floor(F.sum("n_rows").over(Window.partitionBy()) * share).cast("long"))


def append_manual(split: DataFrame, manual_rows: DataFrame, parts: DataFrame, duplicate: bool = False) -> DataFrame:
    """Manual rows belong to the split once; duplicate=True appends them again."""
    return split.unionByName(with_partition(manual_rows, parts), allowMissingColumns=True) if duplicate else split


def ground_truth(split: DataFrame) -> DataFrame:
    """(paper_id, bib_key, cand_id): the best positive of each key by score, Levenshtein, Jaccard."""
    best = F.max_by("cand_id", F.struct("score", "levenshtein", "jaccard", "cand_id"))
    return split.where("label = 1").groupBy("paper_id", "bib_key").agg(best.alias("cand_id"))


def predictions_file(split: DataFrame) -> DataFrame:
    """(paper_id, partition, groundtruth, prediction): maps by key; predictions are empty lists."""
    truth = ground_truth(split)
    entries = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("bib_key", v))))
    maps = truth.groupBy("paper_id").agg(entries(F.col("cand_id")).alias("groundtruth"), entries(F.array().cast("array<string>").alias("p")).alias("prediction"))
    return split.select("paper_id", "partition").distinct().join(maps, "paper_id", "left")
