"""Caps, negatives and training samples; what is drawn depends on a hash of seed and ids only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *ids: str) -> Column:
    """A hash that SQL engines share."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))


def cap_per_paper(rows: DataFrame, most: int | None, seed: int, key: str) -> DataFrame:
    """At most `most` rows a paper, drawn without replacement."""
    if most is None:
        return rows
    order = Window.partitionBy("paper_id").orderBy(draw(seed, key), "ord")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def negatives(pairs: DataFrame, number: int | None, kind: str = "hard", seed: int = 0) -> DataFrame:
    """All pairs with label 1, and of the others `number` a key (None: all): the best by score, or drawn at random."""
    if number is None:
        return pairs
    by = [F.desc("score"), "r_ord", "b_ord"] if kind == "hard" else [draw(seed, "paper_id", "bib_key", "cand_id"), "r_ord", "b_ord"]
    order = Window.partitionBy("paper_id", "bib_key", "label").orderBy(*by)
    ranked = pairs.where("label in (0, 1)").withColumn("_n", F.row_number().over(order))  # one pass over the scored pairs
    return ranked.where((F.col("label") == 1) | (F.col("_n") <= number)).drop("_n")


def training_sample(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """All positives, and negatives drawn until there are `size` rows."""
    good = rows.where("label = 1")
    room = max(0, size - good.count())
    return good.unionByName(rows.where("label = 0").orderBy(draw(seed, "paper_id", "bib_key", "cand_id"), "paper_id", "bib_key", "cand_id").limit(room))
