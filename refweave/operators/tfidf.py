"""Term weights and cosine similarity in SQL: raw counts x (ln((1 + n) / (1 + df)) + 1), rows of unit length."""

from __future__ import annotations

from typing import Iterator  # the name that Spark looks for

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms


def weights(entries: DataFrame, text: str = "text", scope: str = "paper", fitted_on: DataFrame | None = None) -> DataFrame:
    """(paper_id, side, ord, term, weight) of entries (paper_id, side, ord, text).

    scope 'paper': fitted in each paper; 'split': once over `fitted_on` (all entries if none), unseen terms ignored.
    """
    if scope == "paper" and fitted_on is None:
        return of_papers(entries, text)
    fit = ["paper_id"] if scope == "paper" else []
    base = entries if fitted_on is None else fitted_on
    of = lambda e: e.select("paper_id", "side", "ord", F.explode(terms(F.col(text))).alias("term")).groupBy("paper_id", "side", "ord", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = of(entries)
    df = (tf if fitted_on is None else of(fitted_on)).groupBy(*fit, "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df, [*fit, "term"])
    if fit:
        weighed = weighed.join(base.groupBy(*fit).agg(F.count(F.lit(1)).alias("n")), fit)
    else:
        weighed = weighed.withColumn("n", F.lit(base.count()))  # one number
    weighed = weighed.withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("paper_id", "side", "ord")))
    return weighed.select("paper_id", "side", "ord", "term", (F.col("w") / norm).alias("weight"))


def of_papers(entries: DataFrame, text: str = "text") -> DataFrame:
    """weights() fitted in each paper: entries are dealt by paper once, and terms come, are counted and weighed where they are."""
    over = lambda *keys: Window.partitionBy("paper_id", *keys)
    dealt = entries.where("paper_id is not null").select("paper_id", "side", "ord", F.col(text).alias("_t")).repartition("paper_id")
    dealt = dealt.withColumn("n", F.count(F.lit(1)).over(over()))
    tf = dealt.select("paper_id", "side", "ord", "n", F.explode(terms(F.col("_t"))).alias("term")).groupBy("paper_id", "side", "ord", "term", "n").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.withColumn("df", F.count(F.lit(1)).over(over("term")))
    weighed = df.withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(over("side", "ord")))
    return weighed.select("paper_id", "side", "ord", "term", (F.col("w") / norm).alias("weight"))


def vectors(weighed: DataFrame) -> DataFrame:
    """(paper_id, side, ord, vector) of entries with a term: their (term, weight) in the terms' order."""
    return weighed.groupBy("paper_id", "side", "ord").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("vector"))


#: Products and pairs that a paper's function holds at once.
HELD = 500_000


def cosines(weighed: DataFrame) -> DataFrame:
    """(paper_id, side, ord, pos, cosines) of entries with a term: an entry's place on its side, from 0, and for side b its
    cosine with each entry of side r, by place."""

    def paper_cosines(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A paper's: each entry of side b meets the r entries of its terms, one term after the other in their order."""
        rows = pa.Table.from_batches(list(batches))
        code = pc.rank(rows["term"].combine_chunks(), tiebreaker="dense").to_numpy() - 1
        is_b, ord_, weight = (pc.equal(rows["side"], "b")).to_numpy(), rows["ord"].to_numpy(), rows["weight"].to_numpy()

        def batch(side: str, ords: np.ndarray, first: int, lists: pa.Array) -> pa.RecordBatch:
            n = len(ords)
            return pa.RecordBatch.from_arrays([pa.repeat(key[0], n), pa.repeat(side, n), pa.array(ords), pa.array(np.arange(first, first + n, dtype="int32")), lists], ["paper_id", "side", "ord", "pos", "cosines"])

        b_ords, b_at = np.unique(ord_[is_b], return_inverse=True)
        r_ords, r_at = np.unique(ord_[~is_b], return_inverse=True)
        order = np.lexsort((code[is_b], b_at))
        b_at, b_code, b_weight = b_at[order], code[is_b][order], weight[is_b][order]
        order = np.argsort(code[~is_b], kind="stable")
        r_at, r_code, r_weight = r_at[order], code[~is_b][order], weight[~is_b][order]
        start, end = np.searchsorted(r_code, b_code, "left"), np.searchsorted(r_code, b_code, "right")
        width, row = len(r_ords), np.searchsorted(b_at, np.arange(len(b_ords) + 1))
        cost = np.concatenate([[0], np.cumsum(end - start)])[row] + width * np.arange(len(b_ords) + 1)
        at = 0
        while at < len(b_ords):
            to = max(at + 1, int(np.searchsorted(cost, cost[at] + HELD, "right")) - 1)
            part = slice(row[at], row[to])
            n = end[part] - start[part]
            r = np.arange(n.sum()) + np.repeat(start[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            cell = np.repeat((b_at[part] - at) * width, n) + r_at[r]
            cosine = np.bincount(cell, np.repeat(b_weight[part], n) * r_weight[r], (to - at) * width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype="int32") * width), pa.array(cosine.astype("float64", copy=False)))  # of nothing it counts in int
            yield batch("b", b_ords[at:to], at, lists)
            at = to
        if width:
            yield batch("r", r_ords, 0, pa.nulls(width, pa.list_(pa.float64())))

    return weighed.groupBy("paper_id").applyInArrow(paper_cosines, f"paper_id string, side string, ord {weighed.schema['ord'].dataType.simpleString()}, pos int, cosines array<double>")


def product(vector: Column, weight: Column) -> Column:
    """The inner product of a vector and a map of terms to weights: the cosine, as entries are of unit length."""
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.coalesce(F.try_element_at(weight, x["term"]) * x["weight"], F.lit(0.0)))


def cosine(weighed: DataFrame) -> DataFrame:
    """(paper_id, b_ord, r_ord, cosine) of pairs that share a term."""
    side = lambda s: weighed.where(F.col("side") == s).select("paper_id", "term", F.col("ord").alias(f"{s}_ord"), F.col("weight").alias(f"{s}_w"))
    return side("b").join(side("r"), ["paper_id", "term"]).groupBy("paper_id", "b_ord", "r_ord").agg(F.sum(F.col("b_w") * F.col("r_w")).alias("cosine"))
