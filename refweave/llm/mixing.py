"""Mixing sources to target weights with DataFrame operations only.

Tokens are aggregated per source, repetition rates follow from the targets, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy whose probability is the fraction.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows that repeat a
doc_id get the same draw; a null doc_id draws as the empty string; an empty table gives an empty mix; further columns
pass through `mix` unless they bear the name of a column that it adds, which then replaces them. Of a very long text only
its number of words is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, materialize, private, text_of

#: Weights in turn over the sources in code point order, share of all sizes to give out, most repeats (fixed values).
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Capped shares are found in one pass: in order of cap / weight, the first k sources are capped, where k is the least
    with level(k) = (budget - their caps) / (weight of the rest) not above the next source's cap / weight. The windows
    run over one row a source in one task: sources are named parts of a corpus, not hosts or pages.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    one = Window.partitionBy()
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("n", F.row_number().over(by_name)).withColumn("w", F.get(turn, (F.col("n") - 1) % len(weights)))
    per = per.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("budget", F.sum("source_size").over(one) * (share_percent / 100.0))
    order = one.orderBy(F.col("cap") / F.col("w"), "n")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("caps_before", F.sum("cap").over(upto) - F.col("cap")).withColumn("w_rest", F.sum("w").over(one) - F.sum("w").over(upto) + F.col("w"))
    per = per.withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("w_rest"))
    per = per.withColumn("k", F.row_number().over(order))
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("k", "level"))).over(one)
    per = per.withColumn("lambda", fits["level"])
    target = F.when(F.col("lambda").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("lambda")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and doc_id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, text: str = "text", seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target, copies, taken; rows with copies 0 stay, so that nothing is hidden."""
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    r, s = private(docs, "_rate"), private(docs, "_source")
    sizes = docs.select(F.col("source").cast("string").alias("source"), n_tokens(text_of(text)).alias("size"))
    # One row a source, written first: Spark broadcasts it only if its file is below the threshold.
    rates = materialize(source_rates(sizes), "mix-rates").withColumnsRenamed({"source": s, "rate": r})
    sized = docs.withColumn("size", n_tokens(text_of(text)))
    out = sized.join(rates, F.col("source").cast("string").eqNullSafe(F.col(s)), "left").drop(s)
    whole = F.floor(r)
    copies = (whole + (draw(F.col("doc_id"), seed) < F.col(r) - whole).cast("long")).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop(r)


def repeat(mixed: DataFrame) -> DataFrame:
    """One row a copy."""
    n = private(mixed, "_n")
    return mixed.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop(n)
