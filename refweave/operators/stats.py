"""Counts, histograms, quartiles, correlations and model reports: the figures behind every chart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared


def paper_counts(bib: DataFrame, ref: DataFrame) -> DataFrame:
    """(paper_id, n_bib, n_ref), with zero where a side has none."""
    of = lambda df, n: df.groupBy("paper_id").agg(F.count(F.lit(1)).alias(n))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return of(bib, "n_bib").join(of(ref, "n_ref"), "paper_id", "full_outer").select("paper_id", zero("n_bib"), zero("n_ref"))


def parsing_summary(counts: DataFrame) -> DataFrame:
    """Papers, totals, papers that lack a side, papers with both."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_papers"), F.coalesce(F.sum("n_bib"), F.lit(0)).alias("n_bib"),
        F.coalesce(F.sum("n_ref"), F.lit(0)).alias("n_ref"), F.count_if(F.col("n_bib") == 0).alias("no_bib"),
        F.count_if(F.col("n_ref") == 0).alias("no_ref"), F.count_if((F.col("n_bib") > 0) & (F.col("n_ref") > 0)).alias("has_both"),
    )


def lacking(counts: DataFrame, side: str) -> DataFrame:
    return counts.where(F.col(side) == 0).select("paper_id").orderBy("paper_id")


def top_papers(counts: DataFrame, by: str, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc(by), "paper_id").limit(n)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("label", F.lit(0)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, value: Column, bins: int | None = 50, by: str | None = None, most: int = 50) -> DataFrame:
    """(by, bin, lower, n) in bins of equal width over all rows' range; the top edge belongs to the last bin.

    bins=None: as many as there are different values, `most` at most. Equal values are counted first, and these counts are
    kept in the shared folder, so that `rows` are computed once.
    """
    keys = [by] if by else []
    counted = shared(rows.select(*keys, value.cast("double").alias("x")).where("x is not null").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")), "histogram")
    lo, hi, different = counted.agg(F.min("x"), F.max("x"), F.count_distinct("x")).first()  # three numbers
    bins = bins or max(1, min(most, different))
    width = ((hi or 0.0) - (lo or 0.0)) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(lo)) / width)) if width else F.lit(0)
    placed = counted.withColumn("bin", at.cast("int"))
    return placed.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).select(*keys, "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), "n")


def known_gaps(rows: DataFrame) -> DataFrame:
    """Rows whose two years are known: a gap of 100 stands for a missing one (fixed value)."""
    return rows.where("year_diff < 100")


def feature_histograms(rows: DataFrame, names: tuple[str, ...] = ("score", "levenshtein", "jaccard", "year_diff")) -> dict[str, DataFrame]:
    """A histogram a feature; gaps of years without the missing ones."""
    return {n: histogram(known_gaps(rows) if n == "year_diff" else rows, F.col(n)) for n in names}


def rank_histogram(ranks: DataFrame) -> DataFrame:
    """Reciprocal ranks in 20 bins (fixed value)."""
    return histogram(ranks, F.col("rr"), 20)


def processing_summary(total: DataFrame, skipped: DataFrame) -> DataFrame:
    """(category, n): all papers, those processed, those skipped."""
    every = total.select(F.lit(0).alias("s")).union(skipped.select(F.lit(1).alias("s")))
    n = every.agg(F.count_if(F.col("s") == 0).alias("total"), F.count_if(F.col("s") == 1).alias("skipped"))
    lines = [("Total", F.col("total")), ("Processed", F.col("total") - F.col("skipped")), ("Skipped", F.col("skipped"))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("n")) for k, v in lines])).alias("x")).select("x.*")


def parsing_figures(counts: DataFrame) -> dict[str, DataFrame]:
    """What is shown of parsed papers: distributions, largest papers, papers that lack a side, totals."""
    sides = {"bib": "n_bib", "ref": "n_ref"}
    return {f"distribution_{k}": histogram(counts, F.col(c), None) for k, c in sides.items()} | {f"top_{k}": top_papers(counts, c) for k, c in sides.items()} | {f"no_{k}": lacking(counts, c) for k, c in sides.items()} | {"summary": parsing_summary(counts)}


def matching_figures(rows: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    """What is shown of matched pairs: labels, features, splits, scores by label, correlations."""
    features = ["score", "levenshtein", "jaccard", "year_diff", "year_match"]
    return {
        "labels": label_counts(rows), **{f"feature_{n}": h for n, h in feature_histograms(rows).items()}, "splits": split.groupBy("partition").agg(F.count(F.lit(1)).alias("n")),
        "score_by_label": histogram(rows, F.col("score"), by="label"), "quartiles": quartiles(rows, "score", "label"), "correlations": correlations(rows, features, order=("paper_id", "bib_key", "cand_id")),
    }


def performance_figures(predicted: DataFrame, ranks: DataFrame, importance: DataFrame) -> dict[str, DataFrame]:
    """What is shown of a model: confusion, report, importance, distribution of reciprocal ranks."""
    return {"confusion": confusion(predicted), "report": class_report(predicted), "importance": importance, "ranks": rank_histogram(ranks)}


def parsing_report(counts: DataFrame, top: int = 5) -> list[str]:
    """The lines that a console shows of parsed papers; `top` papers a list at most are collected."""
    s = parsing_summary(counts).first()
    lines = [
        "PARSING STATISTICS", f"Total papers seen: {s['n_papers']}", f"Total bibitems: {s['n_bib']:,}", f"Total references: {s['n_ref']:,}",
        f"Papers with no bibitems: {s['no_bib']}", f"Papers with no references: {s['no_ref']}",
    ]
    for side, name in (("n_bib", "bibitems"), ("n_ref", "references")):
        missing = [r["paper_id"] for r in lacking(counts, side).limit(top).collect()]
        lines += [f"Example papers missing {name}: {', '.join(missing)}"] * bool(missing)
    for side, name in (("n_bib", "bibitems"), ("n_ref", "references")):
        lines += [f"Top {top} papers by {name} count:", *(f"  {r['paper_id']}: {r[side]:,}" for r in top_papers(counts, side, top).collect())]
    return lines


def quartiles(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Equal values are counted first."""
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("q")).select(by, *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, null where a column is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(rows: DataFrame, columns: list[str], first: int | None = 10_000, order: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, r) of every pair of columns, over the first rows in `order`, complete pairs only."""
    some = rows.select(*columns, *order).orderBy(*order).limit(first) if first else rows
    pairs = [(a, b) for a in columns for b in columns]
    both = lambda a, b: (F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    one = some.agg(*[correlation(*both(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of labels 0 and 1, accuracy, macro and weighted averages."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    cell = {(i, j): F.count_if((F.col("label") == i) & (F.col("prediction") == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)}
    c = rows.agg(*cell.values())
    n = {(i, j): F.col(f"c{i}{j}") for i, j in cell}
    scores = []
    for i in (0, 1):
        p, r = safe(n[i, i], n[0, i] + n[1, i]), safe(n[i, i], n[i, 0] + n[i, 1])
        scores.append((p, r, safe(2 * p * r, p + r), n[i, 0] + n[i, 1]))
    total = scores[0][3] + scores[1][3]
    right = safe(n[0, 0] + n[1, 1], total)
    macro = [(scores[0][k] + scores[1][k]) / 2 for k in range(3)]
    weighted = [safe(scores[0][k] * scores[0][3] + scores[1][k] * scores[1][3], total) for k in range(3)]
    lines = [("0", *scores[0]), ("1", *scores[1]), ("accuracy", right, right, right, total), ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    made = [F.struct(F.lit(k).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support")) for k, p, r, f, s in lines]
    return c.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def samples(rows: DataFrame, n: int = 5, order: tuple[str, ...] = ("paper_id", "ord")) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def child_order(edges: DataFrame, root: str) -> DataFrame:
    """(child, parent, depth, path) of (child, parent) edges, level by level from `root`; siblings by id.

    Each level is one join; a child that was met before keeps its first parent, so that cycles end.
    """
    level = edges.where(F.col("parent") == root).select("child", "parent", F.lit(1).alias("depth"), F.array("child").alias("path"))
    met = [level]
    while not level.isEmpty():
        down = edges.join(level.select(F.col("child").alias("parent"), F.col("path").alias("_p")), "parent").select("child", "parent", F.lit(len(met) + 1).alias("depth"), F.concat("_p", F.array("child")).alias("path"))
        seen = reduce(DataFrame.unionByName, met).select("child")
        level = down.join(seen, "child", "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy("child").orderBy("path"))).where("_n = 1").drop("_n")
        level = shared(level, "level")
        met.append(level)
    return reduce(DataFrame.unionByName, met)
