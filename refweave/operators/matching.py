"""Candidate pairs of a paper, their score, weak labels, negatives and manual positives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import features, jaccard_of_sizes, shared_name, with_ngrams, with_plain_sides, with_sides
from ..functions.text import blank, last_names, norm_arxiv, year_int
from ..schemas import FEATURES, Settings
from .sampling import cap_per_paper, negatives
from .shared import shared
from .tfidf import cosines, weights


def block(bib: DataFrame, ref: DataFrame) -> DataFrame:
    """Every bibliography entry with every reference of its paper; columns come with b_ or r_ in front."""
    named = lambda df, side: df.select("paper_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "paper_id"])
    return named(bib, "b").join(named(ref, "r"), "paper_id")


def exact_id_matches(bib: DataFrame, ref: DataFrame) -> DataFrame:
    """Pairs of a paper whose normalised identifiers are equal and not empty; an equi-join, not the block."""
    b = bib.select("paper_id", F.col("key").alias("bib_key"), norm_arxiv(F.col("arxiv")).alias("norm")).where("norm <> ''")
    r = ref.select("paper_id", F.col("id").alias("cand_id"), norm_arxiv(F.coalesce(F.nullif("arxiv", F.lit("")), "id")).alias("norm"))
    return b.join(r, ["paper_id", "norm"]).select("paper_id", "bib_key", "cand_id")


def score_parts(cos: Column) -> dict[str, Column]:
    gap = F.abs(F.col("b_y") - F.col("r_y"))
    return {
        "base": cos,
        "auth": 0.2 * jaccard_of_sizes(*[F.col(f"{s}_{c}") for c in ("authors_norm", "n_authors") for s in "br"]),
        "year": F.coalesce(0.1 * (gap == 0).cast("int") + 0.05 * (gap <= 1).cast("int"), F.lit(0.0)),
        "title_jacc": 0.1 * (jaccard_of_sizes(*[F.col(f"{s}_{c}") for c in ("title_tokens", "n_title") for s in "br"]) >= 0.6).cast("int"),
        "auth_last": 0.2 * shared_name(F.col("b_l"), F.col("r_l")),
    }


def score_pairs(bib: DataFrame, ref: DataFrame, scope: str = "paper", fitted_on: DataFrame | None = None, plain_sides: bool = False) -> DataFrame:
    """(paper_id, b_ord, bib_key, r_ord, cand_id, cosine, score, reason, b_y, r_y) of all pairs; papers without a term have none.

    bib and ref bring `text`, whose terms are weighed. What a side needs, an entry's cosines with its paper's references included,
    is derived once a row and written, before the pairs are made. Pairs come from one join by paper and stay dealt by paper, so
    that what groups or ranks them by paper, or by paper and key, moves none. plain_sides: what features need besides n-grams
    comes along.
    """
    entry = lambda df, s: df.select("paper_id", F.lit(s).alias("side"), "ord", "text")
    weighed = weights(entry(bib, "b").unionByName(entry(ref, "r")), scope=scope, fitted_on=fitted_on)

    def ready(df: DataFrame, side: str, name: str) -> DataFrame:
        made = sided(df, "f", with_plain_sides) if plain_sides else df
        return made.select(
            "paper_id", F.lit(side).alias("side"), "ord", F.col(name).alias("id"), "authors_norm", "title_tokens",
            F.size(F.array_distinct("authors_norm")).alias("n_authors"), F.size(F.array_distinct("title_tokens")).alias("n_title"), year_int(F.col("year")).alias("y"),
            last_names(F.col("authors_norm")).alias("l"), norm_arxiv(F.col("arxiv")).alias("x"), *[c for c in made.columns if c.startswith("f_") and plain_sides],
        )

    entries = ready(bib, "b", "key").unionByName(ready(ref, "r", "id")).where("paper_id is not null")
    entries = shared(entries.join(cosines(weighed), ["paper_id", "side", "ord"], "left"), "entries")
    of = lambda side: entries.where(F.col("side") == side).drop("side")
    with_terms = entries.where("pos is not null").select("paper_id").distinct()
    pairs = block(of("b").join(with_terms, "paper_id", "left_semi"), of("r").drop("cosines"))
    pairs = pairs.withColumn("cosine", F.coalesce(F.get("b_cosines", "r_pos"), F.lit(0.0)))
    parts = score_parts(F.col("cosine"))
    total = sum(parts.values(), F.lit(0.0))
    exact = (F.col("b_x") != "") & (F.col("b_x") == F.col("r_x"))
    said = F.concat_ws("|", *[F.when(v > 0, F.format_string(f"{k}=%.3f", v)) for k, v in parts.items()], F.when(total > 1, F.lit("cap1")))
    return pairs.select(
        "paper_id", "b_ord", F.col("b_id").alias("bib_key"), "r_ord", F.col("r_id").alias("cand_id"), "cosine",
        F.round(F.when(exact, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total)), 4).alias("score"), F.when(exact, F.lit("arxiv_exact")).otherwise(said).alias("reason"),
        "b_y", "r_y", *[c for c in pairs.columns if c.startswith(("b_f_", "r_f_"))],
    )


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs with their rank at their entry: best score first, ties in the references' order."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("paper_id", "b_ord").orderBy(F.desc("score"), "r_ord")))


def label(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.withColumn("label", (F.col("score") >= threshold).cast("int"))


def last_by_id(ref: DataFrame) -> DataFrame:
    """One reference an id: the last."""
    return ref.groupBy("paper_id", "id").agg(F.max_by(F.struct(*[c for c in ref.columns if c not in ("paper_id", "id")]), "ord").alias("s")).select("paper_id", "id", "s.*")


def first_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy("paper_id", key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("paper_id", key)]), "ord").alias("s")).select("paper_id", key, "s.*")


def sided(df: DataFrame, side: str, make: Callable[..., DataFrame] = with_sides) -> DataFrame:
    """`df` with the columns of a side, made of those that it has."""
    none = F.array().cast("array<string>")
    of = lambda c, default: F.col(c) if c in df.columns else default
    return make(df, side, *[of(c, F.lit("")) for c in ("title", "note_norm", "note")], *[of(c, none) for c in ("title_tokens", "authors_norm", "authors")])


def sides(bib: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    titled = lambda df: F.col("title_tokens").isNotNull() if "title_tokens" in df.columns else F.lit(True)
    keep = lambda df, s, key: (made := sided(df, s)).select("paper_id", F.col(key), titled(df).alias(f"{s}_titled"), *[c for c in made.columns if c.startswith(f"{s}_")])
    return keep(bib, "b", "key"), keep(ref, "r", "id")


def block_features(bib: DataFrame, ref: DataFrame, names: tuple[str, ...] = FEATURES, amended: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(paper_id, bib_key, cand_id, features) of every pair of the block, each of its own entry and reference, whatever ids repeat.

    What is null counts as empty. amended: by its name, what becomes of a feature, of the columns of both sides, b_titled and
    r_titled (title_tokens that are not null) among them.
    """
    b, r = sides(bib, ref)
    made = features()
    made |= {n: amend(made[n]) for n, amend in (amended or {}).items()}
    return b.join(r, "paper_id").select("paper_id", F.col("key").alias("bib_key"), F.col("id").alias("cand_id"), *[made[n].alias(n) for n in names])


def scored_features(pairs: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(paper_id, bib_key, cand_id, features) of pairs that score_pairs(plain_sides=True) has made, each of its own rows."""
    made = features("b_f", "r_f")
    return with_ngrams(with_ngrams(pairs, "b_f"), "r_f").select("paper_id", "bib_key", "cand_id", *[made[n].alias(n) for n in names])


def with_features(pairs: DataFrame, bib: DataFrame, ref: DataFrame, names: tuple[str, ...] = FEATURES, few: bool = False, last: bool = True) -> DataFrame:
    """`pairs` (paper_id, bib_key, cand_id, ...) with features: by key, so that entries with equal keys multiply; the
    last reference of an id counts (last=False: each gives a row), and pairs without one go.

    few: the pairs are chosen ones; they are written first, and only entries and references among them get their sides.
    """
    if few:
        pairs = shared(pairs, "pairs")
        bib = bib.join(pairs.select("paper_id", F.col("bib_key").alias("key")), ["paper_id", "key"], "left_semi")
        ref = ref.join(pairs.select("paper_id", F.col("cand_id").alias("id")), ["paper_id", "id"], "left_semi")
    b, r = sides(bib, last_by_id(ref) if last else ref)
    joined = pairs.join(b.withColumnRenamed("key", "bib_key"), ["paper_id", "bib_key"]).join(r.withColumnRenamed("id", "cand_id"), ["paper_id", "cand_id"])
    made = features()
    return joined.select(*[F.col(c) for c in pairs.columns], *[made[n].alias(n) for n in names])


def matches(bib: DataFrame, ref: DataFrame, settings: Settings) -> DataFrame:
    """Positives and chosen negatives of every key with their features: the table matches_fe."""
    every = lambda df, s: df.select("paper_id", F.lit(s).alias("side"), "ord", "text")
    fitted = every(bib, "b").unionByName(every(ref, "r")) if settings.scope == "split" else None
    bib, ref = cap_per_paper(bib, settings.max_bibs, settings.seed, "key"), cap_per_paper(ref, settings.max_refs, settings.seed, "id")
    pairs = score_pairs(bib, ref, settings.scope, fitted).where("bib_key <> '' and cand_id <> ''")
    chosen = negatives(label(pairs, settings.threshold), settings.neg_per_bib, settings.negatives, settings.seed)
    return with_features(chosen.select("paper_id", "bib_key", "cand_id", "score", "label"), bib, ref, few=True)


def manual_positives(manual: DataFrame, bib: DataFrame, ref: DataFrame) -> DataFrame:
    """Rows (paper_id, bib_key, cand_id) that name an entry (the first of a key) and a reference (the first of an id)."""
    b = first_by(bib, "key").select("paper_id", F.col("key").alias("bib_key"))
    r = first_by(ref.withColumn("norm", norm_arxiv(F.coalesce(F.nullif("arxiv", F.lit("")), "id"))), "norm").where(F.col("norm") == norm_arxiv(F.coalesce(F.nullif("id", F.lit("")), "arxiv"))).select("paper_id", "norm")
    found = manual.withColumn("norm", norm_arxiv(F.col("cand_id"))).join(b, ["paper_id", "bib_key"]).join(r, ["paper_id", "norm"])
    return found.select("paper_id", "bib_key", "cand_id", F.lit(1.0).alias("score"), F.lit(1).alias("label"))


def target_papers(manual: DataFrame, bib: DataFrame, start: str | None = None, number: int | None = None) -> DataFrame:
    """Ids of manual papers and of the first `number` others, from `start` on."""
    ids = bib.select("paper_id").where("paper_id <> ''").distinct().join(manual.select("paper_id").distinct(), "paper_id", "left_anti")
    ids = ids if start is None else ids.where(F.col("paper_id") >= start)
    ids = ids if number is None else ids.orderBy("paper_id").limit(number)
    return ids.union(manual.select("paper_id")).distinct()


def of_papers(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids, "paper_id", "left_semi")


def greedy_assignment(pairs: DataFrame, threshold: float) -> DataFrame:
    """One-to-one pairs: the best remaining pair of a paper again and again, by score, entry order, reference order.

    A pair that is the best of both its ends is taken in each round, all papers at once; under a strict order this gives
    the walk's result, and no paper's pairs meet in one task. There are as many rounds as the longest chain of pairs has
    in which each is the better choice of the next one's end: a handful as a rule, as scores over the threshold are few an
    entry. Each round is written, so plans don't grow.
    """
    left = pairs.where((F.col("score") >= threshold) & (blank(F.col("bib_key")) != "") & (blank(F.col("cand_id")) != "")).select("paper_id", "b_ord", "bib_key", "r_ord", "cand_id", "score")
    left, done = shared(left, "pairs"), None
    while True:
        order = [F.desc("score"), "b_ord", "r_ord"]
        by = lambda end: F.row_number().over(Window.partitionBy("paper_id", end).orderBy(*order)) == 1
        taken = left.withColumns({"_b": by("bib_key"), "_r": by("cand_id")}).where("_b and _r").drop("_b", "_r")
        taken = shared(taken, "taken")
        if taken.isEmpty():
            return done if done is not None else taken
        done = taken if done is None else done.unionByName(taken)
        left = left.join(taken.select("paper_id", "bib_key"), ["paper_id", "bib_key"], "left_anti").join(taken.select("paper_id", "cand_id"), ["paper_id", "cand_id"], "left_anti")
        left = shared(left.select(*taken.columns), "left")
