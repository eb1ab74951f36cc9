"""The three stages end to end: parse, match and split, train and predict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import build_text
from ..operators import matching, model, ranking, splits
from ..operators.shared import shared
from ..schemas import Settings
from ..sources import bibtex, papers


def parse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """parsed (one row a paper), bibitems, references, skipped (paper_id, error).

    Papers without a tex folder give rows, too: those of their refs.bib. Papers are parsed once, into the shared folder.
    """
    files = papers.paper_files(spark, root)
    parsed = shared(papers.parse_papers(files), "parsed")
    untold = files.where("path = 'refs.bib' and version is null").join(files.where("version is not null").select("paper_id").distinct(), "paper_id", "left_anti")
    texts = parsed.where("refs_bib is not null").select("paper_id", F.col("refs_bib").alias("content")).unionByName(untold.select("paper_id", F.col("content").cast("string").alias("content")))
    return {
        "parsed": parsed,
        "bibitems": papers.postprocess_tokens(papers.bibitem_rows(bibtex.parse_bib(texts))),
        "references": papers.postprocess_tokens(papers.reference_rows(files.where("path = 'references.json'"))),
        "skipped": parsed.where("error is not null").select("paper_id", "error"),
    }


def with_text(rows: DataFrame) -> DataFrame:
    title = F.col("title") if "title" in rows.columns else F.lit("")
    return rows.withColumn("text", build_text(F.col("title_tokens"), F.col("author_tokens"), F.col("authors_norm"), title, F.col("note_norm"), F.col("year")))


def match(bib: DataFrame, ref: DataFrame, manual: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The split table: manual positives, and automatic pairs of all other papers, with `partition`."""
    settings = settings or Settings()
    auto = lambda df: df.join(manual.select("paper_id").distinct(), "paper_id", "left_anti")
    found = matching.matches(auto(bib), auto(ref), settings)
    by_hand = matching.with_features(matching.manual_positives(manual, bib, ref), bib, ref)
    rows = found.unionByName(by_hand.select(*found.columns))
    parts = splits.split_map(rows, manual)
    return splits.append_manual(splits.with_partition(rows, parts), by_hand, parts, settings.duplicate_manual)


def train(split: DataFrame, params: model.Params | None = None, trials: int = 0) -> dict[str, object]:
    """model, report and confusion on test, mrr, predictions."""
    part = lambda p: split.where(F.col("partition") == p)
    if trials:
        params, _ = model.search(part("train"), part("val"), trials)
    fitted = model.fit(part("train").unionByName(part("val")), params)
    test = shared(model.predict(fitted, part("test")), "predicted")
    report, confusion = model.evaluate(test)
    truth = splits.ground_truth(part("test")).withColumnRenamed("cand_id", "truth")
    stored = splits.predictions_file(split)
    return {
        "model": fitted, "report": report, "confusion": confusion, "mrr": ranking.mrr(ranking.reciprocal_ranks(test, truth, "proba")),
        "predictions": ranking.update_predictions(stored, test, "proba", truth), "importance": model.importance(fitted),
    }
