"""Bibliography, reference and manual views derived from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TERM, author_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower(word: F.Column) -> F.Column:
    """Lower case letter by letter, as in the SQL; F.lower makes two of İ, and another letter of Σ at a word's end."""
    return F.lower(F.translate(word, "İΣ", "iσ"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, words, own name, next name, year) of each document."""
    # A title is a document's first words (the rule of the view); the text after them is not taken apart.
    head = F.regexp_extract("text", rf"(?s)^(?:.*?{TERM}+){{1,12}}", 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all(head, F.lit(f"({TERM})"), 1), lower).alias("words"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name"))
    after = part.select((F.col("doc_id") - 1).alias("doc_id"), F.col("name").alias("next_name"))
    return docs.join(orders, "doc_id", "left").join(part, "doc_id", "left").join(after, "doc_id", "left")


def paper_id() -> F.Column:
    return F.concat(F.lit("p"), F.lpad(F.floor(F.col("doc_id") / 40).cast("string"), 5, "0"))


def names(*columns: str) -> F.Column:
    return F.filter(F.array(*columns), lambda a: a.isNotNull())


def entry(df: DataFrame) -> DataFrame:
    """What both sides share: author_tokens, and the text whose terms are weighed."""
    return df.withColumn("author_tokens", author_tokens(F.col("authors_norm"))).withColumn(
        "text", F.concat_ws(" ", F.array_join("title_tokens", " "), F.array_join("authors_norm", " "), F.nullif("year", F.lit(""))),
    )


def bib(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """docs: what documents() gives, where it is at hand."""
    year = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 5 == 0, (F.col("y") + 1).cast("string")).otherwise(F.coalesce(F.col("y").cast("string"), F.lit("")))
    arxiv = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))).otherwise(F.lit(""))
    out = (documents(spark, sf_dir) if docs is None else docs).select(
        paper_id().alias("paper_id"), F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"),
        F.slice("words", 1, 8).alias("title_tokens"), names("name").alias("authors_norm"), year.alias("year"), arxiv.alias("arxiv"),
    )
    return entry(out.withColumn("note_norm", F.array_join("title_tokens", " ")))


def ref(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    id_ = F.concat(F.lit("2401-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    out = (documents(spark, sf_dir) if docs is None else docs).select(
        paper_id().alias("paper_id"), F.col("doc_id").cast("int").alias("ord"), id_.alias("id"), id_.alias("arxiv"),
        F.col("words").alias("title_tokens"), names("name", "next_name").alias("authors_norm"),
        F.coalesce(F.col("y").cast("string"), F.lit("")).alias("year"),
    )
    return entry(out.withColumn("title", F.array_join("title_tokens", " ")))


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id < 80 and doc_id % 4 = 1")
    return docs.select(
        paper_id().alias("paper_id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("bib_key"),
        F.concat(F.lit("2401-"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("cand_id"),
    )
