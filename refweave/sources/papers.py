"""Paper folders to typed tables: hierarchy, refs.bib, bibitems, references; and the JSON files around them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import BIBITEMS, MATCHES, RAW_REFERENCES, REFERENCES
from . import bibtex, latex

PARSED = "paper_id string, hierarchy string, refs_bib string, n_versions int, error string"


def paper_files(spark: SparkSession, root: str) -> DataFrame:
    """(paper_id, version, path, content) of {root}/{paper}/tex/{version}/**/*.tex|bib, bad bytes ignored.

    Only Spark opens files, so `root` may be in any store that it reads; version is null for references.json and refs.bib.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{tex,bib,json}").load(root)
    inner = F.regexp_extract("path", r"/([^/]+)/(?:tex/([^/]+)/(.+\.(?:tex|bib))|(references\.json|refs\.bib))$", 0)
    part = lambda i: F.regexp_extract(inner, r"^/([^/]+)/(?:tex/([^/]+)/(.+)|(references\.json|refs\.bib))$", i)
    found = files.where(inner != "").select(part(1).alias("paper_id"), F.nullif(part(2), F.lit("")).alias("version"), F.coalesce(F.nullif(part(3), F.lit("")), part(4)).alias("path"), "content")
    return found


def paper_list(files: DataFrame, start: str | None = None, number: int | None = None, paper_id: str | None = None) -> DataFrame:
    """Papers with a tex folder by name, from `start`, the first `number`; or one, which must be there."""
    ids = files.where("version is not null").select("paper_id").distinct()
    if paper_id is not None:
        one = ids.where(F.col("paper_id") == paper_id)
        if one.isEmpty():
            raise ValueError(f"there is no paper {paper_id}")
        return one
    ids = ids if start is None else ids.where(F.col("paper_id") >= start)
    return ids.orderBy("paper_id") if number is None else ids.orderBy("paper_id").limit(number)


def parse_parts(paper: str, versions: dict[str, dict[str, str]]) -> dict:
    """A paper's versions in order of their names, one numbering of elements for all: elements, hierarchy, refs_bib.

    A version without a main file stands in the hierarchy as an empty one, and its .bib files do not count.
    """
    tree = latex.Tree(paper)
    hierarchy: dict[str, dict[str, str]] = {}
    contents: list[str] = []
    items: list[tuple[str, str]] = []
    for n, version in enumerate(sorted(versions), 1):
        files = {p: c for p, c in versions[version].items() if p.endswith(".tex")}
        main = latex.main_file(files)
        if main is None:
            hierarchy[str(n)] = {}
            continue
        contents += [c for p, c in sorted((p, c.strip()) for p, c in versions[version].items() if p.endswith(".bib")) if c not in contents]
        tex = latex.inline_includes(main, files)
        items += list(bibtex.bibitems(tex))
        _, alias = bibtex.canonical(items)
        tree.children = {}
        latex.parse_document(tree, latex.strip_references(bibtex.remap_cites(tex, alias)))
        hierarchy[str(n)] = tree.parents()
    fields, _ = bibtex.canonical(items)
    return {"elements": tree.elements, "hierarchy": hierarchy, "refs_bib": bibtex.refs_bib(contents, fields)}


def parse_one(paper: str, versions: dict[str, dict[str, str]]) -> dict:
    """parse_parts() as a row of PARSED."""
    parts = parse_parts(paper, versions)
    tree = {k: parts[k] for k in ("elements", "hierarchy")}
    return {"hierarchy": json.dumps(tree, ensure_ascii=False), "refs_bib": parts["refs_bib"], "n_versions": len(parts["hierarchy"]), "error": None}


def versions_of(pdf: pd.DataFrame) -> dict[str, dict[str, str]]:
    versions: dict[str, dict[str, str]] = {}
    for v, p, c in zip(pdf.version, pdf.path, pdf.content, strict=True):
        versions.setdefault(v, {})[p] = bytes(c).decode("utf-8", "ignore")
    return versions


def parse_papers(files: DataFrame) -> DataFrame:
    """One row a paper: hierarchy (JSON), refs_bib, n_versions; error tells why a paper was skipped."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        versions = versions_of(pdf)
        try:
            row = parse_one(key[0], versions)
        except Exception as e:  # a broken paper must not stop the others
            row = {"hierarchy": None, "refs_bib": None, "n_versions": 0, "error": f"{type(e).__name__}: {e}"}
        return pd.DataFrame([{"paper_id": key[0]} | row])

    return files.where("version is not null").groupBy("paper_id").applyInPandas(run, PARSED)


def paper_elements(files: DataFrame) -> DataFrame:
    """(paper_id, id, parent, text) of all elements, a row a version that has them under a parent, in one pass over the files.

    The rows are those of hierarchy_tables()' elements with their edges; papers with errors have none.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        versions = versions_of(pdf)
        try:
            parts = parse_parts(key[0], versions)
        except Exception:  # as in parse_papers, which tells why
            parts = {"elements": {}, "hierarchy": {}}
        ups = list(parts["hierarchy"].values())
        rows = [(id_, parent, text) for id_, text in parts["elements"].items() for parent in ([up[id_] for up in ups if id_ in up] or [None])]
        made = pd.DataFrame(rows, columns=["id", "parent", "text"], dtype=object)
        made.insert(0, "paper_id", key[0])
        return made

    return files.where("version is not null").groupBy("paper_id").applyInPandas(run, "paper_id string, id string, parent string, text string")


def hierarchy_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements(paper_id, id, text), edges(paper_id, version, child, parent))."""
    tree = F.from_json("hierarchy", "elements map<string,string>, hierarchy map<string,map<string,string>>")
    read = parsed.where("hierarchy is not null").select("paper_id", tree.alias("t"))
    elements = read.select("paper_id", F.explode("t.elements").alias("id", "text"))
    return elements, read.select("paper_id", F.explode("t.hierarchy").alias("version", "up")).select("paper_id", "version", F.explode("up").alias("child", "parent"))


def bibitem_rows(entries: DataFrame) -> DataFrame:
    """Typed rows of .bib entries of the kept types: title words come from the title, else from the note.

    Of a title, : and / become blanks; of a note's words they are stripped off the ends.
    """
    e = bibtex.kept_entries(entries).withColumns({
        "authors_norm": T.normalize_names("author"), "note_norm": T.normalize_parsed(F.col("note"), True), "_title": T.no_marks(T.normalize_parsed(F.col("title"))),
    })
    every = T.all_author_tokens(F.col("authors_norm"))
    has = F.col("_title") != ""
    tokens = F.when(has, T.without(T.filter_title_tokens(F.split("_title", " ")), every)).otherwise(T.note_title_tokens(F.col("note_norm"), every))
    return e.select(
        "paper_id", "ord", "key", "note", "author", "year", "arxiv", "authors_norm", "note_norm", tokens.alias("title_tokens"),
        plain_author_tokens().alias("author_tokens"), F.when(has, "title").otherwise("note").alias("tokens_source"),
    )


def plain_author_tokens() -> Column:
    """Parts of authors' names of two letters or more."""
    return F.filter(T.name_parts(F.col("authors_norm")), lambda t: F.length(t) > 1)


def reference_rows(raw: DataFrame) -> DataFrame:
    """Typed rows of references.json texts (paper_id, content); bad JSON gives none."""
    items = raw.select("paper_id", F.from_json(F.col("content").cast("string"), RAW_REFERENCES).alias("m")).select("paper_id", F.posexplode("m").alias("ord", "id", "v"))
    none = F.array().cast("array<string>")
    r = items.select(
        "paper_id", "ord", "id", F.coalesce("v.paper_title", F.lit("")).alias("title"), F.coalesce("v.authors", none).alias("authors"),
        T.year_of_date(F.col("v.submission_date")).alias("year"), F.col("id").alias("arxiv"),
    )
    r = r.withColumns({"authors_norm": T.normalize_each("authors"), "_t": T.normalize_parsed(F.col("title"))})
    words = F.filter(F.split(T.no_marks(F.col("_t")), " "), lambda t: t != "")
    note = T.strip_tokens(F.concat_ws(" ", F.array_join("authors_norm", " "), "_t"))
    return r.select("paper_id", "ord", "id", "title", "authors", "authors_norm", words.alias("title_tokens"), plain_author_tokens().alias("author_tokens"), "year", "arxiv", note.alias("note_norm"))


def postprocess_tokens(rows: DataFrame) -> DataFrame:
    """Author tokens made anew (kept where that leaves none); title tokens without stop words and author names."""
    norm = private_column(rows)
    clean = rows.withColumn(norm, T.normalize_each("authors_norm"))
    made = T.author_tokens(F.col(norm))
    return clean.withColumns({
        "author_tokens": F.when(F.size(made) > 0, made).otherwise(F.col("author_tokens")),
        "title_tokens": T.without(T.filter_title_tokens(F.col("title_tokens")), T.all_author_tokens(F.col(norm))),
    }).drop(norm)


def private_column(rows: DataFrame) -> str:
    name = "_authors"
    while name in rows.columns:
        name = f"_{name}"
    return name


def read_jsonl(spark: SparkSession, path: str, schema: str, ids: DataFrame | None = None) -> DataFrame:
    """Rows of a JSONL file that have a paper_id; malformed lines go; only papers among `ids`, if given."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("paper_id <> ''")
    return rows if ids is None else rows.join(ids, "paper_id", "left_semi")


def read_bibitems(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    return read_jsonl(spark, path, BIBITEMS, ids)


def read_references(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    return read_jsonl(spark, path, REFERENCES, ids)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MATCHES)


def malformed(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines are no JSON of this schema; empty lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(read.alias("x")).where("x._bad is not null").count()


def read_manual(spark: SparkSession, path: str | None) -> DataFrame:
    """(paper_id, bib_key, cand_id) of a JSON map of maps; none without a file or with a bad one."""
    none = spark.createDataFrame([], "paper_id string, bib_key string, cand_id string")
    if path is None:
        return none
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    read = text.select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return read.select(F.explode("m").alias("paper_id", "keys")).select("paper_id", F.explode("keys").alias("bib_key", "cand_id"))


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = [read_matches(spark, f"{folder}/{p}").withColumn("partition", F.lit(p)) for p in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_split(split: DataFrame, folder: str) -> None:
    """One folder a partition, as read_split() takes them."""
    for p in ("train", "val", "test"):
        split.where(F.col("partition") == p).drop("partition").write.mode("overwrite").json(f"{folder}/{p}")


def write_by_paper(parsed: DataFrame, column: str, path: str) -> None:
    """A text a paper, in folders paper_id=...; a text keeps its line feeds."""
    parsed.where(F.col(column).isNotNull()).select("paper_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("paper_id").text(path)


def write_predictions(table: DataFrame, path: str) -> None:
    table.select("paper_id", F.to_json(F.struct("partition", "groundtruth", "prediction")).alias("value")).write.mode("overwrite").partitionBy("paper_id").text(path)

