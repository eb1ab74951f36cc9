"""Matching, splits, ranking and figures on small tables."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from refweave.functions.features import ngrams
from refweave.operators import matching, model, ranking, sampling, splits, stats, tfidf
from refweave.plans import queries, views
from refweave.schemas import Settings

BIB = "paper_id string, ord int, key string, title_tokens array<string>, authors_norm array<string>, year string, arxiv string, note_norm string, text string"
REF = "paper_id string, ord int, id string, title string, title_tokens array<string>, authors_norm array<string>, year string, arxiv string, text string"


def bib_rows(spark, rows):
    return spark.createDataFrame([(p, o, k, t.split(), a, y, x, t, " ".join([t, *a, y])) for p, o, k, t, a, y, x in rows], BIB)


def ref_rows(spark, rows):
    return spark.createDataFrame([(p, o, k, t, t.split(), a, y, k, " ".join([t, *a, y])) for p, o, k, t, a, y in rows], REF)


@pytest.fixture(scope="module")
def sides(spark):
    bib = bib_rows(spark, [("p1", 0, "k0", "deep nets", ["ann lee"], "2020", ""), ("p1", 1, "k1", "graph walks", ["bo chen"], "2019", "2401.1"), ("p1", 2, "k1", "graph walks", [], "", ""), ("p2", 0, "k0", "lone entry", [], "", "")])
    ref = ref_rows(spark, [("p1", 0, "r0", "deep nets", ["ann lee"], "2020"), ("p1", 1, "2401-1", "other thing", ["cy dee"], "2001"), ("p1", 2, "r0", "deep nets again", ["ann lee"], "2021")])
    return bib, ref


def test_cosine_by_hand(spark):
    rows = spark.createDataFrame([("p", "b", 0, "aa bb"), ("p", "r", 0, "aa bb"), ("p", "r", 1, "cc x")], "paper_id string, side string, ord int, text string")
    got = {(r["b_ord"], r["r_ord"]): r["cosine"] for r in tfidf.cosine(tfidf.weights(rows)).collect()}
    assert got == {(0, 0): pytest.approx(1.0)}
    split = tfidf.weights(rows.where("side = 'b'"), scope="split", fitted_on=rows.where("ord = 0"))
    assert {r["term"] for r in split.collect()} == {"aa", "bb"}


def test_scores(sides):
    got = {(r["b_ord"], r["r_ord"]): r for r in matching.score_pairs(*sides).collect()}
    assert len(got) == 9 and got[0, 0]["score"] == 1.0 and got[0, 0]["reason"].endswith("cap1")
    assert got[1, 1]["score"] == 1.0 and got[1, 1]["reason"] == "arxiv_exact"
    assert got[2, 0]["score"] == 0.0


def test_features_take_last_reference_and_multiply_keys(spark, sides):
    bib, ref = sides
    pairs = spark.createDataFrame([("p1", "k1", "2401-1"), ("p1", "k0", "r0"), ("p1", "k0", "missing")], "paper_id string, bib_key string, cand_id string")
    got = matching.with_features(pairs, bib, ref).collect()
    assert len(got) == 3
    one = next(r for r in got if r["bib_key"] == "k0")
    assert one["cand_year"] == 2021 and one["year_diff"] == 1 and one["year_match"] == 0
    assert {r["year_diff"] for r in got if r["bib_key"] == "k1"} == {18, 100}


def test_matches_caps_and_negatives(sides):
    bib, ref = sides
    rows = matching.matches(bib, ref, Settings(neg_per_bib=1)).collect()
    assert {(r["bib_key"], r["cand_id"], r["label"]) for r in rows if r["label"]} == {("k0", "r0", 1), ("k1", "2401-1", 1)}
    assert matching.matches(bib, ref, Settings(max_refs=1, scope="split", neg_per_bib=None, negatives="random")).count() > 0
    assert sampling.cap_per_paper(ref, 2, 1, "id").count() == 2


def test_manual(spark, sides):
    manual = spark.createDataFrame([("p1", "k1", "2401.1"), ("p1", "k9", "r0"), ("p9", "k", "r")], "paper_id string, bib_key string, cand_id string")
    assert [(r["bib_key"], r["cand_id"], r["label"]) for r in matching.manual_positives(manual, *sides).collect()] == [("k1", "2401.1", 1)]
    assert {r["paper_id"] for r in matching.target_papers(manual, sides[0], "p2", 1).collect()} == {"p1", "p9", "p2"}


def walk(pairs, least):
    used_b, used_r, out = set(), set(), set()
    for b, r, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if s >= least and b not in used_b and r not in used_r:
            used_b.add(b), used_r.add(r), out.add((b, r))
    return out


def test_greedy_assignment_is_the_walk(spark):
    rng = random.Random(4)
    papers = {f"p{p}": [(b, r, rng.randint(0, 6) / 6) for b in range(5) for r in range(6)] for p in range(8)}
    rows = spark.createDataFrame([(p, b, f"k{b}", r, f"r{r}", s) for p, x in papers.items() for b, r, s in x], "paper_id string, b_ord int, bib_key string, r_ord int, cand_id string, score double")
    got = {}
    for r in matching.greedy_assignment(rows, 0.3).collect():
        got.setdefault(r["paper_id"], set()).add((r["b_ord"], r["r_ord"]))
    assert got == {p: walk(x, 0.3) for p, x in papers.items()}


def test_split_truth_predictions_and_mrr(spark):
    rows = [(f"p{p}", f"k{k}", f"r{c}", s, int(c == 0), s, s, c) for p, n in enumerate([3, 5, 4, 2, 2]) for k in range(n) for c, s in enumerate((0.9, 0.95 if k == 0 else 0.5, 0.1))]
    df = spark.createDataFrame(rows, "paper_id string, bib_key string, cand_id string, score double, label int, levenshtein double, jaccard double, ord int")
    manual = spark.createDataFrame([("p3", "k0", "r0"), ("p4", "k0", "r0")], "paper_id string, bib_key string, cand_id string")
    parts = {r["paper_id"]: r["partition"] for r in splits.split_map(df, manual).collect()}
    assert parts == {"p3": "test", "p4": "val", "p1": "test", "p2": "val", "p0": "train"}
    split = splits.with_partition(df, splits.split_map(df, manual))
    assert {r["partition"]: r["n_papers"] for r in splits.split_report(split, {"test": 0.125, "val": 0.125}).collect()} == {"train": 1, "val": 2, "test": 2}
    truth = splits.ground_truth(df).withColumnRenamed("cand_id", "truth")
    rr = {r["bib_key"]: r["rr"] for r in ranking.reciprocal_ranks(df, truth, "score").where("paper_id = 'p1'").collect()}
    assert rr == {"k0": 0.5, "k1": 1.0, "k2": 1.0, "k3": 1.0, "k4": 1.0}
    table = ranking.update_predictions(splits.predictions_file(split), df, "score", truth).where("paper_id = 'p1'").first()
    assert table["prediction"]["k0"] == ["r1", "r0", "r2"] and table["groundtruth"]["k0"] == "r0" and table["partition"] == "test"
    assert splits.split_map(df.limit(0), manual).count() == 0
    assert ranking.mrr(ranking.reciprocal_ranks(df.limit(0), truth.limit(0), "score")).first()["mrr"] == 0.0
    sample = sampling.training_sample(df, 20, 1)
    assert sample.count() == 20 and sample.where("label = 1").count() == 16


def test_figures(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.5), (1, 1, 1.0), (1, 1, None)], "label int, prediction int, x double")
    assert {(r["bin"], r["n"]) for r in stats.histogram(rows, F.col("x"), 2).collect()} == {(0, 1), (1, 2)}
    report = {r["class"]: r for r in stats.class_report(rows).collect()}
    assert report["1"]["precision"] == pytest.approx(2 / 3) and report["accuracy"]["f1"] == 0.75 and report["macro avg"]["recall"] == 0.75
    assert stats.quartiles(rows.where("x is not null"), "x", "label").where("label = 0").first()["median"] == 0.25
    assert stats.correlations(rows, ["x", "label"], None).where("a = 'x' and b = 'x'").first()["r"] == pytest.approx(1.0)
    edges = spark.createDataFrame([("b", "root"), ("a", "root"), ("c", "a"), ("a", "c")], "child string, parent string")
    assert [(r["child"], r["depth"]) for r in stats.child_order(edges, "root").orderBy("depth", "path").collect()] == [("a", 1), ("b", 1), ("c", 2)]


def test_forest_learns(spark):
    rng = random.Random(1)
    rows = [(f"p{i % 3}", f"k{i // 4}", f"r{i}", i, y, *[float(y) + rng.random() * 0.5 for _ in range(4)], 2000 if i % 5 else None, 2000, float(y)) for i in range(200) for y in (int(i % 4 == 0),)]
    df = spark.createDataFrame(rows, "paper_id string, bib_key string, cand_id string, ord int, label int, levenshtein double, author_overlap double, author_lastname_match double, year_diff double, source_year int, cand_year int, year_match double")
    params, best = model.search(df, df, 2, space={"trees": (5,), "depth": (3, 4), "leaf": (1,), "subset": ("sqrt",)})
    fitted = model.fit(df, params)
    assert best > 0.9 and model.mean_reciprocal_rank(model.predict(fitted, df)).first()["mrr"] > 0.9
    assert model.importance(fitted).count() == 7


def test_forest_is_saved_and_settings_are_the_published_ones(spark, tmp_path):
    rows = [(i % 2, float(i % 2), 0.1 * i, 1.0, 0.0, 2000, 2000, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "label int, levenshtein double, author_overlap double, author_lastname_match double, year_diff double, source_year int, cand_year int, year_match double")
    fitted = model.fit(df, model.Params(trees=3, depth=3, leaf=1, split=6))
    model.save(fitted, str(tmp_path / "forest"))
    again = model.load(str(tmp_path / "forest"))
    assert [r["proba"] for r in model.predict(again, df).collect()] == [r["proba"] for r in model.predict(fitted, df).collect()]
    assert len([1 for _ in __import__("itertools").product(*model.GRID.values())]) == 48 and len(model.SPACE) == 6
    assert model.Params(leaf=1, split=6).least_leaf() == 3 and model.Params().least_leaf() == 5
    params, _ = model.grid_search(df, df, {"trees": (2,), "depth": (2,), "split": (2, 5), "leaf": (1,), "subset": ("sqrt",), "weights": model.WEIGHTS})
    assert params.weights in model.WEIGHTS


def test_figures_of_all_kinds(spark, sides):
    bib, ref = sides
    counts = stats.paper_counts(bib, ref)
    figures = stats.parsing_figures(counts)
    assert [r["paper_id"] for r in figures["no_ref"].collect()] == ["p2"] and figures["no_bib"].count() == 0
    assert {(r["bin"], r["n"]) for r in figures["distribution_bib"].collect()} == {(0, 1), (1, 1)}
    lines = stats.parsing_report(counts)
    assert "Total bibitems: 4" in lines and "Example papers missing references: p2" in lines and "  p1: 3" in lines
    total = spark.range(5)
    assert {r["category"]: r["n"] for r in stats.processing_summary(total, total.where("id < 2")).collect()} == {"Total": 5, "Processed": 3, "Skipped": 2}
    rows = spark.createDataFrame([("p", "k", str(i), i % 2, 0.1 * i, 0.2, 0.3, 100 if i == 3 else i, 1) for i in range(6)], "paper_id string, bib_key string, cand_id string, label int, score double, levenshtein double, jaccard double, year_diff int, year_match int")
    made = stats.matching_figures(rows, rows.withColumn("partition", F.lit("train")))
    assert made["feature_year_diff"].groupBy().sum("n").first()[0] == 5 and made["correlations"].count() == 25 and made["splits"].first()["n"] == 6
    ranks = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "rr double")
    shown = stats.performance_figures(rows.withColumn("prediction", F.col("label")), ranks, ranks)
    assert {r["bin"] for r in shown["ranks"].collect()} == {0, 10, 19}


def test_one_pass_ranks_equal_two(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([("p", f"k{k}", f"r{c}", rng.choice([0.1, 0.5, 0.9]), int(rng.random() < 0.2), c) for k in range(40) for c in range(9)], "paper_id string, bib_key string, cand_id string, score double, label int, ord int")
    one = {(r["bib_key"], r["rr"]) for r in ranking.first_positive_ranks(rows, "score").collect()}
    assert one == {(r["bib_key"], r["rr"]) for r in ranking.reciprocal_ranks(rows, ranking.first_positive(rows), "score").collect()}


def test_pairs_of_repeated_ids_have_their_own_features(spark):
    bib = bib_rows(spark, [("p", 0, "k", "deep nets", ["ann lee"], "2020", "")])
    ref = ref_rows(spark, [("p", 0, "r", "deep nets", ["ann lee"], "2020"), ("p", 1, "r", "other thing", ["cy dee"], "2001")])
    got = matching.block_features(bib, ref, ("year_diff", "jaccard")).collect()
    assert sorted((r["bib_key"], r["cand_id"], r["year_diff"], r["jaccard"]) for r in got) == [("k", "r", 0, 1.0), ("k", "r", 19, 0.0)]
    pairs = spark.createDataFrame([("p", "k", "r")], "paper_id string, bib_key string, cand_id string")
    assert sorted(r["year_diff"] for r in matching.with_features(pairs, bib, ref, ("year_diff",), last=False).collect()) == [0, 19]
    assert [r["year_diff"] for r in matching.with_features(pairs, bib, ref, ("year_diff",)).collect()] == [19]


def test_ranks_of_a_truth_listed_twice(spark):
    rows = spark.createDataFrame([("p", "k", "r", 0.9, 1, 0), ("p", "k", "r", 0.8, 1, 1), ("p", "k", "s", 0.1, 0, 2), ("p", "l", "s", 0.1, 0, 0)], "paper_id string, bib_key string, cand_id string, score double, label int, ord int")
    assert sorted(r["rr"] for r in ranking.first_positive_ranks(rows, "score", each=True).collect()) == [0.5, 1.0]
    assert [r["rr"] for r in ranking.first_positive_ranks(rows, "score").collect()] == [1.0]
    assert [r["rr"] for r in ranking.first_positive_ranks(rows, "score", k=1, each=True).collect()] == [1.0]


def test_pairs_are_ranked_where_they_are_made(spark, sides):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = matching.label(matching.score_pairs(*sides), 0.7).withColumn("ord", F.col("r_ord"))
        for rows in (pairs, ranking.top_k(pairs, "score"), ranking.first_positive_ranks(pairs, "score"), sampling.negatives(pairs, 3)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and not re.findall(r"hashpartitioning\(paper_id#\d+, [a-z]", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_products_of_vectors_equal_the_join_of_terms(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(f"p{p}", s, o, " ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "x"], k=o))) for p in range(3) for s in "br" for o in range(6)], "paper_id string, side string, ord int, text string")
    weighed = tfidf.weights(rows)
    split = tfidf.weights(rows, fitted_on=rows)
    key = lambda df: {(r["paper_id"], r["side"], r["ord"], r["term"]): pytest.approx(r["weight"]) for r in df.collect()}
    assert key(weighed) == {k: v.expected for k, v in key(split).items()}
    v = tfidf.vectors(weighed)
    side = lambda s: v.where(F.col("side") == s).select("paper_id", F.col("ord").alias(f"{s}_ord"), F.col("vector").alias(s))
    got = side("b").join(side("r"), "paper_id").withColumn("cosine", tfidf.product(F.col("b"), F.map_from_entries("r"))).where("cosine > 0")
    key = lambda df: {(r["paper_id"], r["b_ord"], r["r_ord"]): r["cosine"] for r in df.collect()}
    want = key(tfidf.cosine(weighed))
    assert want and key(got) == {k: pytest.approx(x) for k, x in want.items()}


def test_features_of_scored_pairs_are_of_their_own_rows(spark):
    bib = bib_rows(spark, [("p", 0, "k", "deep nets", ["ann lee"], "2020", "")])
    ref = ref_rows(spark, [("p", 0, "r", "deep nets", ["ann lee"], "2020"), ("p", 1, "r", "other thing", ["cy dee"], "2001")])
    rows = matching.score_pairs(bib, ref, plain_sides=True)
    assert sorted((r["year_diff"], r["char_ngram_3"]) for r in matching.scored_features(rows).collect()) == [(0, 1.0), (19, 0.0)]
    assert [r["year_diff"] for r in matching.scored_features(rows.where("score = 1")).collect()] == [0]


def test_quartiles_count_equal_values(spark):
    rows = spark.createDataFrame([(1, 0.1)] * 5 + [(1, 0.2), (1, 0.4), (0, 1.0)], "label int, x double")
    assert {r["label"]: (r["q1"], r["median"], round(r["q3"], 6)) for r in stats.quartiles(rows, "x", "label").collect()} == {1: (0.1, 0.1, 0.15), 0: (1.0, 1.0, 1.0)}
    assert stats.quartiles(rows, "x", "label")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Tables of doc_id 100,000 on, where the views cut ids to five digits: ten references an id."""
    d = tmp_path_factory.mktemp("repeated")
    words = ["deep", "nets", "graph", "walks", "été", "2019", "42", "proofs", "of", "long", "runs"]
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14))), "en", "web", 1) for i in range(99_995, 100_045)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    ids = spark.range(99_990, 100_040)
    year = F.make_timestamp(F.lit(1995) + F.col("id") % 4, F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    ids.select(F.col("id").alias("o_orderkey"), year.alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    name = F.concat_ws(" ", F.get(F.array(F.lit("large"), F.lit("hot"), F.lit("red")), (F.col("id") % 3).cast("int")), F.get(F.array(F.lit("ring"), F.lit("bolt")), (F.col("id") % 2).cast("int")))
    ids.select(F.col("id").alias("p_partkey"), name.alias("p_name")).write.parquet(f"{d}/part.parquet")
    return str(d)


def sql_rows(d, sql):
    con = duckdb.connect()
    for t in ("documents", "orders", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return con.execute(sql).fetchall()


def rounded(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


FEATURE_QUERIES = [
    "feat_author_lastname_match", "feat_author_overlap", "feat_cand_year", "feat_digit_overlap", "feat_jaccard", "feat_token_overlap",
    "feat_token_overlap_ratio", "feat_year_diff", "feat_year_match",
]


@pytest.mark.parametrize("name", FEATURE_QUERIES)
def test_queries_equal_their_sql_where_ids_repeat(spark, repeated, name):
    got, want = rounded(map(tuple, queries.QUERIES[name](spark, repeated).collect())), rounded(sql_rows(repeated, queries.ORACLES[name]))
    assert len(got) == 1650 and got == want


def test_cosines_by_place_equal_the_join_of_terms(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"p{p}", s, 3 * o, " ".join(rng.choices(["aa", "bb", "été", "dd", "ee", "x"], k=o))) for p in range(3) for s in "br" for o in range(7)]
    rows += [("only b", "b", 0, "aa"), ("only r", "r", 0, "aa"), ("none", "b", 0, "x"), ("none", "r", 0, "")]
    weighed = tfidf.weights(spark.createDataFrame(rows, "paper_id string, side string, ord int, text string"))
    want = {(r["paper_id"], r["b_ord"], r["r_ord"]): r["cosine"] for r in tfidf.cosine(weighed).collect()}
    termed = {(r["paper_id"], r["side"], r["ord"]) for r in weighed.collect()}
    for held in (1, 20, tfidf.HELD):  # batches of one entry, of a few and of all
        monkeypatch.setattr(tfidf, "HELD", held)
        made = tfidf.cosines(weighed).collect()
        place = {(r["paper_id"], r["side"], r["pos"]): r["ord"] for r in made}
        assert {(r["paper_id"], r["side"], r["ord"]) for r in made} == termed and len(made) == len(place) == len(termed)
        got = {(r["paper_id"], r["ord"], place[r["paper_id"], "r", i]): x for r in made if r["side"] == "b" for i, x in enumerate(r["cosines"]) if x}
        assert want and got == {k: pytest.approx(x) for k, x in want.items()}


def test_ngrams_read_their_text_once():
    made = ngrams(F.col("text"), 3)._jc.toString()
    assert made.count("regexp_replace") == 1


@pytest.mark.parametrize("name", ["feat_all", "training_sample", "greedy_assignment", "score_reasons", "weak_labels"])
def test_words_of_documents_are_found_once(spark, repeated, monkeypatch, name):
    calls, documents = [], views.documents
    monkeypatch.setattr(views, "documents", lambda *a: calls.append(a) or documents(*a))
    queries.QUERIES[name](spark, repeated)
    assert len(calls) == 1


SCORED_QUERIES = [
    "greedy_assignment", "hard_negatives", "histogram_by_label", "label_counts", "pred_json", "rows_per_paper", "score_pairs", "score_reasons", "split_counts",
    "training_sample", "weak_labels",
]


@pytest.mark.parametrize("name", SCORED_QUERIES)
def test_scored_queries_equal_their_sql_where_ids_repeat(spark, repeated, name):
    rows = queries.QUERIES[name](spark, repeated)
    assert rounded(map(tuple, rows.collect())) == rounded(sql_rows(repeated, f"select {', '.join(rows.columns)} from ({queries.ORACLES[name]})"))


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """A paper of documents with null, empty and short texts, and letters whose lower case Java and the SQL see differently."""
    d = tmp_path_factory.mktemp("odd")
    texts = [None, "", " \n", "a b", "deep nets 42", "İstanbul ΣΟΦΟΣ 42 2019", "istanbul σοφοσ", "Deep nets ABC abc", None, "ΣΟΦΟΣ-ΣΑ"]
    spark.createDataFrame([(i, t, "en", "web", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    ids = spark.range(len(texts) - 2)
    ids.select(F.col("id").alias("o_orderkey"), F.make_timestamp(F.lit(1995) + F.col("id") % 4, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("o_orderdate")).write.parquet(f"{d}/orders.parquet")
    ids.select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name")).write.parquet(f"{d}/part.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["feat_digit_overlap", "feat_jaccard", "feat_token_overlap", "feat_token_overlap_ratio", "feat_levenshtein", "feat_char_ngram_3", "feat_char_ngram_4", "feat_char_ngram_5"])
def test_features_of_odd_texts_equal_their_sql(spark, odd_texts, name):
    got, want = list(map(tuple, queries.QUERIES[name](spark, odd_texts).collect())), sql_rows(odd_texts, queries.ORACLES[name])
    assert len(got) == 100
    if name == "feat_levenshtein":  # the SQL counts bytes: without texts of Greek letters
        got, want = ([r for r in rows if not {r[1][-1], r[2][-1]} & set("569")] for rows in (got, want))
    assert repr(rounded(got)) == repr(rounded(want))


def test_block_features_are_amended_by_name(spark):
    bib = bib_rows(spark, [("p", 0, "k", "deep nets", [], "", "")]).withColumn("title_tokens", F.lit(None).cast("array<string>"))
    ref = ref_rows(spark, [("p", 0, "r", "deep nets", [], "")])
    of = lambda *more: [tuple(r)[3:] for r in matching.block_features(bib, ref, ("token_overlap", "jaccard"), *more).collect()]
    assert of() == [(2, 1.0)]
    assert of({"jaccard": lambda value: F.when(F.col("b_titled"), value)}) == [(2, None)]
