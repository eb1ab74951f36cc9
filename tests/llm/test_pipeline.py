"""The pipeline against plain Python versions of its stages, on a small table."""

import random

import corpus_pipeline
from refweave.llm import mixing, sentencepiece

from .test_free import groups
from .test_native import counts


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(5, 80))]
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "new"
            texts += [" ".join(words)] * rng.randint(1, 3)
    texts += [None, "", "short", "a b c d e " * 20, " ".join(f"w{i}" for i in range(20)) + " write to me@mail.org"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if counts(r[1])[0] >= 10 and 100 * counts(r[1])[4] <= 20 * counts(r[1])[0]]
    group = groups([r[1] for r in good])
    kept = {good[i][0]: good[i] for i in set(group)}
    assert {r["doc_id"] for r in got} <= set(kept)
    clean = {i: r[1].replace("me@mail.org", "<EMAIL>") for i, r in kept.items()}
    assert all(r["text"] == clean[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    docs = spark.createDataFrame([(i, clean[i], r[3]) for i, r in kept.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, n in copies.items() for _ in range(n))
    one = sentencepiece.Encoder(sentencepiece.model_bytes())
    assert all(list(r["ids"]) == one.encode([r["text"]])[0].tolist() and r["n_ids"] == len(r["ids"]) for r in got[:40])
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_dedup"


def test_pipeline_on_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    from refweave.llm import common

    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, "en", None, 1), (1, words, "en", None, 1), (None, words + " x", "fr", "s", 2), (4, None, None, "s", None), (5, "", "de", "s", 0), (6, " ".join(f"v{i}" for i in range(9000)), "en", "s", 3), (7, "z" * 300_000 + " " + " ".join(f"q{i}" for i in range(20)), "en", "s", 3)]
    names = ("kept", "size", "rate", "copies", "_node", "_id", "base_failed", "all_spans", "taken")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names})
    table.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    before = len(common.made())
    got = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert set(got.columns) == {*table.columns, "ids", "n_ids"} and len(common.made()) == before + 1
    found = got.collect()
    assert {r["doc_id"] for r in found} <= {1, 6, 7} and all(r[c] == f"own {c}" for r in found for c in names)
    assert all(r["text"] == {1: words, 6: rows[5][1], 7: rows[6][1]}[r["doc_id"]] for r in found)
    docs = spark.read.parquet(str(tmp_path / "a" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
    table.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
