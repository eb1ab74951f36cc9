"""Personal data, mixing and quality rules against plain Python, and their edge cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from refweave.llm import boosting, mixing, pii, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def docs(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])) % 10 == 0


def base(text):
    text, out = text or "", []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_base(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".d", "1.2.3.4", "300.", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "é", "𝒳", " ", "-", "12", "x", "\n", "0004.", "a.b%c@d-e.f.g"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(800)] + [None, "", " ", "1 " * 600, "a@" * 300, "+" * 500]
    got = {r["doc_id"]: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base(t)
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in spans) for k in range(4)], t
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), t
        assert set(line.split(",")) <= set(got[i]["spans"].split(",")) or not line


def test_personal_data_method_adds_and_redacts(spark):
    texts = ["mail: john (at) mail (dot) com or call (017) 555-7713 now", "the total of 12.5 for 2021", "card 4111 1111 1111 1111, x@y.z", None]
    got = [r["spans"] for r in pii.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    assert "email:6:30" in got[0] and "phone:" in got[0] and got[1] == "" and got[3] == ""
    clean = [r["text"] for r in pii.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert clean[1:3] == [texts[1], "card <CARD>, <EMAIL>"] and "<EMAIL>" in clean[0] and clean[3] == ""
    assert set(pii.with_spans(docs(spark, texts)).columns) == {*docs(spark, texts).columns, "base_spans", "all_spans"}
    assert pii.digest(docs(spark, texts).limit(0)).count() == 0


def test_boosted_trees_agree_with_columns_and_hold_out(spark):
    for kind in range(4):
        x, y = pii.examples(kind, 300, seed=99)
        m = pii.model(kind)
        chosen = m.score(x) >= m.threshold
        assert y[chosen].mean() >= 0.9 and chosen[y].mean() >= 0.5
        rows = spark.createDataFrame([[float(v) for v in r] for r in x[:50]], [f"f{j}" for j in range(x.shape[1])])
        scores = [r[0] for r in rows.select(m.column([F.col(f"f{j}") for j in range(x.shape[1])])).collect()]
        assert scores == pytest.approx(list(m.score(x[:50])))
    assert boosting.fit(x[:6], y[:6]).trees


def test_features_agree(spark):
    cases = [("john (at) x.y", "mail: ", "."), ("4111 1111", "card ", "a"), ("(017) 555-7713", "tel ", " ")]
    for kind in range(4):
        rows = spark.createDataFrame(cases, "t string, l string, r string")
        got = rows.select(*[f.cast("double") for f in pii.features(kind, F.col("t"), F.col("l"), F.col("r"))]).collect()
        assert [list(r) for r in got] == [[float(v) for v in pii.features_py(kind, *c)] for c in cases]


def fill(sizes, weights, budget, most=2):
    """Shares by repeated resharing of what is over the caps."""
    share, open_ = {k: 0.0 for k in sizes}, set(sizes)
    while True:
        left = budget - sum(most * sizes[k] for k in sizes if k not in open_)
        share |= {k: left * weights[k] / sum(weights[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > most * sizes[k]}
        if not over:
            return share
        share |= {k: most * sizes[k] for k in over}
        open_ -= over
        if not open_:
            return share


def test_mixing(spark):
    rng = random.Random(5)
    names = ["b", "a", None, "z", "é"]
    sources = [rng.choice(names + ["a"] * 5) for _ in range(600)]
    texts = [None if rng.random() < 0.02 else "w " * rng.randint(0, 60) for _ in sources]
    rows = mixing.mix(docs(spark, texts, sources)).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    wanted = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 0.25 * wanted[s] for s in sizes)
    again = mixing.mix(docs(spark, texts, sources))
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)
    assert mixing.repeat(again).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs(spark, texts, sources).limit(0)).count() == 0


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t", "a b c d e " * 300, " ".join(str(i % 90) for i in range(4000)), "#*$%&|<> é\x0bx", "a\na\n \n \na "]
    texts += ["".join(rng.choice(["a", "b ", " ", "\n", "a b c d e f ", "#", "é "]) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    got = {r["doc_id"]: r for r in quality.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        c = counts(t)
        assert tuple(got[i][k] for k in quality.COUNTS) == c, t
        assert got[i]["base_failed"] == (c[0] < 10 or 100 * c[4] > 20 * c[0])


def test_host_verdicts(spark):
    good, bad = " ".join(map(str, range(30))), "x"
    texts = [good] * 40 + [bad] * 40 + [good] + [bad]
    sources = ["good"] * 40 + ["bad"] * 39 + ["good"] + ["bad", None]
    out = quality.with_verdict(docs(spark, texts, sources)).collect()
    assert {r["source"]: r["host_ok"] for r in out}["good"] and not {r["source"]: r["host_ok"] for r in out}["bad"]
    assert [r["doc_id"] for r in out if r["source"] == "bad" and r["kept"]] == []
    assert sum(r["kept"] for r in out) == 40
    assert quality.with_verdict(docs(spark, texts, sources).limit(0)).count() == 0 and quality.digest(docs(spark, texts).limit(0)).count() == 0


CLASH = ["_rate", "rate", "_source", "_n", "_w", "_h", "_k", "_found", "_more", "_node", "_id", "_g", "row", "base", "rest"]


def clashing(spark, texts, sources=None):
    rows = docs(spark, texts, sources).drop("size", "kept")
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def test_clashing_columns_pass_through(spark):
    from refweave.llm import minhash

    texts = ["some words that stand here for a while, with x@y.zz too and many more of them"] * 2 + [None, "a b c"]
    rows = clashing(spark, texts, ["a", "a", None, "b"])
    outs = [mixing.mix(rows), mixing.repeat(mixing.mix(rows)), quality.with_verdict(rows), pii.with_spans(rows), pii.redact(rows), minhash.keep_one(rows)]
    for out in outs:
        assert set(rows.columns) <= set(out.columns)
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASH)
    assert pii.redact(rows).columns == rows.columns


def test_very_long_texts(spark):
    long = "one two x@y.zz " * 40_000
    rows = docs(spark, [long, None, "𝒳 +1 (017) 555-7713 é" * 3_000])
    got = {r["doc_id"]: r for r in pii.digest(rows).collect()}
    assert got[0]["n_email"] == 40_000 and got[1]["spans"] == "" and got[2]["n_phone"] == 3_000
    clean = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert clean[0] == long.replace("x@y.zz", "<EMAIL>") and clean[2] == "𝒳 <PHONE> é" * 3_000
    assert {r["doc_id"]: r["size"] for r in mixing.mix(rows).collect()} == {0: 120_000, 1: 0, 2: 4 * 3000 + 1}  # "é𝒳" is one word
    assert {r["doc_id"]: r["n_words"] for r in quality.digest(rows).collect()} == {0: 120_000, 1: 0, 2: 4 * 3000 + 1}


def test_folds_in_blocks(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000, 5000)], "xs array<int>")
    start = F.struct(F.lit(0).alias("at"), pii.empty("int").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    for r in rows.select("xs", pii.fold(F.col("xs"), start, step)["out"].alias("sums")).collect():
        assert r["sums"] == [sum(r["xs"][: i + 1]) for i in range(len(r["xs"]))]


def test_the_more_probable_of_overlapping_candidates_stays(spark):
    spans = [(0, 0, 5, 1.0), (3, 1, 8, 2.0), (7, 2, 9, 0.5), (9, 0, 12, 0.1), (20, 3, 30, 1.0), (20, 2, 31, 1.0)]
    rows = spark.createDataFrame([(sorted(spans),), ([],)], "x array<struct<s:int,k:int,e:int,p:double>>")
    got = [[tuple(y) for y in r[0]] for r in rows.select(pii.settled(F.col("x"))).collect()]
    assert got == [[(3, 1, 8), (9, 0, 12), (20, 2, 31)], []]


def test_real_examples_and_all_spans_by_hand(spark):
    texts = [f"server {i}.{i}.{i}.{i} and version {i}.400.{i}.{i}.7 of mail: u{i}@x.org, no. 4111 1111 1111 111{i % 10}" for i in range(60)] + [None]
    real = pii.real_examples(docs(spark, texts))
    assert {k: sorted(set(y.tolist())) for k, (_, y) in real.items()} == {0: [True], 1: [False, True], 2: [False, True], 3: []}
    trees = pii.models(docs(spark, texts))
    for r in pii.with_spans(docs(spark, texts), trees=trees).collect():
        every = [(x["s"], x["k"], x["e"]) for x in r["all_spans"]]
        assert set(base(r["text"])) <= set(every) and every == sorted(every)
        extra = [x for x in every if x not in base(r["text"])]
        assert all(e <= s2 or e2 <= s for s, _, e in extra for s2, _, e2 in every if (s, e) != (s2, e2))
