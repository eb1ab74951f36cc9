"""Text functions and pair features against values worked out by hand, and against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refweave.functions import features as E
from refweave.functions import text as T


def value(spark, column, **row):
    kinds = {"list": "array<string>", "str": "string", "int": "int", "NoneType": "string"}
    schema = ", ".join(f"{k} {kinds[type(v).__name__]}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "given_", "wanted"),
    [
        (T.norm_arxiv, "2408-02468", "240802468"),
        (T.norm_arxiv, "2408.02468v1", "240802468v1"),
        (T.norm_arxiv, None, ""),
        (T.year_of_date, "on 2021-03-04", "2021"),
        (T.year_of_date, "18999", ""),
        (T.year_int, "2021a", 2021),
        (T.year_int, "", None),
        (T.normalize_parsed, r"\textbf{Graph-Based} {GPU} \'etude", "graphbased gpu etude"),
        (T.normalize_parsed, "ﬁne “Café”", "fine cafe"),
        (T.normalize_matched, "Don’t \\vspace{2cm} stop % remark", "dont stop"),
        (T.strip_comments, r"a \% b % c", r"a \% b "),
        (T.split_authors, "A. One and B. Two, C", ["A. One", "B. Two", "C"]),
        (T.split_authors, "Anderson, Sandy", ["Anderson", "Sandy"]),
        (T.arxiv_in, "see ArXiv: 2101.00001v2.", "2101.00001v2"),
        (T.pages_in, "pp. 12 - 34", "12 - 34"),
        (T.author_from_key, "SmithJones2020", "Smith Jones"),
        (T.normalize_math, r"\(x\) and $$y$$", r"$x$ and \begin{equation}y\end{equation}"),
        (T.terms, "It's a B2B naïve x", ["it", "b2b", "naïve"]),
    ],
)
def test_text(spark, function, given_, wanted):
    assert value(spark, function(F.col("x")), x=given_) == wanted


def test_author_tokens(spark):
    assert value(spark, T.author_tokens(F.col("x")), x=["dr j. smith", "li", "w x li"]) == ["smith", "li", "li"]
    assert value(spark, T.note_title_tokens(F.col("n"), F.col("a")), n="smith the deep net 1999 journal", a=["smith"]) == ["deep", "net"]
    assert value(spark, T.note_title_tokens(F.col("n"), F.col("a")), n="1999 deep net", a=["smith"]) == ["1999", "deep", "net"]


def sim(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0.0


def test_edges(spark):
    assert value(spark, E.levenshtein(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert value(spark, E.levenshtein(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert value(spark, E.token_overlap_ratio(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x"]) == pytest.approx(1 / 3)
    assert value(spark, E.author_side(F.col("a"), F.col("b")), a=[], b=[" Ann B ", ""]) == ["ann b"]
    assert value(spark, E.text_side(F.col("a"), F.col("b"), F.lit("note")), a="", b=" ") == ""


words = st.lists(st.sampled_from(["a", "b", "cc", "d1", "é", "22"]), max_size=6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(words, words), min_size=30, max_size=60))
def test_sets_agree_with_python(spark, pairs):
    rows = spark.createDataFrame([(i, a, b, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>, s string, t string")
    a, b = F.col("a"), F.col("b")
    got = rows.select("i", E.jaccard(a, b).alias("j"), E.token_overlap(a, b).alias("o"), E.jaccard_if_both(E.ngrams(F.col("s"), 3), E.ngrams(F.col("t"), 3)).alias("n"), E.digit_overlap(F.col("s"), F.col("t")).alias("d")).orderBy("i").collect()
    grams = lambda x: {"".join(x)[i : i + 3] for i in range(len("".join(x)) - 2)}
    for r, (x, y) in zip(got, pairs, strict=True):
        assert r["j"] == pytest.approx(sim(x, y)) and r["o"] == len(set(x) & set(y))
        assert r["n"] == pytest.approx(sim(grams(x), grams(y)) if grams(x) and grams(y) else 0.0)
        digits = lambda z: {w.strip("d") for w in z if any(c.isdigit() for c in w)}
        assert r["d"] == len(digits(x) & digits(y))


TEX = [r"\textbf{Graph $a_{\textbf{x}}$} [h] \cite{K84} \vspace{2cm}\\ end", r"a \emph{b \cite{c}} \hline \[ x \textbf{y} \] [.3cm] z", "plain", "", r"\vspace{$gone$} $kept$ \ref{a} Keywords: x", "one\nkeywords: a MSC 2020 Subject Classifications: b", r"\begin{align*}\hfill\end{align*} \hfill \foo[o]{bar}"]


def test_cleanup_of_columns_and_strings_agree(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEX)], "i int, t string")
    for lengths in (True, False):
        got = [r[0] for r in rows.orderBy("i").select(T.cleanup_formatting(F.col("t"), lengths)).collect()]
        assert got == [T.cleaned_text(t, lengths) for t in TEX]
    assert T.cleaned_text(TEX[0]) == r"Graph $a_{\textbf{x}}$  K84  end" and T.cleaned_text(TEX[4]) == " $kept$ a. Keywords: x"
    assert [r[0] for r in rows.orderBy("i").select(T.normalize_parsed(F.col("t"))).collect()] == [T.parsed_text(t) for t in TEX]
