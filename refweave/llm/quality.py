"""Quality rules with DataFrame operations only, and the verdicts on hosts that follow from them.

Each document is held against rules on its own text. Rule failures are then aggregated by host (here the column
`source`); each host's failure rate is shrunk by a beta prior fitted to all hosts' rates (method of moments), and
hosts whose shrunk rate is over `max_rate` are rejected, which their documents learn by a join.

Defined results: a null text has no words and so fails; a null host is a host of its own; repeated rows are judged as
often as they occur; an empty table gives an empty result; further columns pass through `with_verdict` unless they bear
the name of a column that it adds, which then replaces them. Windows of words are told apart by 64-bit hashes. A very long
text is judged whole, in the time that sorting its windows takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, private, text_of

#: Rules of the base (fixed values): fewest words, most percent of words in repeated windows, words in a window.
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
#: A host goes if its shrunk failure rate is over this.
MAX_RATE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bound(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda's variable is bound to it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def repeated_words(words: Column, k: int = WINDOW_WORDS) -> Column:
    """Words of the array `words`, a lambda's variable, that stand in a k-word window found twice or more.

    Windows are compared by a 64-bit hash. Hashes that occur twice are found by a sort of plain longs; where they are
    few, positions are looked up among them, else by a second sort, so that no text takes quadratic time.
    """

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - p, F.lit(k))))
        return F.aggregate(own, F.lit(0), lambda a, b: a + b)

    def by_sort(pairs: Column) -> Column:
        same = lambda s, i, j: F.coalesce(s["h"] == F.get(pairs, i + j)["h"], F.lit(False))
        twice = F.filter(pairs, lambda s, i: same(s, i, -1) | same(s, i, 1))
        return bound(F.array_sort(F.transform(twice, lambda s: s["i"])), covered)

    def find(hashes: Column, twice: Column) -> Column:
        few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(twice) <= 64, bound(few, covered)).otherwise(bound(F.array_sort(pairs), by_sort))

    def repeats(hashes: Column) -> Column:
        twice = bound(F.sort_array(hashes), lambda hs: F.array_distinct(F.filter(hs, lambda h, i: F.coalesce(h == F.get(hs, i - 1), F.lit(False)))))
        return bound(twice, lambda t: find(hashes, t))

    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    some = bound(hashed, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(repeats(hs)))
    return F.when(F.size(words) < k + 1, F.lit(0)).otherwise(some)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """`df` with the columns COUNTS; a text is split into words once."""

    def of(ws: Column) -> Column:
        chars = F.length(F.array_join(ws, ""))
        return F.struct(F.size(ws).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), repeated_words(ws).cast("long").alias("n_repeat_words"))

    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    df = df.drop(*COUNTS)
    w = private(df, "_w")
    df = df.withColumn(w, bound(words_of(text), of)).withColumns({"n_symbols": symbols.cast("long"), "n_dup_lines": duplicate_lines(text)})
    return df.withColumns({k: F.col(w)[k] for k in ("n_words", "word_chars", "n_repeat_words")}).drop(w)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, failed, rate, shrunk_rate, host_ok), one row a host, written to the shared folder.

    judged: rows (host, base_failed). The prior has the mean and variance of the hosts' rates, which take one row on
    the driver. Where the variance is 0 or too large for a beta distribution, the prior weighs one document.
    """
    per = materialize(judged.groupBy(F.col(host).cast("string").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    rate = F.col("failed") / F.col("n")
    m, v = per.agg(F.avg(rate), F.var_pop(rate)).first()
    m = 0.0 if m is None else m
    weight = max(1.0, m * (1 - m) / v - 1) if v else 1.0
    shrunk = (F.col("failed") + m * weight) / (F.col("n") + weight)
    return per.withColumn("rate", rate).withColumn("shrunk_rate", shrunk).withColumn("host_ok", shrunk <= max_rate)


def with_host(df: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """`df` with host_ok; the verdicts are broadcast only if their file is below Spark's threshold."""
    h = private(df, "_h")
    v = materialize(verdicts.select(F.col("host").alias(h), "host_ok"), "host-verdicts")
    return df.join(v, F.col(host).cast("string").eqNullSafe(F.col(h)), "left").drop(h)


def with_verdict(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """`docs` with the counts, base_failed, host_ok and kept. The text is judged twice rather than shuffled or stored."""
    docs = docs.drop("base_failed", "host_ok", "kept")
    judged = with_counts(docs, text_of(text)).withColumn("base_failed", base_failed())
    found = host_verdicts(judged.select(host, "base_failed"), host, max_rate)
    return with_host(judged, found, host).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and verdicts by doc_id; the counts are made once and kept in the shared folder."""
    judged = with_counts(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), text_of()).drop("text")
    judged = materialize(judged.withColumn("base_failed", base_failed()), "judged")
    out = with_host(judged, host_verdicts(judged)).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept")
