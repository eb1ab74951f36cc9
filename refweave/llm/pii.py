"""Personal data in texts, with DataFrame operations only.

Base rules find spans of four kinds. Beside them, generators of high recall propose candidates in what the base leaves;
they may overlap. Boosted trees score each from its form and its context, a threshold per kind selects, and of selected
candidates that overlap the more probable one stays. Base spans always stay.

The trees are fitted on the driver on a bounded table: TRAIN_ROWS made examples a kind (`examples`, for forms that the base
does not know), and REAL_ROWS spans a kind and label from about SAMPLE_DOCS of the documents at hand, drawn by a hash of the text:
base spans are personal data, candidates that cannot be (no address of four bytes, no card number by its checksum) are not.
Every third row is held out, and the held-out rows calibrate the thresholds.

Defined results: a null text is empty and has no span; repeated rows are searched as often as they occur; ties among
overlapping candidates go to the earlier start, then the kind listed first; an empty table gives an empty result; further
columns pass through `with_spans` and `redact` unless they bear the names of columns that those add, which then replace them.
Positions are code points, ends exclusive. All patterns are possessive or anchored at the start of a run, and spans are
gathered in blocks, so that a very long text takes nearly linear time and no deep recursion.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Model, fit
from .common import private, text_of
from .quality import bound

#: Kinds in the order that sorting and counting follow (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values of the contract), written so that Java neither recurses nor rescans a run.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9]){13,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold for a kind's patterns to be run at all.
BASE_GUARD = ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")
#: Generators: wider forms of each kind.
WIDE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?+[\[(]at[\])]\x20?+|\x20?+@\x20?+)[A-Za-z0-9-]++(?:(?:\.|\x20?+[\[(]dot[\])]\x20?+)[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:(?:\.|\[\.\]|\x20?+[\[(]dot[\])]\x20?+)[0-9]++){3,}+",
    r"(?<![0-9])[0-9](?:[\x20./-]?+[0-9]){12,}+",
    r"(?<![0-9+])(?:\([0-9]{2,4}+\)|0[0-9]{1,4}+|[0-9]{3})[\x20./-]?+[0-9]{3,4}[\x20./-][0-9]{3,4}",
)
WIDE_GUARD = (r"@|[\[(]at[\])]", r"[0-9](?:\.|\[\.\]|\x20?+[\[(]dot[\])])\x20?+[0-9]", r"[0-9](?:[\x20./-]?+[0-9]){12}", r"[0-9)][\x20./-]?+[0-9]{3,4}[\x20./-][0-9]{3}")
#: Words before a span that speak for its kind.
CUES = (r"mail|contact|write", r"\bip\b|host|server|address", r"card|visa|credit|debit|pay", r"tel|phone|call|fax|mobile|ring us")
CONTEXT, N_FEATURES = 24, 10
TRAIN_ROWS, REAL_ROWS, SAMPLE_DOCS = 600, 150, 2000
SEED = 7
#: Characters that a text is cut into where spans of it are taken.
CUT = 4096
SPAN = "struct<s:int,k:int,e:int>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.pmod(d.try_cast("int") * 2, F.lit(10)) + F.when(d.try_cast("int") > 4, 1).otherwise(0)))
    return F.coalesce(F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0, F.lit(False))


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def valid(kind: int, t: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(t, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == 2:
        return bound(digits_of(t), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == 3:
        return F.length(digits_of(t)).between(10, 15)
    return F.lit(True)


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Like F.aggregate, with a state whose array `out` grows: it is built in blocks, as appending copies what is there.

    step(state, item) may append to state["out"], and must not look at it.
    """

    def over(xs: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))

        def block(a: Column, b: Column, w: Column) -> Column:
            inner = F.aggregate(F.slice(xs, b * w + 1, w), a.withField("out", F.slice(a["out"], 1, 0)), step)
            return bound(inner, lambda r: r.withField("out", F.concat(a["out"], r["out"])))

        blocks = bound(width, lambda w: F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / w).cast("int")), start, lambda a, b: block(a, b, w)))
        return F.when(F.size(xs) == 0, start).otherwise(blocks)

    return bound(items, over)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches, left to right: array of (s, e, t, left, right); left and right are the text around."""

    def places(gaps: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty("struct<s:int,e:int,t:string,left:string,right:string>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            one = lambda s: F.struct(s.alias("s"), (s + x["len"]).alias("e"), x["t"].alias("t"), x["left"].alias("left"), x["right"].alias("right"))
            return bound(a["at"] + x["gap"], lambda s: F.struct((s + x["len"]).alias("at"), F.concat(a["out"], F.array(one(s))).alias("out")))

        def match(t: Column, i: Column) -> Column:
            before = F.concat(F.when(F.length(F.get(gaps, i)) < CONTEXT, F.coalesce(F.get(found, i - 1), F.lit(""))).otherwise(F.lit("")), F.get(gaps, i))
            after = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(found, i + 1), F.lit("")))
            return F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(t).alias("len"), t.alias("t"), F.right(before, F.lit(CONTEXT)).alias("left"), F.substring(after, 1, 1).alias("right"))

        return fold(F.transform(found, match), start, step)["out"]

    return bound(F.split(text, pattern, -1), lambda gaps: bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: places(gaps, found)))


def base_found(text: Column, kind: int) -> Column:
    """The base spans of one kind: array of (s, e, t, left, right)."""
    found = F.filter(located(text, BASE[kind]), lambda x: valid(kind, x["t"])) if kind else located(text, BASE[kind])
    return F.when(text.rlike(BASE_GUARD[kind]), found).otherwise(empty("struct<s:int,e:int,t:string,left:string,right:string>"))


def base_spans(text: Column) -> Column:
    """array of (s, k, e): the base rules' spans by start, then kind."""
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    parts = [F.transform(base_found(text, k), span(k)) for k in range(len(KINDS))]
    return F.when(text.rlike("[@0-9]"), F.array_sort(F.concat(*parts))).otherwise(empty(SPAN))


def cut(text: Column) -> Column:
    """The text in pieces of CUT characters, which `part` takes from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def part(pieces: Column, at: Column, n: Column) -> Column:
    """`n` characters from the 0-based place `at` on, without reading what stands before its piece."""
    first = F.floor(at / CUT).cast("int")
    last = F.floor((at + n) / CUT).cast("int")
    some = F.when(first == last, F.coalesce(F.get(pieces, first), F.lit(""))).otherwise(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""))
    return F.substring(some, at - first * CUT + 1, n)


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """`text` with spans, or chains of overlapping ones, replaced: by(span, how many of its characters are not replaced yet)."""

    def over(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty("string").alias("out"))

        def step(a: Column, x: Column) -> Column:
            gap = F.when(x["s"] > a["at"], part(pieces, a["at"], x["s"] - a["at"])).otherwise(F.lit(""))
            new = F.array(gap, by(x, F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["at"]))))
            return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], new).alias("out"))

        rest = lambda a: F.concat(F.array_join(a["out"], ""), part(pieces, a["at"], F.length(text) - a["at"]))
        return bound(fold(spans, start, step), rest)

    return F.when(F.size(spans) == 0, text).otherwise(bound(cut(text), over))


def blanked(text: Column, spans: Column) -> Column:
    """`text` with the characters of spans made NULs, which no generator takes."""
    return replaced(text, spans, lambda x, n: F.repeat(F.lit("\0"), n))


def features(kind: int, t: Column, left: Column, right: Column) -> list[Column]:
    """digits, separators, letters, length, Luhn, a cue before, glued to a word, digit groups, a group over 3 digits, brackets."""
    n = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    glued = left.rlike("[A-Za-z0-9_]$") | right.rlike("^[A-Za-z0-9_]")
    return [
        n("[0-9]"), n("[^A-Za-z0-9]"), n("[A-Za-z]"), F.length(t), luhn(digits_of(t)).cast("int"), F.lower(left).rlike(CUES[kind]).cast("int"),
        glued.cast("int"), F.regexp_count(t, F.lit("[0-9]+")), t.rlike("[0-9]{4}").cast("int"), t.rlike(r"[\[(]").cast("int"),
    ]


def features_py(kind: int, t: str, left: str, right: str) -> list[int]:
    """The same features of a made example."""
    n = lambda p: len(re.findall(p, t))
    d = [int(c) for c in t if c.isdigit()][::-1]
    ok = sum(x if i % 2 == 0 else x * 2 % 10 + (x > 4) for i, x in enumerate(d)) % 10 == 0
    glued = bool(re.search("[A-Za-z0-9_]$", left) or re.search("^[A-Za-z0-9_]", right))
    return [
        n("[0-9]"), n("[^A-Za-z0-9]"), n("[A-Za-z]"), len(t), int(ok), int(bool(re.search(CUES[kind], left.lower()))), int(glued), n("[0-9]+"),
        int(bool(re.search("[0-9]{4}", t))), int(bool(re.search(r"[\[(]", t))),
    ]


@cache
def examples(kind: int, rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Made candidates of one kind with labels: half are personal data in a known form, half are look-alikes."""
    rng = random.Random(f"{seed}:{kind}")
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    cue = rng.choice
    plain = ("the order ", "total of ", "version ", "page ", "in the ", "number ", "and ", "of ")
    x, y = [], []
    for i in range(rows):
        hit = i % 2 == 0
        left, right = cue(plain) if rng.random() < 0.5 else f"{word()} ", cue((" ", ".", ",", f" {word()}"))
        if kind == 0:
            at, dot = (cue(("(at)", " [at] ", " (at) ", "[at]")), cue((".", " (dot) ", "[dot]"))) if hit else (cue((" @", "@ ", " @ ")), ".")
            t = f"{word()}{cue(('', '.', '_'))}{word()}{at}{word()}{dot}{cue(('com', 'org', 'net', 'de') if hit else (word(), num(2)))}"
            left = cue(("mail: ", "contact ", "write to ")) if hit and rng.random() < 0.6 else left
        elif kind == 1:
            dot = cue(("[.]", "[dot]", "(dot)")) if hit else "."
            t = dot.join(str(rng.randint(0, 255)) if hit else num(rng.randint(1, 3)) for _ in range(4 if hit else rng.randint(4, 6)))
            left = cue(("IP ", "host ", "server ")) if hit and rng.random() < 0.6 else left
        elif kind == 2:
            t = cue((" ", "-")).join(num(4) for _ in range(4)) if hit else cue((num(rng.randint(13, 19)), ".".join(num(3) for _ in range(5)), "/".join(num(rng.randint(2, 4)) for _ in range(5))))
            left = cue(("card ", "visa no. ", "credit card: ", "pay by ")) if hit else left
            t = num(16) if hit and rng.random() < 0.3 else t
        else:
            t = cue((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)}-{num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}")) if hit else cue((
                f"{num(3)}.{num(3)}.{num(3)}", f"20{num(1)} {num(4)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)}/{num(4)}/{num(3)}",
            ))
            left = cue(("tel. ", "phone ", "call ", "fax: ", "mobile ")) if hit and rng.random() < 0.7 else left
        if not hit and rng.random() < 0.2:
            right = word()
        x.append(features_py(kind, t, left[-CONTEXT:], right))
        y.append(hit)
    return np.array(x, float), np.array(y)


@cache
def model(kind: int) -> Model:
    """The trees that made examples alone give."""
    return fit(*examples(kind))


def impossible(kind: int, t: Column) -> Column:
    """Whether a candidate cannot be personal data of its kind, however it is written."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\x20?[\[(]at[\])]\x20?|\x20?@\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?|\[\.\]", "."), "/", "-")
    if kind == 0:
        return ~plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    if kind == 1:
        return (F.size(F.split(plain, r"\.")) != 4) | ~valid(1, plain)
    return ~valid(kind, plain)


def real_examples(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS, rows: int = REAL_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind, features and labels of at most `rows` spans a label from about `sample` documents, drawn by hashes.

    A text is drawn if its hash is below the share that the sample has of all documents, so nothing is sorted or moved but
    the texts drawn, and copies of a text count once.
    """
    texts = docs.select(text_of(text).alias("t")).where("t <> ''")
    n = max(1, docs.count())
    some = texts.where(F.xxhash64("t") <= min(sample, n) * (2**64 - 1) // n - 2**63).distinct()
    some = some.withColumn("base", base_spans(F.col("t"))).withColumn("rest", blanked(F.col("t"), F.col("base")))
    none = empty("struct<k:int,y:int,x:array<double>>")

    def labelled(k: int) -> list[Column]:
        told = lambda y: lambda x: F.struct(F.lit(k).alias("k"), F.lit(y).alias("y"), F.array(*[f.cast("double") for f in features(k, x["t"], x["left"], x["right"])]).alias("x"))
        not_data = F.filter(located(F.col("rest"), WIDE[k]), lambda x: impossible(k, x["t"]))
        return [F.transform(base_found(F.col("t"), k), told(1)), F.when(F.col("rest").rlike(WIDE_GUARD[k]), F.transform(not_data, told(0))).otherwise(none)]

    spans = [x for k in range(len(KINDS)) for x in labelled(k)]
    each = some.select(F.explode(F.concat(*spans)).alias("one")).select("one.*").distinct()
    order = Window.partitionBy("k", "y").orderBy(F.xxhash64("x"), "x")
    found = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).collect()  # 8 x rows at most
    out = {}
    for k in range(len(KINDS)):
        own = sorted((list(r["x"]), r["y"]) for r in found if r["k"] == k)
        out[k] = np.array([x for x, _ in own], float).reshape(-1, N_FEATURES), np.array([y for _, y in own], bool)
    return out


def models(docs: DataFrame, text: str = "text") -> list[Model]:
    """The trees by kind, from made examples and the documents' own."""
    real, out = real_examples(docs, text), []
    for k in range(len(KINDS)):
        x, y = examples(k)
        out.append(fit(np.concatenate([x, real[k][0]]), np.concatenate([y, real[k][1]])))
    return out


def scored(kind: int, trees: Model) -> Callable[[Column], Column]:
    """(s, k, e, p) of a located candidate; p is the log odds over the threshold."""

    def of(x: Column) -> Column:
        p = trees.column([f.cast("double") for f in features(kind, x["t"], x["left"], x["right"])]) - trees.threshold
        return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), p.alias("p"))

    return of


def candidates(text: Column, trees: list[Model]) -> Column:
    """array of (s, k, e, p) that the trees select, by start, then kind; they may overlap."""
    none = empty("struct<s:int,k:int,e:int,p:double>")
    parts = []
    for k, (pattern, guard) in enumerate(zip(WIDE, WIDE_GUARD, strict=True)):
        found = F.filter(F.transform(located(text, pattern), scored(k, trees[k])), lambda x: x["p"] >= 0)
        parts.append(F.when(text.rlike(guard), found).otherwise(none))
    return F.when(text.rlike(r"[0-9@]|[\[(]at[\])]"), F.array_sort(F.concat(*parts))).otherwise(none)


def settled(more: Column) -> Column:
    """array of (s, k, e): of candidates that overlap, the more probable one, from left to right."""
    start = F.struct(F.lit(None).cast("struct<s:int,k:int,e:int,p:double>").alias("held"), empty(SPAN).alias("out"))
    span = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))

    def step(a: Column, x: Column) -> Column:
        held = a["held"]
        apart = F.struct(x.alias("held"), F.concat(a["out"], F.array(span(held))).alias("out"))
        better = F.struct(F.when(x["p"] > held["p"], x).otherwise(held).alias("held"), a["out"].alias("out"))
        return F.when(held.isNull(), F.struct(x.alias("held"), a["out"].alias("out"))).when(x["s"] >= held["e"], apart).otherwise(better)

    whole = bound(fold(more, start, step), lambda a: F.concat(a["out"], F.array(span(a["held"]))))
    return F.when(F.size(more) == 0, empty(SPAN)).otherwise(whole)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text", trees: list[Model] | None = None) -> DataFrame:
    """`docs` with base_spans and all_spans, arrays of (s, k, e). trees: fitted ones, in place of `models(docs)`."""
    docs = docs.drop("base_spans", "all_spans")
    trees = models(docs, text) if trees is None else trees
    t = text_of(text)
    found = bound(base_spans(t), lambda b: F.struct(b.alias("base_spans"), bound(blanked(t, b), lambda rest: F.array_sort(F.concat(b, bound(candidates(rest, trees), settled)))).alias("all_spans")))
    name = private(docs, "_found")
    return docs.withColumn(name, found).withColumns({c: F.col(name)[c] for c in ("base_spans", "all_spans")}).drop(name)


def redacted(text: Column, spans: Column) -> Column:
    """`text` with each span, or chain of overlapping spans, replaced by the first one's kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # A span that begins within the one before takes nothing of its own, but may lengthen what is replaced.
    chained = F.struct(F.lit(0).alias("end"), empty("struct<s:int,k:int,e:int,first:boolean>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        one = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), (x["s"] >= a["end"]).alias("first"))
        return F.struct(F.greatest(a["end"], x["e"]).alias("end"), F.concat(a["out"], F.array(one)).alias("out"))

    marked = fold(spans, chained, step)["out"]
    return F.when(F.size(spans) == 0, text).otherwise(bound(marked, lambda m: replaced(text, m, lambda x, n: F.when(x["first"], F.get(names, x["k"])).otherwise(F.lit("")))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with spans of the text replaced by their kinds."""
    found = with_spans(docs.select(F.struct("*").alias("row"), F.col(text)), text)
    names = [c for c in docs.columns if c != text]
    return found.withColumn(text, redacted(text_of(text), F.col("all_spans"))).select(*[F.col("row")[c].alias(c) if c in names else F.col(text) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")
    n = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("all_spans")).alias("spans"))
