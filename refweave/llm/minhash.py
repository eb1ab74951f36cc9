"""Near-duplicate groups by BagMinHash signatures over multisets of word shingles.

Each text is a multiset of five-word shingles. Element d of weight w owns a Poisson process on [0, w) x components: the
weight axis is cut at 0, 1, 2, 4, 8, ...; each cut interval is a stream of points in time order, from a counter-based
generator keyed by the shingle and the interval, and each point also draws where in its interval it lies, so that weights
inside the interval keep just the points below them (the hierarchical split). A signature component is the first point
that reaches it; a stream stops once its time is past the largest component. Two signatures agree in a component with
probability sum(min) / sum(max) of the weights.

Signatures are cut into bands, and links are verified on the multisets in two rounds. First every text with the main centre
of each of its band values: of a value's texts the one that shares most values with others, which in a family of copies is the
text nearest to all; the values of a family have few centres between them, so a group of n copies costs a few verifications a
copy. Then, where the texts of a band value are still in several groups, every two of them of different groups are compared
(`crossed`): all texts that share a main centre at once, or each value for itself, whichever are fewer pairs, in blocks of
bounded size that give back no more links than join their groups. So any two texts that share a band value are in one group or
have been compared, and no pair list is ever made. The second round takes time with the square of a family's size, if its texts
are like each other but just not similar enough.

Defined results: a null text is empty; equal texts are copies, empty ones included; a text of one to four words is one
shingle of all its words; a text without words is like no other text; a group's id is its smallest doc_id (nulls last);
repeated rows are copies; an empty table gives an empty result; further columns, whatever their names, pass through
`keep_one`. Texts are told apart by 128-bit hashes. A very long text is read whole, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import intermediates, let_go, materialize, private, runs, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Texts that are compared at once: those of one or two blocks of about this many.
BLOCK = 128
#: Batches are cut at this many bytes of text.
BATCH_BYTES = 4 << 20
_U = np.uint64
MASK = (1 << 64) - 1
_P = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(_P) | 1
    up, down = np.full(n + 1, _U(base)), np.full(n + 1, _U(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


_held: list[tuple[np.ndarray, np.ndarray]] = [powers(1 << 10)]


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n at least; those for a usual batch are kept, those for a longer text are made anew."""
    if len(_held[0][0]) > n:
        return _held[0]
    if n > BATCH_BYTES:
        return powers(n)
    _held[0] = powers(min(2 * n, BATCH_BYTES))
    return _held[0]


def release() -> None:
    """Let go of what a partition has needed."""
    _held[0] = powers(1 << 10)
    let_go()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word of the documents data[offsets[i]:offsets[i + 1]], in order."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | begins[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    up, down = tables(len(data))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
    hashes = mixed((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by document, then shingle: each document's multiset of k-word shingles."""
    words, doc = word_hashes(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), words, np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    made, of = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(words) >= k:
        at = np.flatnonzero(doc[: len(words) - k + 1] == doc[k - 1 :])
        made = words[at]
        for j in range(1, k):
            made = mixed(made * _P + words[at + j])
        of = doc[at]
    short = [(d, words[first[d] : first[d] + n[d]]) for d in np.flatnonzero((n > 0) & (n < k))]
    if short:
        one = []
        for _, ws in short:
            h = ws[:1]
            for w in ws[1:]:
                h = mixed(h * _P + w)
            one.append(mixed(h + _U(len(ws))))
        made, of = np.concatenate([made, *one]), np.concatenate([of, [d for d, _ in short]])
    order = np.lexsort((made, of))
    made, of = made[order], of[order]
    new = np.concatenate([[True], (made[1:] != made[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    return of[at], made[at], np.diff(np.concatenate([at, [len(made)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """docs x m first times; infinite where a document has no element."""
    sig = np.full(docs * m, np.inf)
    streams = [(doc, mixed(element), weight, np.ones(len(doc)), np.zeros(len(doc), np.int64))]
    low = 1
    while (more := weight > low).any():  # interval [low, 2 low), as long as any weight reaches into it
        d, e = doc[more], element[more]
        streams.append((d, mixed(element[more] + _U(int(_P) * low & MASK)), weight[more], np.full(len(d), float(low)), np.full(len(d), low)))
        low *= 2
    d, key, w, rate, low_ = (np.concatenate(x) for x in zip(*streams, strict=True))
    time, t = np.zeros(len(d)), 0
    while len(d):
        t += 1
        draw = mixed(key + _U(int(_P) * t & MASK))
        u = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / (rate * m)
        other = mixed(draw ^ _U(0xD6E8FEB86659FD93))
        part = ((other >> _U(32)) % _U(m)).astype(np.int64)
        place = low_ + ((other & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * np.maximum(low_, 1)).astype(np.int64)
        good = place < w
        np.minimum.at(sig, d[good] * m + part[good], time[good])
        if t == 1 or t % 4 == 0 or len(d) > 4096:
            table = sig.reshape(docs, m)
            live = np.unique(d)
            worst = np.full(docs, -1.0)
            worst[live] = table[live].max(axis=1)
            on = time < worst[d]
            d, key, w, rate, low_, time = d[on], key[on], w[on], rate[on], low_[on], time[on]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(_U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _P, bits.shape[:2])
    for r in range(rows):
        key = mixed(key * _P + bits[:, :, r])
    return key.view(np.int64)


def slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a string column of about `most` bytes: (first row, end row, bytes, offsets)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1), len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def node_of(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("b"), F.md5(text))


def with_node(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, DataFrame]:
    """(`docs` with a column for the text's hash, its name, (node, first_id) a text).

    Texts that share the first hash by chance (about one pair in 10 billion texts squared over 2**64) go by both hashes;
    they are few, found by one count a hash, and joined back by a broadcast of bounded size or, beyond it, by a plain join.
    """
    one, two = node_of(text_of(text))
    h, g = private(docs, "_h"), private(docs, "_g")
    hashed = docs.withColumns({h: one, g: two})
    seen = materialize(hashed.groupBy(F.col(h).alias("h")).agg(F.min("doc_id").alias("first_id"), F.min(g).alias("a"), F.max(g).alias("b")), "nodes")
    clash = seen.where("a <> b").select(F.col("h").alias(f"{h}_"), F.lit(True).alias(f"{g}_"))
    if clash.isEmpty():
        return hashed.drop(g), h, seen.select(F.col("h").alias("node"), "first_id")
    both = F.when(F.col(f"{g}_"), F.xxhash64(h, g)).otherwise(F.col(h))
    hashed = hashed.join(materialize(clash, "clashes"), F.col(h) == F.col(f"{h}_"), "left").withColumn(h, both).drop(g, f"{h}_", f"{g}_")
    return hashed, h, materialize(hashed.groupBy(F.col(h).alias("node")).agg(F.min("doc_id").alias("first_id")), "nodes")


def again(key: Column) -> Column:
    """The same number as an expression that Spark does not see through, so that a join deals its rows anew."""
    return F.bitwise_not(F.bitwise_not(key))


def bands(nodes: DataFrame) -> DataFrame:
    """(node, key) for each band of each row's (_node, _text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column(1)):
                sig = signatures(*shingles(data, offsets), b - a)
                full = np.isfinite(sig[:, 0])
                keys = band_keys(sig[full])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[a:b][full], BANDS)), pa.array(keys.ravel())], ["node", "key"])
        release()

    return nodes.mapInArrow(made, "node long, key long")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted elements, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum())
    return low / (total - low) if total else 0.0


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, elements, weights = shingles(data, np.array([0, len(data)]))
    return elements, weights


def verified(links: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (node, centre) whose multisets are similar enough."""
    left = links.join(texts.select(F.col("node"), F.col("text").alias("a")), "node")
    right = left.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("b")), "centre").select("node", "centre", "a", "b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for low, high in runs(a, b):
                good = []
                for x, c, text, centre in zip(*(column.slice(low, high - low).to_pylist() for column in (batch.column("node"), batch.column("centre"), a, b)), strict=True):
                    if c != last:
                        last, known = c, multiset(centre)
                    good.append(overlap(multiset(text), known) >= similarity - 1e-12 and x is not None)
                yield batch.slice(low, high - low).select(["node", "centre"]).filter(pa.array(good, pa.bool_()))
        release()

    return materialize(right.mapInArrow(checked, "node long, centre long"), "links")


def overlaps(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """docs x docs, filled above the diagonal: the sum of the smaller weights of each two multisets sorted by document."""
    # The k-th copy of an element is an element of its own: what two sets share is then a product of 0-1 matrices.
    copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    one = mixed(np.repeat(element, weight) + copy.astype(_U) * _P)
    order = np.argsort(one, kind="stable")
    one, of = one[order], np.repeat(doc, weight)[order]
    begins = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])[: len(one)])
    n = np.diff(np.concatenate([begins, [len(one)]]))
    column, held = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
    table = np.zeros((docs, docs))
    few = np.flatnonzero((held > 1) & (held <= 8))
    c, d = column[few], of[few]
    for step in range(1, 8):
        at = np.flatnonzero(c[step:] == c[:-step])
        table += np.bincount(d[at] * docs + d[at + step], minlength=docs * docs).reshape(docs, docs)
    many = np.flatnonzero(held > 8)
    if len(many):
        c, d = np.unique(column[many], return_inverse=True)[1], of[many]
        for low in range(0, int(c[-1]) + 1, 4096):
            a, b = np.searchsorted(c, (low, low + 4096))
            dense = np.zeros((docs, 4096), np.float32)
            dense[d[a:b], c[a:b] - low] = 1
            table += dense @ dense.T
    return np.triu(table, 1)


def forest(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> list[int]:
    """Of the links a[i]-b[i], those that join groups not yet joined by the ones before."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    _, first = np.unique(np.stack([group[a], group[b]]), axis=1, return_index=True)
    chosen = []
    for i in first.tolist():
        x, y = top(int(group[a[i]])), top(int(group[b[i]]))
        if x != y:
            up[x] = y
            chosen.append(i)
    return chosen


def cells(linked: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, root, block, x, y): texts to compare, those of a bucket in blocks, each two blocks being a cell.

    linked: (node, key, main). A bucket holds the texts of one band value, or of all values with one main centre where that
    makes fewer pairs; buckets whose texts are in one group go. Values of two texts are left out, whose one link has been
    verified.
    """
    here = linked.join(roots.select(again(F.col("node")).alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    here = materialize(here.select("node", "key", "main", "root"), "rooted")
    wide = here.groupBy("key", "main").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("n > 2 and _a <> _b").select("key", "main", "n")
    left = materialize(here.drop("main").join(wide.select(again(F.col("key")).alias("key"), "main", "n"), "key").select("node", "root", "key", "main", "n"), "several")
    apart = left.select("key", "main", "n").distinct().groupBy("main").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    whole = left.select("main", "node").distinct().groupBy("main").agg(F.count(F.lit(1)).cast("double").alias("all"))
    best = whole.join(apart, "main").select(again(F.col("main")).alias("main"), (F.col("all") * F.col("all") <= F.col("apart")).alias("at_once"))
    bucket = F.when(F.col("at_once"), F.xxhash64(F.lit("main"), "main")).otherwise(F.col("key"))
    rows = materialize(left.join(best, "main").select(bucket.alias("bucket"), "node", "root").distinct(), "buckets")
    size = rows.groupBy(again(F.col("bucket")).alias("bucket")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("p"))
    rows = rows.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "p").cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return rows.select("bucket", "node", "root", "block", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"))


def crossed(linked: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Similar texts (node, centre) of different groups that share a band value; all such texts are compared."""
    rows = materialize(cells(linked, roots), "cells")
    rows = rows.join(texts.select(again(F.col("node")).alias("node"), "text"), "node")

    def compared(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, block, x, y = (table.column(c).to_numpy() for c in ("node", "root", "block", "x", "y"))
        group, n = np.unique(root, return_inverse=True)[1].ravel(), len(node)
        a = b = np.zeros(0, np.int64)
        if n and group.any():
            made, base = [], 0
            column = table.column("text")
            for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
                for low, _, data, offsets in slices(chunk):
                    d, e, w = shingles(data, offsets)
                    made.append((d + base + low, e, w))
                base += len(chunk)
            doc, element, weight = (np.concatenate(z) for z in zip(*made, strict=True))
            both, total = overlaps(doc, element, weight, n), np.bincount(doc, weight, n)
            either = total[:, None] + total[None, :] - both
            near = (both > 0) & (both >= (similarity - 1e-12) * either) & (group[:, None] != group[None, :])
            if x[0] != y[0]:
                near &= block[:, None] != block[None, :]
            a, b = np.nonzero(near)
        good = forest(a, b, group) if len(a) else []
        return pa.table({"node": pa.array(node[a[good]], pa.int64()), "centre": pa.array(node[b[good]], pa.int64())})

    return materialize(rows.groupBy("bucket", "x", "y").applyInArrow(compared, "node long, centre long"), "crossed")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is one node of its group.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends, and puts the ends in the
    links' place; links inside a group go. A round at least halves the groups.
    """
    links = links.select(F.col("node").alias("u"), F.col("centre").alias("v")).where("u <> v")
    roots: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialize(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "hooks")
        while True:
            up = hook.select(again(F.col("u")).alias("p"), F.col("p").alias("q"))
            hook = materialize(hook.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hooks")
            if hook.where("moved").isEmpty():
                break
        hook = hook.drop("moved")
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = hook.select(again(F.col("u")).alias("root"), F.col("p").alias("_q"))
            roots = materialize(roots.join(up, "root", "left").select("node", F.coalesce("_q", "root").alias("root")), "roots")
        for side in ("u", "v"):
            up = hook.select(again(F.col("u")).alias(side), F.col("p").alias("_q"))
            links = links.join(up, side).drop(side).withColumnRenamed("_q", side)
        links = materialize(links.where("u <> v").select("u", "v").distinct(), "contracted")
    return roots if roots is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, str, DataFrame]:
    """(`docs` with a column for the text's hash, its name, one row a text: (node, first_id, root, group_id))."""
    docs, h, nodes = with_node(docs, text)
    with intermediates(docs.sparkSession) as keep:
        found = linked_groups(docs.select(F.col(h).alias("_node"), "doc_id", text_of(text).alias("text")), nodes, similarity)
        keep.append(found)
    return docs, h, found


def linked_groups(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    banded = materialize(bands(docs.select("_node", "text")), "bands")
    wide = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_a"), F.max("node").alias("_b")).where("_a <> _b")
    shared = materialize(banded.join(wide.select(again(F.col("key")).alias("key"), "n"), "key").select("node", "key", "n").distinct(), "shared")
    # Who shares most band values with others is most like them: the first centre of each of its values.
    ties = shared.groupBy(again(F.col("node")).alias("node")).agg(F.sum("n").alias("ties"))
    known = shared.join(ties, "node")
    centres = known.groupBy(again(F.col("key")).alias("key")).agg(F.max_by("node", F.struct("ties", "node")).alias("main"))
    linked = materialize(shared.join(centres, "key").select("node", "key", "main"), "linked")
    met = materialize(linked.where("node <> main").select("node", F.col("main").alias("centre")).distinct(), "candidates")
    # Texts that share a band value, one row each, picked by text and id so that copies do not meet.
    ends = shared.select("node").distinct()
    wanted = materialize(
        ends.join(nodes.select(again(F.col("node")).alias("node"), "first_id"), "node").select(F.col("node").alias("_node"), F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("_id")),
        "wanted",
    )
    own = docs.select("_node", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    # One plan at every size: the texts are dealt by key, whether or not the wanted keys would fit a broadcast today.
    texts = materialize(own.join(wanted.hint("merge"), ["_node", "_id"], "left_semi").dropDuplicates(["_node", "_id"]).select(F.col("_node").alias("node"), "text"), "texts")
    links = verified(met, texts, similarity)
    roots = components(links)
    # Texts that are like each other may both be unlike their centres.
    more = crossed(linked, roots, texts, similarity)
    if not more.isEmpty():
        roots = components(links.union(more))
    known = nodes.join(roots.select(again(F.col("node")).alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = known.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return materialize(known.join(best.select(again(F.col("root")).alias("root"), "group_id"), "root").select("node", "first_id", "root", "group_id"), "groups")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, copy_of (smallest doc_id with the same text), group_id (smallest doc_id of the near-duplicate group)."""
    docs, h, found = groups(docs.select("doc_id", "text"))
    return docs.select("doc_id", h).join(found.select(again(F.col("node")).alias(h), F.col("first_id").alias("copy_of"), "group_id"), h).select("doc_id", "copy_of", "group_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, one a group: that with the group's smallest doc_id, and only one if its row is repeated."""
    noded, h, found = groups(docs, text)
    i = private(noded, "_id")
    best = found.groupBy("root").agg(F.min_by("node", F.struct(F.col("first_id").isNull(), "first_id", "node")).alias(h), F.min("first_id").alias("_f"))
    best = materialize(best.select(h, F.coalesce(F.col("_f").cast("string"), F.lit("")).alias(i)), "kept")
    rows = noded.withColumn(i, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.join(best, [h, i], "left_semi").dropDuplicates([h, i]).drop(h, i)
