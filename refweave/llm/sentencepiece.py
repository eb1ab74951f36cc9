"""SentencePiece encoding and decoding with a suffix array over a batch's text.

A model's file is read by its wire format; nothing is trained. The distinct stretches of a batch's normalised text
(a stretch is a run of blanks with the word after it; no piece crosses into the next one, which is checked) are
concatenated and indexed by a suffix array. A binary search finds every piece's range of occurrences. The occurrences
are edges of a lattice; they are sorted by the position where they end and relaxed from left to right, all stretches at
once: an edge is taken if the piece that the text before it ends in may stand before its own piece. That leaves exactly
the pieces that merging by score gives, because a sequence of pieces is what merging gives if and only if each two
neighbours are. Whether two pieces may be neighbours follows from undoing their merges, latest first: at no time may the
two halves at the border form a piece that comes before the merge undone.

Characters that no piece has become byte pieces. Nothing but verdicts on pairs is kept from batch to batch, in a table of
PAIR_SLOTS slots whose entries give way to newer ones.

Defined results: a null text is empty and has no pieces; repeated rows are encoded as often as they occur; equal scores
go to the left pair; an empty table gives an empty result; further columns pass through `encode`, `decode` and `recode`
unless they bear the names of columns that those add, which then replace them. A very long text is encoded whole: its
stretches are indexed INDEXED characters at a time, and a stretch that is longer by itself takes memory in proportion.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import let_go, runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Types of pieces in a model's file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of distinct stretches that are indexed at once, and bytes of text that are encoded at once.
INDEXED, ENCODED = 200_000, 4 << 20
#: Verdicts on pairs of pieces that are kept.
PAIR_SLOTS = 1 << 20
#: Stretches over this many characters are relaxed one by one.
LONG = 200
NEVER = float("inf")
#: In place of a piece: nothing reaches here; a stretch starts here; a character as bytes.
NONE, AT_START, AS_BYTES = -3, -1, -2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and the normaliser's switches of a model file's bytes, and what merging says about the pieces."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        norm: dict[int, object] = {}
        kind = 1
        for number, value in fields(data):
            if number == 1:
                one = dict(fields(value))
                self.pieces.append(one.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.types.append(int(one.get(3, NORMAL)))
            elif number == 2:
                kind = int(dict(fields(value)).get(3, 1))
            elif number == 3:
                norm = dict(fields(value))
        if kind != 2 or norm.get(2):
            raise ValueError("only models that merge by score and do not map characters are read")
        self.prefix, self.trim, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        self.longest = max(map(len, self.ids))
        # Stretches may be cut before a blank that follows another character, if no piece holds that.
        self.cuts = not any(a != BLANK and b == BLANK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.out_at, self.out = self.written()
        self.merges()
        self.search_table()

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each piece's bytes begin, all pieces' bytes), as decoding writes them."""
        def of(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(BLANK, " ").encode()

        out = [of(p, t) for p, t in zip(self.pieces, self.types, strict=True)]
        return np.concatenate([[0], np.cumsum([len(x) for x in out])]), np.frombuffer(b"".join(out), np.uint8)

    def merges(self) -> None:
        """By id: rank (small ones merge first, -1 for characters), the two halves of a piece's last merge, whether
        merging the piece's text gives the piece (others are never used), whether a later merge ranks before an earlier
        one within it. And the rank of every two pieces' joined text, by sorted key."""
        n = len(self.pieces)
        order = np.unique([-s for s in self.scores], return_inverse=True)[1]
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.alone, self.odd = np.zeros(n, bool), np.zeros(n, bool)
        keys, ranks = [], []
        for piece, k in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                self.alone[k] = True
                continue
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(order[k])
            last: list[tuple[str, str]] = []
            if len(self.merged(piece, last)) == 1:
                a, b = (self.ids[x] for x in last[-1])
                self.rank[k], self.left[k], self.right[k], self.alone[k] = order[k], a, b, True
                self.odd[k] = self.odd[a] or self.odd[b] or max(self.rank[a], self.rank[b]) > order[k]
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[at], np.array(ranks, np.int64)[at]

    def search_table(self) -> None:
        """The usable pieces in order, as rows of character codes."""
        pieces = sorted(p for p, k in self.ids.items() if self.alone[k])
        self.sorted_ids = np.array([self.ids[p] for p in pieces])
        self.lengths = np.array([len(p) for p in pieces])
        self.table = np.zeros((len(pieces), self.longest), np.int32)
        for row, p in zip(self.table, pieces, strict=True):
            row[: len(p)] = [ord(c) for c in p]

    def normalised(self, text: str) -> str:
        if self.trim:
            text = " ".join(x for x in text.split(" ") if x)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", BLANK) if self.escape else text

    def merged(self, text: str, log: list[tuple[str, str]] | None = None) -> list[str]:
        """Merging by score: the best pair first, of equal ones the left one. log: takes the pairs in turn."""
        if len(text) > 64 and log is None:
            return self.merged_long(text)
        ids, scores = self.ids, self.scores
        rank = lambda both: -scores[k] if (k := ids.get(both)) is not None else NEVER
        parts = list(text)
        costs = [rank(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            if log is not None:
                log.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i])
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1])
        return parts

    def merged_long(self, text: str) -> list[str]:
        """The same for long texts: a heap holds the pairs."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a[i] and b[i] gives those two pieces."""
        n = len(self.pieces)
        good = np.ones(len(a), bool)
        strange = np.flatnonzero(self.odd[a] | self.odd[b])
        for i in strange.tolist():
            p, q = self.pieces[a[i]], self.pieces[b[i]]
            good[i] = self.merged(p + q) == [p, q]
        at = np.flatnonzero(~(self.odd[a] | self.odd[b]))
        a, b, limit = a[at], b[at], np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            key = a * n + b
            found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[found] == key) & (self.pair_ranks[found] < limit)
            good[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            # Of two equal merges the left one came first, so that the right one is undone first.
            one = ra > rb
            limit = np.where(one, ra, rb + 1)
            a, b = np.where(one, self.right[a], a), np.where(one, b, self.left[b])
        return good


    @cached_property
    def plain(self) -> tuple[dict[int, int], list[int], list[int], list[int]]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True)), self.rank.tolist(), self.left.tolist(), self.right.tolist()

    def neighbour(self, a: int, b: int) -> bool:
        """The same for one pair."""
        if self.odd[a] or self.odd[b]:
            return self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        (pairs, rank, left, right), n, limit = self.plain, len(self.pieces), NEVER
        while pairs.get(a * n + b, NEVER) >= limit:
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                a, limit = right[a], rank[a]
            else:
                b, limit = left[b], rank[b] + 1
        return False


def packed(codes: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The next `depth` codes from each position as numbers, as many codes in one as fit; past the end are zeros."""
    per, n = 63 // bits, len(codes)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(depth + per, np.int64)])
    out = []
    for first in range(0, depth, per):
        key = np.zeros(n, np.int64)
        for j in range(first, first + per):
            key <<= bits
            if j < depth:
                key |= padded[j : j + n]
        out.append(key)
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` characters."""
    letters, codes = np.unique(text, return_inverse=True)
    return np.lexsort(packed(codes.ravel() + 1, depth, int(len(letters) + 1).bit_length())[::-1])


def occurrences(text: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(position, row of model.table) of every occurrence of every usable piece, by binary search in the suffix array."""
    letters, codes = np.unique(text, return_inverse=True)
    bits = int(len(letters) + 1).bit_length()
    per, depth = 63 // bits, model.longest
    keys = packed(codes.ravel() + 1, depth, bits)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    place = np.minimum(np.searchsorted(letters, model.table), len(letters) - 1)
    wanted = np.where(letters[place] == model.table, place + 1, 0)
    inside = np.arange(depth) < model.lengths[:, None]
    rows = np.flatnonzero(((wanted > 0) | ~inside).all(axis=1))
    wanted, length = np.where(inside, wanted, 0)[rows], model.lengths[rows]
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
    for step, first in enumerate(range(0, depth, per)):
        at = np.flatnonzero((length > first) & (low < high))
        if not len(at):
            break
        least = np.zeros(len(at), np.int64)
        for j in range(first, first + per):
            least <<= bits
            if j < depth:
                least |= wanted[at, j]
        most = least | ((np.int64(1) << bits * np.maximum(first + per - length[at], 0)) - 1)
        low[at], high[at] = bisected(keys[step], least, low[at], high[at], False), bisected(keys[step], most, low[at], high[at], True)
    size = high - low
    piece = np.repeat(rows, size)
    at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return order[at], piece


def bisected(keys: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, right: bool) -> np.ndarray:
    """In each range keys[low[i]:high[i]], which is in order, the first place not below wanted[i] (right: above it)."""
    if len(low) and (low == 0).all() and (high == len(keys)).all():
        return np.searchsorted(keys, wanted, side="right" if right else "left")
    a, b = low.copy(), high.copy()
    while (on := a < b).any():
        mid = (a + b) >> 1
        found = keys[np.minimum(mid, len(keys) - 1)]
        up = on & ((found <= wanted) if right else (found < wanted))
        a = np.where(up, mid + 1, a)
        b = np.where(on & ~up, mid, b)
    return a


class Encoder:
    """Encodes and decodes batches."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.seen: np.ndarray | None = None

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """model.neighbours with verdicts kept in a table of PAIR_SLOTS numbers: twice the key, and the verdict."""
        if self.seen is None:
            self.seen = np.full(PAIR_SLOTS, -2, np.int64)
        key = a * len(self.model.pieces) + b
        slot = (key * np.int64(0x9E3779B97F4A7C1)) >> 20 & (PAIR_SLOTS - 1)
        held = self.seen[slot]
        good = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            once, of = np.unique(key[new], return_inverse=True)
            n = len(self.model.pieces)
            verdict = self.model.neighbours(once // n, once % n)
            good[new] = verdict[of.ravel()]
            self.seen[slot[new]] = key[new] << 1 | good[new]
        return good

    def stretches(self, text: str) -> list[str]:
        text = self.model.normalised(text)
        if not text:
            return []
        if not self.model.cuts:
            return [text]
        parts = text.split(BLANK)
        if "" not in parts[1:]:
            return ([parts[0]] if parts[0] else []) + [BLANK + x for x in parts[1:]]
        out, run = ([parts[0]] if parts[0] else []), 0
        for x in parts[1:]:
            run += 1
            if x:
                out.append(BLANK * run + x)
                run = 0
        return out + [BLANK * run] * bool(run)

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each stretch's begin among them) of stretches of normalised text."""
        model = self.model
        joined = "\0".join(stretches) + "\0"  # a NUL is no piece; one within a stretch is an unknown character all the same
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(s) for s in stretches])
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        start_of = np.repeat(begins[:-1], lengths + 1)
        at, row = occurrences(text, model)
        end, ids = at + model.lengths[row], model.sorted_ids[row]
        covered = np.zeros(len(text), bool)
        covered[at[model.lengths[row] == 1]] = True
        covered[begins[1:] - 1] = True  # the NULs between stretches are no edges
        lost = np.flatnonzero(~covered)
        at, end, ids = np.concatenate([at, lost]), np.concatenate([end, lost + 1]), np.concatenate([ids, np.full(len(lost), AS_BYTES)])
        # last[p]: the piece that the text up to p ends in; back[p]: where it starts.
        last, back = np.full(len(text) + 1, NONE), np.zeros(len(text) + 1, np.int64)
        last[begins] = AT_START
        upto = np.minimum(end - start_of[at], LONG + 1).astype(np.int16)
        long = np.repeat(lengths > LONG, lengths + 1)[at] if (lengths > LONG).any() else np.zeros(len(at), bool)
        every = np.argsort(upto, kind="stable")
        every = every[~long[every]]
        cut = np.searchsorted(upto[every], np.arange(1, LONG + 2))
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                break
            now = every[a:b]
            before, k = last[at[now]], ids[now]
            fits = (before != NONE) & ((before < 0) | (k < 0))
            both = np.flatnonzero((before >= 0) & (k >= 0))
            fits[both] = self.fits(before[both], k[both])
            taken = now[fits]
            last[end[taken]], back[end[taken]] = ids[taken], at[taken]
        if long.any():
            self.relax_long(np.flatnonzero(long), at, end, ids, last, back)
        ends = begins[1:] - 1
        if (last[ends[lengths > 0]] == NONE).any():
            raise AssertionError("every stretch has a path")
        on_path = np.zeros(len(text) + 1, bool)
        here, floor = ends[lengths > 0], begins[:-1][lengths > 0]
        while len(here):
            on_path[here] = True
            here = back[here]
            on = here > floor
            here, floor = here[on], floor[on]
        places = np.flatnonzero(on_path)
        flat = last[places]
        of = np.searchsorted(begins, places - 1, side="right") - 1
        if (flat == AS_BYTES).any():
            as_ids = [[model.bytes.get(x, model.unknown) for x in joined[p - 1].encode("utf-8", "surrogatepass")] if k == AS_BYTES else [k] for p, k in zip(places.tolist(), flat.tolist(), strict=True)]
            of = np.repeat(of, [len(x) for x in as_ids])
            flat = np.array([k for x in as_ids for k in x])
        return flat.astype(np.int32), np.searchsorted(of, np.arange(len(stretches) + 1))

    def relax_long(self, edges: np.ndarray, at: np.ndarray, end: np.ndarray, ids: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """The edges of long stretches one by one."""
        known: dict[int, bool] = {}
        n = len(self.model.pieces)
        edges = edges[np.argsort(end[edges], kind="stable")]
        tail, from_ = {}, {}
        for e, a, p, k in zip(edges.tolist(), at[edges].tolist(), end[edges].tolist(), ids[edges].tolist(), strict=True):
            before = tail.get(a)
            if before is None:
                before = int(last[a])
            if before >= 0 and k >= 0:
                fits = known.get(before * n + k)
                if fits is None:
                    if len(known) > PAIR_SLOTS // 4:
                        known.clear()
                    fits = known[before * n + k] = self.model.neighbour(before, k)
            else:
                fits = before != NONE
            if fits:
                tail[p], from_[p] = k, a
        places = np.array(list(tail), np.int64)
        last[places], back[places] = list(tail.values()), [from_[p] for p in tail]

    def index(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode_stretches over any number of stretches, about INDEXED characters at a time."""
        flats, begins, base, a = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
        while a < len(new):
            b, size = a, 0
            while b < len(new) and (b == a or size + len(new[b]) <= INDEXED):
                size += len(new[b]) + 1
                b += 1
            flat, begin = self.encode_stretches(new[a:b])
            flats.append(flat)
            begins.append(begin[1:] + base)
            base, a = base + len(flat), b
        return np.concatenate(flats), np.concatenate(begins)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts among them)."""
        number: dict[str, int] = {}
        which, of = [], [0]
        for t in texts:
            which.extend([number.setdefault(s, len(number)) for s in self.stretches(t or "")])
            of.append(len(which))
        flat, begin = self.index(list(number))
        which = np.array(which, np.int64)
        n = begin[which + 1] - begin[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[which] - ends[:-1], n) + np.arange(ends[-1])
        return flat[at], ends[np.array(of)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        m = self.model
        n = m.out_at[ids + 1] - m.out_at[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(m.out_at[ids] - ends[:-1], n) + np.arange(ends[-1])
        data, cut = m.out[at].tobytes(), ends[offsets].tolist()
        # The prefix blank is none of the text; bytes that are no text become replacement characters.
        return [(s[1:] if m.prefix and s.startswith(" ") else s) for s in (data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False))]


@cache
def encoder(data: bytes) -> Encoder:
    """Made on the driver, once a model."""
    return Encoder(data)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:  # the tokenizer's folder is a parameter, local to the driver
        return f.read()


def mapped(df: DataFrame, from_: str, added: list[tuple[str, T.DataType]], make: Callable[[Encoder, pa.Array], list[pa.Array]], model: str, keep_input: bool = True) -> DataFrame:
    """`df` with the columns that `make` gives for a run of rows of the column `from_`, in one pass through Python."""
    shared: SparkSession = df.sparkSession
    coder = shared.sparkContext.broadcast(encoder(model_bytes(model)))  # a few megabytes, whatever the data
    names = [name for name, _ in added]
    rest = [c for c in df.columns if c not in names and (keep_input or c != from_)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(from_)
            for a, b in runs(column, most=ENCODED):
                made = make(coder.value, column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in rest], *made], [*rest, *names])
        let_go()

    return df.mapInArrow(run, schema)


def id_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """`docs` with an array of piece ids."""
    return mapped(docs, text, [(ids, IDS)], lambda coder, column: [id_lists(*coder.encode(column.to_pylist()))], model)


def decode(docs: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """`docs` with the text of an array of piece ids; a null array is an empty text."""

    def make(coder: Encoder, column: pa.Array) -> list[pa.Array]:
        n = [0 if x is None else len(x) for x in column.to_pylist()] if column.null_count else np.diff(np.asarray(column.offsets))
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(coder.decode(flat, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.string())]

    return mapped(docs, ids, [(text, T.StringType())], make, model)


def recode(docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "text", model: str = MODEL) -> DataFrame:
    """`docs` with piece ids and the text that they decode to, in one pass; `decoded` may replace `text`."""

    def make(coder: Encoder, column: pa.Array) -> list[pa.Array]:
        flat, offsets = coder.encode(column.to_pylist())
        return [id_lists(flat, offsets), pa.array(coder.decode(flat.astype(np.int64), offsets), pa.string())]

    return mapped(docs, text, [(ids, IDS), (decoded, T.StringType())], make, model)


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, the hash of the decoded ids, and whether they give the text again."""

    def make(coder: Encoder, column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        flat, offsets = coder.encode(texts)
        again = coder.decode(flat.astype(np.int64), offsets)
        hashed = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in again]
        return [id_lists(flat, offsets), pa.array(np.diff(offsets).astype(np.int64)), pa.array(hashed, pa.string()), pa.array([a == b for a, b in zip(texts, again, strict=True)], pa.bool_())]

    added = [("ids", IDS), ("n_ids", T.LongType()), ("decoded_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    return mapped(docs.select("doc_id", "text"), "text", added, make, model, keep_input=False)
