"""Dedup over bytes by merged transforms of phrase strings (operator 9).

Texts are parsed into phrases that end where the content says so: at the least
hash of 8 bytes within any 96 (winnowing), so equal strings of 400 bytes share
the cuts, and the phrases between them, away from their edges.  A block (shard) orders its phrases and
keeps for each the place of the phrase before it: the last column of its
transform, as the step from a row to the row of the suffix one phrase longer.

The shards' transforms are merged in buckets of first symbols, by refining the
interleave.  To begin with, rows are interleaved by their first phrase, and rows
with the same one are an interval.  Each round reads the rows of the intervals
with several rows, in the order of the interleave, steps by the last column, and
deals the rows reached stably by their own symbols: that is the interleave by one
phrase more, in which rows that came from one interval to one symbol are again an
interval.  Suffixes are never compared or sorted again.  The last round in which a
row shares its interval is its longest common prefix, in phrases, with any other.

A 400-byte window within a common prefix is repeated.  What the phrases leave
open, windows that begin before a prefix or end after it, is settled by counting
the windows themselves, by two independent hashes, of 70 bits and more with the
size of the input.  So that each finds its equals, every interval's first row adds
the windows within its common prefix.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .shared import input_bytes, table
from .textops import Prefix, U, buffers, byte_values, mix, pieces, planes, spread, unplaned

WINDOW = 400
GRAM, WITHIN = 8, 96
#: Bytes that are parsed at a time.
STRETCH = 1 << 15
#: Phrases to which the interleave is refined; windows that need more are settled by their hashes.
ROUNDS = 14
#: Repeats of fewer bytes are not reported as a document's longest.
LEAST = 160
NONE = np.uint32(0xFFFFFFFF)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_repeat long, kept binary"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
KINDS = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
#: What blocks and buckets send each other: ``to`` whom, what kind, from whom, and up to four arrays.
MAIL = "to int, kind int, source int, a binary, b binary, c binary, d binary"
SENT = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), *((x, pa.binary()) for x in "abcd")])
ROWS, STATIC, STEP, STATE, DEPTH, KEYS, BITS = range(7)


def _sent(rows: list[tuple]) -> pa.Table:
    """Rows (to, kind, source, arrays ...) as a table."""
    cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
    cols += [[None if len(r) <= 3 + k else planes(r[3 + k]) for r in rows] for k in range(4)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SENT, strict=True)], schema=SENT)


def _got(t: pa.Table, kind: int) -> list[tuple]:
    """(source, buffers ...) of the rows of one kind, by source."""
    at = np.flatnonzero(t["kind"].to_numpy() == kind) if t.num_rows else ()
    rows = [(t["source"][i].as_py(), *(t[x][i].as_buffer() for x in "abcd")) for i in map(int, at)]
    return sorted(rows, key=lambda r: r[0])


def _joined(parts: list, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unplaned(x, kind) for x in parts)])


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over every ``size`` values in a row; the result is shorter by size - 1."""
    step = 1
    while 2 * step <= size:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def _grams(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The 8 bytes from each place a to b - 1 as numbers; b + 7 bytes must be there."""
    return np.ndarray((b - a,), "<u8", data, a, (1,)).astype(U)


def _cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places whose gram has the least hash of some ``WITHIN`` in a row in their document."""
    n, out = len(data) - GRAM + 1, []
    for s in range(0, n, STRETCH):  # what a core's cache holds, with the neighbours that windows reach
        a, b = max(0, s - WITHIN + 1), min(n, s + STRETCH + WITHIN - 1)
        with np.errstate(over="ignore"):
            h = ((_grams(data, a, b) * U(0x9E3779B97F4A7C15)) >> U(33)).astype(np.uint32) + np.uint32(1)
        if len(h) < WITHIN:
            break
        least = _slide(h, WITHIN, np.minimum)
        for e in off[np.searchsorted(off, a, side="right") : np.searchsorted(off, b + GRAM + WITHIN)]:
            least[max(0, e - GRAM - WITHIN + 2 - a) : max(0, e - a)] = 0  # such windows leave their document
        pad = np.zeros(WITHIN - 1, np.uint32)
        hit = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), WITHIN, np.maximum) == h) + a
        out.append(hit[(hit >= s) & (hit < s + STRETCH)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _symbols(data: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the phrases [cut, end) and the 7 bytes after: sums of their grams, each mixed with its place."""
    out = np.zeros(len(cut), U)
    if not len(cut):
        return out
    parts = np.flatnonzero(np.diff(cut // STRETCH, prepend=-1))
    for lo, hi in zip(parts, [*parts[1:], len(cut)], strict=True):
        c, n = cut[lo:hi], end[lo:hi] - cut[lo:hi]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        a = int(c[0])
        with np.errstate(over="ignore"):
            x = _grams(data, a, int(end[hi - 1]))[np.repeat(c - a, n) + place] + place.astype(U) * U(0xD6E8FEB86659FD93)
            out[lo:hi] = np.add.reduceat(mix(x), first)
    return mix(out)


class Parsed:
    """Phrases of some documents: ``cut``, where they begin and the last one ends; ``row``, the cuts with a phrase to go in their document; ``sym`` of each row.

    Besides the ``regular`` cuts, which content decides, documents that hold a
    window are cut at their edges, so that whole copies share all their phrases.
    """

    def __init__(self, col):
        self.data, self.off = buffers(col)
        cut = _cuts(self.data, self.off) if len(self.data) >= GRAM + WITHIN else np.zeros(0, np.int64)
        large = np.flatnonzero(np.diff(self.off) >= WINDOW)
        start = large[~np.isin(self.off[large], cut)]
        cuts = np.concatenate([cut, self.off[start], self.off[large + 1]])
        doc = np.concatenate([np.searchsorted(self.off, cut, side="right") - 1, start, large])
        o = np.lexsort((cuts, doc))
        self.cut, self.doc, self.regular = cuts[o], doc[o], (o < len(cut))
        self.row = np.flatnonzero(self.doc[:-1] == self.doc[1:])
        begin, end = self.cut[self.row], self.cut[self.row + 1]
        last = ~self.regular[self.row + 1]  # up to a document's edge: no bytes of the next one
        self.sym = _symbols(self.data, np.where(last, np.minimum(begin, end - GRAM), begin), np.where(last, end - GRAM + 1, end))
        self.sym[last] = mix(self.sym[last] ^ (end - begin)[last].astype(U) ^ U(0x51ED270B00000000))

    def windows(self, depth: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows whose inner phrases are repeated; which lie within a common prefix; which are counted; each cut's common prefix in bytes.

        Of the windows within a common prefix those of the row that leads the
        interval of so many phrases are counted, for others to be compared with.
        """
        have, leads = np.zeros(len(self.cut), np.int64), np.zeros(len(self.cut), np.int64)
        have[self.row], leads[self.row] = depth, lead
        end = self.cut[np.arange(len(have)) + have] if len(have) else have
        f = np.flatnonzero((have > 0) & self.regular)  # windows of which f is the first inner cut
        if not len(f):
            return f, f.astype(bool), f.astype(bool), end - self.cut
        opens, closes = self.off[self.doc[f]], self.off[self.doc[f] + 1]
        low = np.where((f > 0) & (self.doc[f - 1] == self.doc[f]) & self.regular[f - 1], self.cut[f - 1] - WITHIN + 2, opens)
        low, high = np.maximum(low, opens), np.minimum(self.cut[f] - WITHIN + 1, closes - WINDOW)
        n = np.maximum(high - low + 1, 0)
        f = np.repeat(f, n)
        i = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        last = np.searchsorted(self.cut, i + (WINDOW - GRAM - WITHIN + 1), side="right") - 1
        i = i[have[f] >= np.minimum(last - f, ROUNDS)]
        k = np.searchsorted(self.cut, i, side="right") - 1
        need = np.searchsorted(self.cut, i + WINDOW) - k
        sure = have[k] >= need
        return i, sure, ~sure | ((leads[k] >> (np.minimum(need, 60) - 1)) & 1).astype(bool), end - self.cut

    def before(self) -> np.ndarray:
        """Of each row, the number of the row one phrase earlier in its document, or -1."""
        follows = np.zeros(len(self.row), bool)
        follows[1:] = np.diff(self.row) == 1
        return np.where(follows, np.arange(len(self.row)) - 1, -1)

    def keys(self, i: np.ndarray) -> list[np.ndarray]:
        """Two hashes of the windows from these places; only their documents are read."""
        doc = np.searchsorted(self.off, i, side="right") - 1
        docs = np.flatnonzero(np.bincount(doc, minlength=len(self.off) - 1))
        size = np.diff(self.off)[docs]
        data = np.concatenate([self.data[self.off[d] : self.off[d + 1]] for d in docs.tolist()])
        moved = np.zeros(len(self.off), np.int64)
        moved[docs] = self.off[docs] - (np.cumsum(size) - size)
        i = i - moved[doc]
        return [Prefix(data, seed, byte_values(seed)).of(i, i + WINDOW) for seed in (6, 7)]


def ordered(t: pa.Table) -> pa.Table:
    """A block's documents in an order that each reading of the exchange has: rows are told apart by their place."""
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("h", "ascending")]))


def _parsed(t: pa.Table):
    for lo, hi in pieces(np.diff(buffers(t["text"])[1])) if t.num_rows else ():
        yield lo, hi, Parsed(t["text"].slice(lo, hi - lo))


def _transform(parsed: list[Parsed]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows by symbol: the symbols, each row's row before, and the place of each piece's rows among them."""
    sym, before, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for p in parsed:
        b = p.before()
        sym.append(p.sym)
        before.append(np.where(b < 0, -1, b + at))
        at += len(b)
    sym, before = np.concatenate(sym), np.concatenate(before)
    o = np.argsort(sym, kind="stable")
    place = np.empty(len(o), np.int64)
    place[o] = np.arange(len(o))
    earlier = before[o]
    return sym[o], np.where(earlier < 0, NONE, place[earlier] if len(o) else earlier).astype(np.uint32), place


def send_rows(t: pa.Table, n: int) -> pa.Table:
    """A block's transform in buckets: symbols, rows before, and where each bucket's rows begin in the block."""
    sym, before, _ = _transform([p for _, _, p in _parsed(t)])
    cuts, block = np.searchsorted(B.bucket_of(sym, n), np.arange(n + 1)).astype(np.uint32), t["block"][0].as_py()
    return _sent([(i, ROWS, block, sym[a:b], before[a:b], cuts) for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a])


def _packed(block: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Names of rows in 5 bytes each, or 8 where blocks or rows are too many."""
    name = block.astype(U) << U(24) | row
    if not len(name) or (int(block.max()) < 1 << 16 and int(row.max()) < 1 << 24):
        return name.view(np.uint8).reshape(-1, 8)[:, :5]
    return (block.astype(U) << U(32) | row).view(np.uint8).reshape(-1, 8)


def _unpacked(x, n: int) -> np.ndarray:
    """Block and row of n packed names, in 64 bits."""
    width = len(x) // max(n, 1)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(width, n).T
    out = out.view(U).ravel()
    return out if width == 8 else (out >> U(24)) << U(32) | out & U(0xFFFFFF)


def _steps(bucket: int, order: np.ndarray, interval: np.ndarray, block: np.ndarray, before: np.ndarray, to: np.ndarray) -> list[tuple]:
    """The step by the last column from rows in the interleave's order: to each bucket the blocks and rows reached, and where intervals begin.

    Of an interval's rows those that reach a bucket alone end there.
    """
    has = before[order] != NONE
    order, interval = order[has], interval[has]
    there = to[order]
    o = np.argsort(there, kind="stable")
    order, interval, there = order[o], interval[o], there[o]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = (there[1:] != there[:-1]) | (interval[1:] != interval[:-1])
    keep = ~(new[:-1] & new[1:])
    order, there, new = order[keep], there[keep], new[:-1][keep]
    cuts = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1], [True]])) if len(there) else [0]
    return [(int(there[a]), STEP, bucket, _packed(block[order[a:b]], before[order[a:b]]), np.packbits(new[a:b]), np.array([b - a], np.int64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def first_interleave(t: pa.Table) -> pa.Table:
    """A bucket's rows interleaved by their first symbol; it keeps those that share it."""
    got, bucket = _got(t, ROWS), t["to"][0].as_py()
    sym, before = _joined([r[1] for r in got], U), _joined([r[2] for r in got], np.uint32)
    sizes = [len(r[1]) // 8 for r in got]
    block = np.repeat(np.array([r[0] for r in got], np.uint32), sizes)
    starts = [unplaned(r[3], np.uint32) for r in got]
    row = np.concatenate([np.arange(m, dtype=np.uint32) + c[bucket] for c, m in zip(starts, sizes, strict=True)])
    to = np.concatenate([np.searchsorted(c, unplaned(r[2], np.uint32), side="right") - 1 for c, r in zip(starts, got, strict=True)]).astype(np.uint32)
    _, rank, count = np.unique(sym, return_inverse=True, return_counts=True)
    live = np.flatnonzero(count[rank] > 1)
    rank, block, row, before, to = rank[live].astype(np.uint32), block[live], row[live], before[live], to[live]
    order = np.argsort(rank, kind="stable")
    names, lead = block.astype(U) << U(32) | row, np.zeros(len(rank), np.uint16)
    lead[order[np.diff(rank[order], prepend=NONE) != 0]] = 1
    return _sent([(bucket, STATIC, bucket, names, rank, before, to), (bucket, STATE, bucket, np.ones(len(rank), np.uint8), lead), *_steps(bucket, order, rank[order], block, before, to)])


def _static(t: pa.Table) -> list[np.ndarray]:
    got = _got(t, STATIC)
    return [_joined([r[1 + k] for r in got], kind) for k, kind in enumerate((U, np.uint32, np.uint32, np.uint32))]


def _state(m: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its common prefix so far, and at which depths (bits) it comes first in its interval."""
    got = _got(m, STATE)
    return _joined([r[1] for r in got], np.uint8).copy(), _joined([r[2] for r in got], np.uint16).copy()


def refine(t: pa.Table, m: pa.Table, depth: int) -> pa.Table:
    """One round: the rows reached, in the order of the last interleave, dealt stably by symbol."""
    if not t.num_rows:
        return SENT.empty_table()
    names, rank, before, to = _static(t)
    bucket, (have, lead), got = t["to"][0].as_py(), _state(m), _got(m, STEP)
    sizes = [int(unplaned(r[3], np.int64)[0]) for r in got]
    name = np.concatenate([np.zeros(0, U), *(_unpacked(r[1], k) for r, k in zip(got, sizes, strict=True))])
    new = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(unplaned(r[2], np.uint8), count=k) for r, k in zip(got, sizes, strict=True))])
    out = []
    if len(names) and len(name):
        at = np.minimum(np.searchsorted(names, name), len(names) - 1)
        here = names[at] == name
        at, interval = at[here], np.cumsum(new)[here]
        o = np.argsort(rank[at], kind="stable")
        at, interval = at[o], interval[o]
        s = rank[at]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (s[1:] != s[:-1]) | (interval[1:] != interval[:-1])
        live = ~(new[:-1] & new[1:])
        at, interval, new = at[live], np.cumsum(new[:-1])[live], new[:-1][live]
        have[at] = depth
        lead[at[new]] |= np.uint16(1 << (depth - 1))
        out = _steps(bucket, at, interval, (names >> U(32)).astype(np.uint32), before, to) if depth < ROUNDS else []
    return _sent([(bucket, STATE, bucket, have, lead), *out])


def answer(t: pa.Table, m: pa.Table) -> pa.Table:
    """To each block, its rows that share an interval and their common prefixes."""
    if not t.num_rows:
        return SENT.empty_table()
    names, bucket = _static(t)[0], t["to"][0].as_py()
    (have, lead), block = _state(m), (names >> U(32)).astype(np.int64)
    row = (names & U(0xFFFFFFFF)).astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(names) else [0]
    return _sent([(int(block[a]), DEPTH, bucket, row[a:b], have[a:b], lead[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


class Windows:
    """A block's windows that are counted: the distinct keys, in order, which the block holds more than once, and each window's among them."""

    def __init__(self, found: list[Found], width: int):
        self.width = width
        keys = [p.keys(i) for p, i in ((x.p, x.i[x.asked]) for x in found) if len(i)]
        a, b = (np.concatenate([np.zeros(0, U), *(k[x] for k in keys)]) for x in (0, 1))
        self.a, self.b, self.back, self.many = distinct(a, b >> U(64 - 8 * width))

    def sent(self, block: int, n: int) -> pa.Table:
        cuts = np.searchsorted(B.bucket_of(self.a, n), np.arange(n + 1)).tolist()
        more = self.b.view(np.uint8).reshape(-1, 8)[:, : self.width]
        return _sent([(i, KEYS, block, self.a[a:b], more[a:b], np.packbits(self.many[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a])


def key_width(size: int) -> int:
    """Bytes of the second hash that are sent: so many that a false pair among all windows of ``size`` compressed bytes has a chance of about 1 in 1,000."""
    return min(8, max(1, math.ceil((2 * math.log2(max(2, 2 * size)) - 1 + 10 - 62) / 8)))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, each pair's place among them, and which are there more than once."""
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.ones(len(o), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(o), np.int64)
    back[o] = np.cumsum(new) - 1
    return a[new], b[new], back, np.bincount(back, minlength=int(new.sum())) > 1


def repeated(t: pa.Table) -> pa.Table:
    """A bucket's answers about windows: a bit for each that a block sent."""
    got, bucket = _got(t, KEYS), t["to"][0].as_py()
    a = _joined([r[1] for r in got], U)
    sizes = [len(r[1]) // 8 for r in got]
    many = np.concatenate([np.unpackbits(unplaned(r[3], np.uint8), count=m) for r, m in zip(got, sizes, strict=True)]).astype(bool)
    b = np.zeros((len(a), 8), np.uint8)
    more = [np.frombuffer(r[2], np.uint8).reshape(-1, m).T for r, m in zip(got, sizes, strict=True)]
    b[:, : more[0].shape[1]] = np.concatenate(more)
    _, _, back, hit = distinct(a, b.view(U).ravel())
    hit[back[many]] = True
    hit, ends = hit[back], np.cumsum(sizes).tolist()
    return _sent([(r[0], BITS, bucket, np.packbits(hit[e - m : e])) for r, m, e in zip(got, sizes, ends, strict=True)])


class Found(NamedTuple):
    """A piece's windows, see :meth:`Parsed.windows`."""

    lo: int
    hi: int
    p: Parsed
    i: np.ndarray
    sure: np.ndarray
    asked: np.ndarray
    prefix: np.ndarray


def _found(t: pa.Table, m: pa.Table) -> list[Found]:
    parsed = list(_parsed(t))
    _, _, place = _transform([p for _, _, p in parsed])
    depth, lead = np.zeros(len(place), np.uint8), np.zeros(len(place), np.uint16)
    for _, row, have, leads, *_ in _got(m, DEPTH):
        at = unplaned(row, np.uint32)
        depth[at], lead[at] = unplaned(have, np.uint8), unplaned(leads, np.uint16)
    depth, lead, at, out = depth[place], lead[place], 0, []
    for lo, hi, p in parsed:
        n = len(p.row)
        out.append(Found(lo, hi, p, *p.windows(depth[at : at + n], lead[at : at + n])))
        at += n
    return out


def remove_repeated_bytes(docs: DataFrame, text: bool = True) -> DataFrame:
    """Remove each byte covered by a 400-byte string that also starts anywhere else in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, longest_repeat and kept (the remaining bytes; null without
    ``text``).  longest_repeat is the longest run of whole phrases, up to
    ``ROUNDS``, that is also elsewhere, in bytes, or 0 below ``LEAST``; 400 at least
    where something is removed.  It tells of repeats that are too short for that.  Null and empty texts have no
    bytes; texts count whole, however long; rows with equal or null ids each keep
    a row, and repeated rows repeat their windows; there are no ties; an empty
    table gives no rows; other columns are not read.
    """
    docs = B.replayable(docs)
    n, width = B.n_blocks(docs), key_width(input_bytes(docs))
    dealt = B.dealt(docs, n).withColumn("h", F.xxhash64("text"))

    def rows(t: pa.Table) -> pa.Table:
        return send_rows(ordered(t), n)

    def windows(t: pa.Table, m: pa.Table) -> pa.Table:
        return Windows(_found(ordered(t), m), width).sent(t["block"][0].as_py(), n) if t.num_rows else SENT.empty_table()

    def finish(t: pa.Table, m: pa.Table) -> pa.Table:
        out: list[tuple] = []
        t = ordered(t)
        found = _found(t, m) if t.num_rows else []
        if found:
            w = Windows(found, width)
            sizes = np.diff(np.searchsorted(B.bucket_of(w.a, n), np.arange(n + 1)))
            bits = [np.unpackbits(unplaned(r[1], np.uint8), count=int(sizes[r[0]])) for r in _got(m, BITS)]
            hit, at = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)[w.back] if len(w.a) else np.zeros(0, bool), 0
        for lo, hi, p, i, sure, asked, prefix in found:
            data, off, i_asked = p.data, p.off, i[asked]
            gone = spread(np.concatenate([i[sure], i_asked[hit[at : at + len(i_asked)]]]), WINDOW, len(data))
            at += len(i_asked)
            longest = np.zeros(hi - lo, np.int64)
            np.maximum.at(longest, p.doc, prefix)
            longest[longest < LEAST] = 0
            for k in range(hi - lo):
                bad = gone[off[k] : off[k + 1]]
                whole = data[off[k] : off[k + 1]]
                kept = (whole[~bad] if bad.any() else whole).tobytes()
                spans = int(bad[:1].sum() + (bad[1:] & ~bad[:-1]).sum())
                out.append((t["doc_id"][lo + k].as_py(), len(bad), int(bad.sum()), spans, hashlib.sha256(kept).hexdigest(), max(int(longest[k]), WINDOW * (spans > 0)), kept if text else None))
        cols = list(zip(*out, strict=True)) or [()] * len(NAMES)
        return pa.table({k: pa.array(c, kind) for k, c, kind in zip(NAMES, cols, KINDS, strict=True)})

    def refined(depth: int):
        return lambda t, m: refine(t, m, depth)

    by = lambda d: d.groupBy("block")
    post = lambda d: d.repartition(n, "to")
    to = lambda d: d.groupBy("to")
    first = post(to(post(by(dealt).applyInArrow(rows, MAIL))).applyInArrow(first_interleave, MAIL))
    static, now = first.filter(f"kind = {STATIC}"), first.filter(f"kind <> {STATIC}")
    for depth in range(2, ROUNDS + 1):
        now = post(to(static).cogroup(to(now)).applyInArrow(refined(depth), MAIL))
    mail = post(to(static).cogroup(to(now)).applyInArrow(answer, MAIL))
    keys = by(dealt).cogroup(to(mail)).applyInArrow(windows, MAIL)
    mail = mail.unionByName(post(to(post(keys)).applyInArrow(repeated, MAIL)))
    return by(dealt).cogroup(to(mail)).applyInArrow(finish, RESULT)


def op9_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of :func:`remove_repeated_bytes` over all ``documents``."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), text=False).drop("kept")
