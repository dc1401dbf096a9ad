"""LM scoring by a probabilistic suffix tree over words (operator 4).

States are contexts of 0, 1 and 2 words.  A context is kept if the next words it
foretells diverge from its suffix's: the leave-one-out log-likelihood of the
training tokens after it must gain GAIN nats over the suffix.  A state's
distribution is (count + b * suffix's) / (occurrences + b), b = 1 + occurrences / 2;
the root's is (count + 1) / (N + V + 1).  A token is scored by the longest kept
suffix of the words before it.

Counts are summed in buckets (see :mod:`.blocks`): a block sends the distinct
words, pairs and triples that it holds, with its training counts, and gets the
totals.  Pairs and triples that cannot pass the test because a part is too rare
are not sent, but scores count them: what ends in a word, or pair, of one training
occurrence occurs once where that occurrence is, and is sent only if a held-out
document asks for it.  Words are told apart by 64 bits, pairs and triples by 40
besides their bucket's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .shared import crc_mod, table
from .textops import LOWER, U, Words, buffers, mix, pieces, planes, unplaned

GAIN = 6.0
#: Training occurrences that a context needs, and a token after it to gain anything.
LEAST_CONTEXT, LEAST_NEXT = 3, 2
HELD_OUT = (7, 2)
END = U(0xE0DE0DE0DE0DE0DE)
LOW = (1 << 40) - 1
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_context long"
MAIL = "block int, bucket int, kind int, data binary, own binary, n long, v long"
KINDS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary()), ("own", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


class Tokens:
    """The tokens of a block's documents, each text's end among them."""

    def __init__(self, t: pa.Table):
        parts, ns = [], []
        for lo, hi in pieces(np.diff(buffers(t["text"])[1])):
            w = Words(*buffers(t["text"].slice(lo, hi - lo)), LOWER)
            parts.append(w.hash)
            ns.append(w.n)
        n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
        self.n = n + 1
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(n)), self.n)
        self.pos = np.arange(self.at[-1]) - self.at[:-1][self.doc]
        self.w = np.full(self.at[-1], END, U)
        self.w[self.pos < n[self.doc]] = np.concatenate(parts) if parts else np.zeros(0, U)
        self.train = t["train"].to_numpy().astype(bool)[self.doc] if len(n) else np.zeros(0, bool)
        self.k1, self.i1 = np.unique(self.w, return_inverse=True)
        self.one = self.marked(self.i1, slice(None), len(self.k1))

    def marked(self, back: np.ndarray, places, size: int) -> np.ndarray:
        """Training counts of the keys at these places, doubled, and 1 more for those that a held-out document holds."""
        train = self.train[places]
        return 2 * np.bincount(back, train, size).astype(np.int64) + (np.bincount(back, ~train, size) > 0)

    def pairs(self, c1: np.ndarray, asked: np.ndarray, n: int) -> None:
        """Places whose pair counts (the word before and this one are frequent enough, or this one occurs once and is asked for), and the distinct pairs."""
        c = c1[self.i1]
        near = (self.pos >= 1) & (np.roll(c, 1) >= LEAST_CONTEXT)
        self.p2 = np.flatnonzero(near & ((c >= LEAST_NEXT) | (c == 1) & asked[self.i1]))
        self.pair = (near & self.train & (c == 1)).astype(np.int64)
        with np.errstate(over="ignore"):
            h = mix(self.w[self.p2 - 1] * U(0xC2B2AE3D27D4EB4F) + self.w[self.p2])
        self.k2, self.i2 = np.unique(short(h, n), return_inverse=True)
        self.two = self.marked(self.i2, self.p2, len(self.k2))
        self.h2 = np.zeros(len(self.w), U)
        self.h2[self.p2] = h

    def triples(self, c2: np.ndarray, asked: np.ndarray, n: int) -> None:
        c, a = self.pair, np.zeros(len(self.w), bool)
        c[self.p2], a[self.p2] = c2[self.i2], asked[self.i2]
        near = (self.pos >= 2) & (np.roll(c, 1) >= LEAST_CONTEXT)
        self.p3 = np.flatnonzero(near & ((c >= LEAST_NEXT) | (c == 1) & a))
        self.triple = (near & self.train & (c == 1)).astype(float)
        with np.errstate(over="ignore"):
            h = mix(self.h2[self.p3 - 1] * U(0x165667B19E3779F9) + self.w[self.p3])
        self.k3, self.i3 = np.unique(short(h, n), return_inverse=True)
        self.three = self.marked(self.i3, self.p3, len(self.k3))


def short(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 40 bits of each hash, packed so that order is by bucket."""
    return (B.bucket_of(h, n).astype(U) << U(40)) | (h & U(LOW))


def _cuts(keys: np.ndarray, wide: bool, n: int):
    """(bucket, first, end) of each bucket with keys."""
    at = np.searchsorted(B.bucket_of(keys, n) if wide else (keys >> U(40)).astype(np.int64), np.arange(n + 1))
    return [(i, int(at[i]), int(at[i + 1])) for i in np.flatnonzero(np.diff(at)).tolist()]


def _pack(keys: np.ndarray, wide: bool) -> bytes:
    """Ascending keys: the first, and the steps to the others, in 4 bytes each where they fit."""
    if not len(keys):
        return b""
    keys = keys if wide else keys & U(LOW)
    steps = np.diff(keys)
    small = not wide and (not len(steps) or int(steps.max()) < 1 << 32)
    return keys[:1].tobytes() + (b"\4" + planes(steps.astype(np.uint32)) if small else b"\x08" + planes(steps))


def _unpack(x, wide: bool) -> np.ndarray:
    if not len(x):
        return np.zeros(0, U)
    steps = unplaned(x[9:], np.uint32 if bytes(x[8:9]) == b"\4" else U)
    out = np.empty(len(steps) + 1, U)
    out[0] = np.frombuffer(x, U, 1)[0]
    out[1:] = steps
    return np.cumsum(out, dtype=U)


def _code(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and more follow in full."""
    counts = counts.astype(np.int64)
    return np.uint32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()


def _decode(x) -> np.ndarray:
    n = int(np.frombuffer(x, np.uint32, 1)[0])
    out = np.frombuffer(x, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(x, np.int64, offset=4 + n)
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.uint32(len(flags)).tobytes() + np.packbits(flags).tobytes()


def _flags(x) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int(np.frombuffer(x, np.uint32, 1)[0])).astype(bool)


def _send(block: int, keys: np.ndarray, values: np.ndarray, wide: bool, n: int, level: int = 0) -> pa.Table:
    at = _cuts(keys, wide, n)
    return pa.table({
        "bucket": pa.array([i for i, _, _ in at], pa.int32()), "block": pa.array([block] * len(at), pa.int32()),
        "keys": pa.array([_pack(keys[a:b], wide) for _, a, b in at], pa.binary()), "many": pa.array([_code(values[a:b]) if values.dtype == np.int64 else values[a:b].tobytes() for _, a, b in at], pa.binary()),
        "level": pa.array([level] * len(at), pa.int32()),
    })


def _totals(wide: bool, kind: int, n: int):
    """A bucket's answers: the totals of each block's keys, marked as they came, and which of them the block is the first to hold; for words, N and V to every block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.filter(pc.equal(t["level"], 0)).sort_by("block")
        if not t.num_rows:
            return KINDS.empty_table()
        parts = [_unpack(x.as_buffer(), wide) for x in t["keys"]]
        counts = np.concatenate([_decode(x.as_buffer()) for x in t["many"]])
        keys, first, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        total = np.bincount(back, counts >> 1, len(keys)).astype(np.int64)
        marked = 2 * total + (np.bincount(back, counts & 1, len(keys)) > 0)
        own = np.zeros(len(back), bool)
        own[first] = True
        bucket, out, at = t["bucket"][0].as_py(), [], 0
        for block, p in zip(t["block"].to_pylist(), parts, strict=True):
            out.append((block, bucket, kind, _code(marked[back[at : at + len(p)]]), _bits(own[at : at + len(p)]), None, None))
            at += len(p)
        if wide:
            out += [(b, bucket, 0, None, None, int(total.sum()), int((total > 0).sum())) for b in range(n)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), KINDS, strict=True)], schema=KINDS)

    return run


def _kept(wide: bool, kind: int):
    """The test of each context, by the sums of what blocks have found for it, to every block that holds it."""

    def run(t: pa.Table, g: pa.Table) -> pa.Table:
        if not t.num_rows:
            return KINDS.empty_table()
        parts = [_unpack(x.as_buffer(), wide) for x in t["keys"]]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(back, np.concatenate([_decode(x.as_buffer()) for x in t["many"]]) >> 1, len(keys))
        g = g.filter(pc.equal(g["level"], kind - 3))
        low = keys & U(LOW)
        order = np.argsort(low)
        told = np.concatenate([_unpack(x.as_buffer(), False) for x in g["keys"]] or [np.zeros(0, U)])
        at = order[np.searchsorted(low[order], told)]
        gain = np.bincount(at, np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in g["many"]] or [np.zeros(0)]), len(keys))
        kept = (c >= LEAST_CONTEXT) & (gain + c * np.log((1 + c / 2) / np.maximum(c * 1.5, 0.5)) > GAIN)
        out, at = [], 0
        for block, bucket, p in zip(t["block"].to_pylist(), t["bucket"].to_pylist(), parts, strict=True):
            out.append((block, bucket, kind, _bits(kept[back[at : at + len(p)]]), None, None, None))
            at += len(p)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), KINDS, strict=True)], schema=KINDS)

    return run


class Mail:
    """What a block has got so far."""

    def __init__(self, t: pa.Table):
        rows = zip(*(t[c].to_pylist() for c in ("kind", "bucket", "data", "own")), strict=True)
        got: dict[int, list] = {}
        for kind, bucket, data, own in rows:
            got.setdefault(kind, []).append((bucket, data, own))
        for x in got.values():
            x.sort(key=lambda r: r[0])
        self.got = got
        zero = t.filter(pc.equal(t["kind"], 0))
        self.n, self.v = (sum(zero[c].to_pylist()) for c in ("n", "v"))

    def totals(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Training counts, and which keys held-out documents hold."""
        marked = np.concatenate([np.zeros(0, np.int64), *(_decode(d) for _, d, _ in self.got.get(kind, ()))])
        return marked >> 1, (marked & 1).astype(bool)

    def owned(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(_flags(o) for _, _, o in self.got.get(kind, ()))])

    def kept(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *(_flags(d) for _, d, _ in self.got.get(kind, ()))])


def _first(i: np.ndarray, size: int) -> np.ndarray:
    """A place at which each distinct key occurs."""
    at = np.zeros(size, np.int64)
    at[i] = np.arange(len(i))
    return at


def scored(docs: DataFrame, held: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod held[0] is not held[1], and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (root
    alone), score, and n_context (tokens scored by a longer state).  Null and
    empty texts are one end; texts count whole, however long; repeated rows count
    and are scored each; there are no ties; an empty table gives no rows; other
    columns are not read.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], SCORES)
    docs = B.replayable(docs)
    n = B.n_blocks(docs)
    train = crc_mod("doc_id", held[0]) != held[1]
    dealt = docs.select(B.block(docs, n), F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train")).repartition(n, "block")

    def words(t: pa.Table) -> pa.Table:
        x = Tokens(t)
        return _send(B.block_of(t), x.k1, x.one, True, n)

    def ready(t: pa.Table, m: pa.Table, level: int):
        x, mail = Tokens(t), Mail(m)
        x.c1, asked = mail.totals(1)
        x.pairs(x.c1, asked, n)
        if level > 1:
            x.c2, asked = mail.totals(2)
            x.triples(x.c2, asked, n)
        x.p0 = (x.c1 + 1) / (mail.n + mail.v + 1)
        return x, mail

    def pairs(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _send(0, np.zeros(0, U), np.zeros(0, np.int64), False, n)
        x, _ = ready(t, m, 1)
        return _send(B.block_of(t), x.k2, x.two, False, n)

    def states(x: Tokens):
        """At each place: the root's probability, that of a one-word context, and counts of the contexts."""
        p0 = x.p0[x.i1]
        u = np.roll(x.c1[x.i1], 1)
        b = 1 + u / 2
        return p0, u, b, (x.pair + b * p0) / (u + b)

    def gains(level: int, places, back, total, own, base, occurs, key) -> pa.Table:
        """Each context's leave-one-out gain from the pairs, or triples, that this block is the first to hold; one that occurs once gains nothing."""
        at = places[_first(back, len(total))] if len(total) else np.zeros(0, np.int64)
        use = own & (total > 1)
        at, c = at[use], total[use].astype(float)
        beta = 1 + occurs[at] / 2
        keys, i = np.unique(key[at], return_inverse=True)
        gain = np.bincount(i, c * np.log(((c - 1) / base[at] + beta) / beta), len(keys)).astype(np.float32)
        return _send(-1, keys, gain, False, n, level)

    def triples(t: pa.Table, m: pa.Table) -> pa.Table:
        """The block's triples, and the gains of contexts of one word."""
        if not t.num_rows:
            return _send(0, np.zeros(0, U), np.zeros(0, np.int64), False, n)
        x, mail = ready(t, m, 2)
        p0, u, _, _ = states(x)
        one = gains(1, x.p2, x.i2, x.c2, mail.owned(2), p0, u, short(np.roll(x.w, 1), n))
        return pa.concat_tables([_send(B.block_of(t), x.k3, x.three, False, n), one])

    def found(t: pa.Table, m: pa.Table) -> pa.Table:
        """The gains of contexts of two words."""
        if not t.num_rows:
            return _send(0, np.zeros(0, U), np.zeros(0, np.int64), False, n)
        x, mail = ready(t, m, 2)
        _, _, _, p1 = states(x)
        return gains(2, x.p3, x.i3, mail.totals(3)[0], mail.owned(3), p1, np.roll(x.pair, 1), short(np.roll(x.h2, 1), n))

    def finish(t: pa.Table, m: pa.Table) -> pa.Table:
        names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_context")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        if not t.num_rows:
            return pa.table({k: pa.array([], kind) for k, kind in zip(names, kinds, strict=True)})
        x, mail = ready(t, m, 2)
        p0, u, b, p1 = states(x)
        c3, kept1, kept2 = mail.totals(3)[0], mail.kept(4), mail.kept(5)
        one = np.roll(kept1[x.i1], 1) & (x.pos >= 1)
        q = np.where(one, p1, p0)
        if len(x.k2):
            at = np.zeros(len(x.w), bool)
            at[x.p2] = kept2[x.i2]
            two = np.roll(at, 1) & (x.pos >= 2)
            triple = x.triple
            triple[x.p3] = c3[x.i3]
            tu = np.roll(x.pair, 1)
            q = np.where(two, (triple + (1 + tu / 2) * p1) / (tu + 1 + tu / 2), q)
            one |= two
        add = lambda v: np.add.reduceat(v, x.at[:-1])  # noqa: E731  every document has its end
        cols = (t["doc_id"], x.n, add((x.c1[x.i1] > 0).astype(np.int64)), np.full(len(x.n), mail.n), add(np.log10(p0)), add(np.log10(q)), add(one.astype(np.int64)))
        return pa.table({k: c if isinstance(c, pa.ChunkedArray) else pa.array(c, kind) for k, c, kind in zip(names, cols, kinds, strict=True)})

    by = lambda d: d.groupBy("block")
    pack = B.PACK + ", level int"
    # Answers go to their blocks once: later steps read the same exchanges, and a union of them needs none of its own.
    post = lambda d: d.repartition(n, "block")
    deal = lambda d: d.repartition(n, "bucket")
    at = lambda d: d.groupBy("bucket")
    p1 = deal(by(dealt).applyInArrow(words, pack))
    mail = post(at(p1).applyInArrow(_totals(True, 1, n), MAIL))
    p2 = deal(by(dealt).cogroup(by(mail)).applyInArrow(pairs, pack))
    mail = mail.unionByName(post(at(p2).applyInArrow(_totals(False, 2, n), MAIL)))
    p3 = deal(by(dealt).cogroup(by(mail)).applyInArrow(triples, pack))
    mail = mail.unionByName(post(at(p3).applyInArrow(_totals(False, 3, n), MAIL)))
    g2 = deal(by(dealt).cogroup(by(mail)).applyInArrow(found, pack))
    for level, packed, gain in ((1, p1, p3), (2, p2, g2)):
        mail = mail.unionByName(post(at(packed).cogroup(at(gain)).applyInArrow(_kept(level == 1, 3 + level), MAIL)))
    return by(dealt).cogroup(by(mail)).applyInArrow(finish, SCORES)


def op4_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; those with crc32(doc_id) mod 7 = 2 are held out."""
    out = scored(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (crc_mod("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_context")
