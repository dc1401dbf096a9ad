"""Substring dedup over words by difference-cover anchors (operator 1).

A difference cover D modulo v has, for any two positions i and j, a shift d < v
with both i+d and j+d in D (mod v).  So hashes of ``window - v + 1`` words, taken
only where a document's word position is in D, meet in any two equal windows at
the same shift.  Anchors that occur twice anywhere are extended to the windows
around them.  Windows that occur twice by a hash of 62 bits are told apart once
more by another of 62: only those that occur twice by both are repeated.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import table
from .textops import Prefix, U, Words, buffers, pieces, spread

#: A perfect difference set (fixed values): every residue modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WINDOW = 35
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept string"


def _words(col, a: int, b: int):
    data, off = buffers(col.slice(a, b - a))
    return data, off, Words(data, off)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors among all words, and their hashes."""
    span = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    p = np.flatnonzero(cover[w.pos % PERIOD] & (w.pos + span <= w.n[w.doc])) if len(w.pos) else np.zeros(0, np.int64)
    return p, Prefix(w.hash, 2).of(p, p + span)


def _candidates(w: Words, known: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows around repeated anchors, and the windows' hashes."""
    p, h = _anchors(w, window)
    p = p[B.held(h, known)]
    d = np.zeros(len(w.pos) + 1, np.int64)
    np.add.at(d, np.maximum(p - PERIOD + 1, w.at[:-1][w.doc[p]]), 1)
    np.add.at(d, p + 1, -1)
    near = np.cumsum(d[:-1]) > 0
    i = np.flatnonzero(near & (w.pos + window <= w.n[w.doc])) if len(w.pos) else np.zeros(0, np.int64)
    return i, Prefix(w.hash, 3).of(i, i + window)


def _hits(w: Words, keys: np.ndarray, window: int, keep: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose first hash is among the keys, and their second hashes."""
    i = np.flatnonzero(w.pos + window <= w.n[w.doc]) if len(keys) and len(w.pos) else np.zeros(0, np.int64)
    i = i[B.held(Prefix(w.hash, 3).of(i, i + window) & keep, keys)]
    return i, Prefix(w.hash, 5).of(i, i + window)


def _sizes(t: pa.Table) -> np.ndarray:
    return np.diff(buffers(t["text"])[1])


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: bool = True, bits: int = 64) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words whose sequence starts anywhere else as well.

    Returns doc_id, n_words, n_removed, kept_sha256, n_spans (removed runs) and
    kept (the text of the kept words, null without ``text``).  Null and empty texts
    have no words; texts count whole, however long; rows with equal or null ids
    each keep a row, and repeated rows repeat their windows; there are no ties;
    an empty table gives no rows; other columns are not read.  ``bits`` of a
    window's first hash are used: with few, more windows reach the second.
    """
    keep = U(((1 << bits) - 1) << (64 - bits))
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    docs = B.replayable(docs)
    n = B.n_blocks(docs)
    dealt = B.dealt(docs, n)

    def send_anchors(t: pa.Table) -> pa.Table:
        h = [_anchors(_words(t["text"], a, b)[2], window)[1] for a, b in pieces(_sizes(t))]
        return B.packs(B.block_of(t), np.concatenate(h), n)

    def send_windows(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return B.packs(0, np.zeros(0, U), n)
        keys = B.keys_of(known)
        h = [_candidates(_words(t["text"], a, b)[2], keys, window)[1] & keep for a, b in pieces(_sizes(t))]
        return B.packs(B.block_of(t), np.concatenate(h), n)

    def send_again(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows:
            return B.packs(0, np.zeros(0, U), n)
        keys = B.keys_of(hits)
        h = [_hits(_words(t["text"], a, b)[2], keys, window, keep)[1] for a, b in (pieces(_sizes(t)) if len(keys) else ())]
        return B.packs(B.block_of(t), np.concatenate([np.zeros(0, U), *h]), n)

    def finish(t: pa.Table, hits: pa.Table) -> pa.Table:
        first, second = (B.keys_of(hits.filter(pc.equal(hits["level"], k))) for k in (1, 2))
        out: list[tuple] = []
        for a, b in pieces(_sizes(t)) if t.num_rows else ():
            data, off, w = _words(t["text"], a, b)
            i, h = _hits(w, first, window, keep)
            gone = spread(i[B.held(h, second)], window, len(w.pos))
            edge = gone.copy()
            edge[1:] &= ~gone[:-1] | (w.pos[1:] == 0)
            raw = data.tobytes()
            for k in range(b - a):
                lo, hi = w.at[k], w.at[k + 1]
                words, bad = raw[off[k] : off[k + 1]].split(), gone[lo:hi]
                kept = b" ".join(compress(words, (~bad).tolist()) if bad.any() else words)
                out.append((t["doc_id"][a + k].as_py(), hi - lo, int(bad.sum()), hashlib.sha256(kept).hexdigest(), int(edge[lo:hi].sum()), kept if text else None))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("doc_id", "n_words", "n_removed", "kept_sha256", "n_spans", "kept"), cols, kinds, strict=True)})

    known = B.answers(dealt.groupBy("block").applyInArrow(send_anchors, B.PACK))
    packed = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_windows, B.PACK)
    level = lambda df, k: df.withColumn("level", F.lit(k)).repartition(n, "block")
    hits = level(B.answers(packed), 1)
    again = dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(send_again, B.PACK)
    hits = hits.unionByName(level(B.answers(again), 2))
    return dealt.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(finish, RESULT)


def op1_passage_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest columns of :func:`remove_repeats` with windows of 35 words over all ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"), text=False).drop("kept")


#: The same rows by grouping all windows.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
bad AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM g JOIN twice USING (h)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
marked AS (SELECT r, k, word, bad.k IS NOT NULL AS gone FROM word LEFT JOIN bad USING (r, k)),
edge AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY r ORDER BY k) AS opens FROM marked),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM edge GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN s USING (r)
"""
