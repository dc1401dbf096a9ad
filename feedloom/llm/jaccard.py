"""N-gram Jaccard join by T-occurrence search (operator 8).

Documents with equal shingle sets form a class, and one of each goes on.  Sets of
which no rare shingle is elsewhere have no partner; the rest fall into groups that
share rare shingles, and the search runs within these.  A partner of a set of n
shares T = ceil(0.85 n) of its shingles at least, so the inverted lists of the
set's shingles hold it T times (DivideSkip): the L longest lists are set apart,
the short ones are merged, what they hold T - L times or more is a candidate, and
the long lists are probed for it by binary search until it has enough or cannot
get there.  A large group is dealt into parts.  Each part is searched with a few
members of the whole group, so that a crowd of near copies becomes one component
at once; then only what lies outside its largest component meets the other parts.
Every pair of different components is still compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .components import components
from .shared import row_key, stored, table
from .textops import LOWER, SLICE, Prefix, U, Words, buffers, mix, pieces

WORDS, PERCENT = 4, 85
#: Shingles of a part: the root of LEAST times the group's, within these bounds.
LEAST, MOST = 1 << 17, 1 << 21
#: Members of a large group that all its parts see.
PIVOTS = 16
#: What a merged entry costs to a probe: more lists are long the less it is.
MERGE_COST = 0.0085
#: Long lists that are probed before candidates are dropped again, and parts of a shingle's list that are linked one by one.
PROBES, SALT = 16, 64


class Sets:
    """Distinct shingles of some documents: ``h`` by document (and hash), ``at`` where each begins, ``sig`` 16 bytes of each."""

    def __init__(self, col, words: int):
        data, off = buffers(col)
        w = Words(data, off, LOWER)
        grams = Prefix(w.hash, 4)
        i = np.flatnonzero(w.pos + words <= w.n[w.doc]) if len(w.pos) else np.zeros(0, np.int64)
        few = np.flatnonzero((w.n > 0) & (w.n < words))
        h = np.concatenate([grams.of(i, i + words), mix(grams.of(w.at[few], w.at[few + 1]) ^ U(0x5BD1E995))])
        doc = np.concatenate([w.doc[i], few])
        o = np.lexsort((h, doc))
        h, doc = h[o], doc[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.h, doc = h[new], doc[new]
        self.at = np.searchsorted(doc, np.arange(len(off)))
        self.n = np.diff(self.at)
        sums = []
        for salt in (0x1B873593, 0xCC9E2D51):
            c = np.concatenate([np.zeros(1, U), np.cumsum(mix(self.h ^ U(salt)))])
            sums.append(mix(c[self.at[1:]] - c[self.at[:-1]] + self.n.astype(U)))
        raw = np.stack(sums, 1).astype(">u8").tobytes()
        self.sig = [raw[16 * k : 16 * k + 16] for k in range(len(self.n))]


def _parts(col):
    return pieces(np.diff(buffers(col)[1]), SLICE)


def _code(count: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: itself up to 128, then by its logarithm."""
    return np.where(count <= 128, count, 121 + np.log2(np.maximum(count, 1)).astype(np.int64)).clip(0, 255).astype(np.uint8)


def need(n: int, percent: int) -> int:
    """Shingles of a set of n that any partner shares at least."""
    return -(-percent * n // 100)


class Lists:
    """Inverted lists of some sets, in order of size; ``place`` of each set in that order."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        n = np.array([len(x) for x in sets], np.int64)
        self.order, self.k, self.percent = np.argsort(n, kind="stable"), len(sets), percent
        self.size = n[self.order]
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        of = np.repeat(np.arange(self.k), self.size)
        _, token, count = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True, return_counts=True)
        self.token = token[np.lexsort((token, count[token], of))]  # each set's, rarest first
        self.first = np.concatenate([[0], np.cumsum(count)])
        by = np.argsort(self.token, kind="stable")
        self.post = of[by]
        self.key = self.token[by] * self.k + self.post  # ascending: what is probed
        self.before = np.empty(len(by), np.int64)  # of each set's shingles: how many smaller sets their lists hold
        self.before[by] = np.arange(len(by)) - self.first[self.token[by]]

    def candidates(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smaller sets that the short lists of q hold often enough, how often, and the long lists' shingles."""
        mine, length = self.token[self.at[q] : self.at[q + 1]], self.before[self.at[q] : self.at[q + 1]]
        need_ = need(int(self.size[q]), self.percent)
        longest = int(length.max())
        if not longest:
            return mine[:0], mine[:0], mine[:0]
        apart = min(need_ - 1, int(need_ / (MERGE_COST * math.log2(longest + 1) + 1)))
        cut = len(mine) - apart
        length = length[:cut]
        total = int(length.sum())
        held = self.post[np.repeat(self.first[mine[:cut]] - (np.cumsum(length) - length), length) + np.arange(total)]
        held = held[held >= np.searchsorted(self.size, need_)]
        if 4 * len(held) > self.k:
            often = np.bincount(held, minlength=1)
            cand = np.flatnonzero(often >= need_ - apart)
            return cand, often[cand], mine[cut:]
        cand, often = np.unique(held, return_counts=True)
        ok = often >= need_ - apart
        return cand[ok], often[ok], mine[cut:]

    def joins(self, q: int, cand: np.ndarray, often: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which candidates reach the share of q's and their shingles that a link needs."""
        both = self.size[q] + self.size[cand]
        enough = -(-self.percent * both // (100 + self.percent))
        often, open_ = often.copy(), np.arange(len(cand))
        for i in range(0, len(far), PROBES):
            open_ = open_[(often[open_] < enough[open_]) & (often[open_] + len(far) - i >= enough[open_])]
            if not len(open_):
                break
            want = far[i : i + PROBES, None] * self.k + cand[open_]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            often[open_] += (self.key[at] == want).sum(0)
        return often >= enough


def links(label: list, host: list[bool], sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Components among some sets: the least place that each reaches.

    Equal labels are in one component from the start.  Places that are in one
    component already are not compared again: no link between components is
    missed, and a large group of near copies costs little.  Two places that are
    not hosts are left to another search.
    """
    lists = Lists(sets, percent)
    names: dict = {}
    comp = np.array([names.setdefault(label[i], len(names)) for i in lists.order], np.int64)
    own = np.array(host, bool)[lists.order]
    for q in range(lists.k):
        cand, often, far = lists.candidates(q)
        keep = (comp[cand] != comp[q]) & (own[cand] | own[q])
        cand, often = cand[keep], often[keep]
        best = True
        while len(cand):
            pick = np.ones(len(cand), bool)
            if best:  # the likeliest of each component first: near copies meet at once, and the rest of them need no look
                o = np.lexsort((-often, comp[cand]))
                pick[:] = False
                pick[o[np.concatenate([[True], np.diff(comp[cand[o]]) != 0])]] = True
            hit = cand[pick][lists.joins(q, cand[pick], often[pick], far)]
            if len(hit):
                comp[np.isin(comp, comp[hit])] = comp[q]
            keep = ~pick & (comp[cand] != comp[q])
            cand, often, best = cand[keep], often[keep], False
    least = np.full(len(names), lists.k, np.int64)
    np.minimum.at(least, comp, lists.order)
    out = np.empty(lists.k, np.int64)
    out[lists.order] = least[comp]
    return out.tolist()


def _u64(x) -> np.ndarray:
    return np.frombuffer(x, U)


def key_of() -> Column:
    """Tells rows apart whose ids repeat or are null."""
    a, b = row_key("doc_id", "text")
    return F.struct(a.alias("a"), b.alias("b"))


def classes(docs: DataFrame, words: int, n: int, keyed: bool = False) -> DataFrame:
    """(doc_id, n, sig, block) of every row, and its key; no text is shuffled for it."""
    keys = ["key"] if keyed else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", B.block(docs, n))
    if keyed:
        rows = rows.withColumn("key", key_of())

    def run(batches):
        for b in batches:
            for lo, hi in _parts(b.column(1)):
                s = Sets(b.column(1).slice(lo, hi - lo), words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s.n, pa.int64()), pa.array(s.sig, pa.binary()), *(c.slice(lo, hi - lo) for c in b.columns[2:])], ["doc_id", "n", "sig", "block", *keys])

    return rows.mapInArrow(run, "doc_id long, n long, sig binary, block int" + (", key struct<a: long, b: long>" if keyed else ""))


def candidates(docs: DataFrame, reps: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """(sig, n, prefix, shingles) of each representative with a rare shingle that is elsewhere as well."""
    dealt = B.dealt(docs, n)

    def chosen(t: pa.Table, r: pa.Table):
        left = {x.as_py() for x in r["sig"] if x.is_valid}
        for lo, hi in _parts(t["text"]) if t.num_rows else ():
            s = Sets(t["text"].slice(lo, hi - lo), words)
            for k in range(hi - lo):
                if s.sig[k] in left and s.n[k]:
                    left.discard(s.sig[k])
                    yield s.sig[k], s.h[s.at[k] : s.at[k + 1]]

    def keys(found: list) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (bucket, 32 bits of the hash) of a block, in order, packed in 64 bits; and each shingle's place among them."""
        h = np.concatenate([x for _, x in found]) if found else np.zeros(0, U)
        return np.unique((B.bucket_of(h, n).astype(U) << U(32)) | (h & U(0xFFFFFFFF)), return_inverse=True)

    def send(t: pa.Table, r: pa.Table) -> pa.Table:
        k, back = keys(list(chosen(t, r)))
        count = np.minimum(np.bincount(back, minlength=len(k)), 255).astype(np.uint8)
        cuts = np.searchsorted(k >> U(32), np.arange(n + 1, dtype=U))
        at = [(i, int(cuts[i]), int(cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts)).tolist()]
        low = (k & U(0xFFFFFFFF)).astype(np.uint32)
        block = B.block_of(t)
        return pa.table({
            "bucket": pa.array([i for i, _, _ in at], pa.int32()), "block": pa.array([block] * len(at), pa.int32()),
            "keys": pa.array([low[a:b].tobytes() for _, a, b in at], pa.binary()), "many": pa.array([count[a:b].tobytes() for _, a, b in at], pa.binary()),
        })

    def count(t: pa.Table) -> pa.Table:
        own = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["keys"]]
        k, back = np.unique(np.concatenate(own), return_inverse=True)
        code = _code(np.bincount(back, np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in t["many"]]), len(k)).astype(np.int64))[back]
        ends = np.cumsum([len(x) for x in own]).tolist()
        return pa.table({
            "block": t["block"].cast(pa.int32()), "sig": pa.nulls(t.num_rows, pa.binary()), "bucket": t["bucket"].cast(pa.int32()),
            "codes": pa.array([code[b - len(x) : b].tobytes() for x, b in zip(own, ends, strict=True)], pa.binary()),
        })

    def pick(t: pa.Table, r: pa.Table) -> pa.Table:
        found = list(chosen(t, r))
        _, back = keys(found)
        got = sorted((b, c) for b, c in zip(r["bucket"].to_pylist(), r["codes"].to_pylist(), strict=True) if b is not None)
        code = np.frombuffer(b"".join(c for _, c in got), np.uint8)[back]
        out, at = [], 0
        for sig, h in found:
            c = code[at : at + len(h)]
            at += len(h)
            first = np.lexsort((h, c))[: len(h) - need(len(h), percent) + 1]
            first = first[c[first] > 1]
            if len(first):
                out.append((sig, len(h), h[first].tobytes(), h.tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({k: pa.array(c, kind) for k, c, kind in zip(("sig", "n", "prefix", "shingles"), cols, (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    packed = dealt.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(send, B.PACK)
    codes = packed.groupBy("bucket").applyInArrow(count, "block int, sig binary, bucket int, codes binary")
    back = codes.unionByName(reps.select("block", "sig"), allowMissingColumns=True)
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(pick, "sig binary, n long, prefix binary, shingles binary")


def searched(cand: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(u, v): a representative and one of its component, the same for all; ``near`` has the group (root) of each node."""

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by("sig")
        sig = t["sig"].to_pylist()
        got = links(t["label"].to_pylist(), t["host"].to_pylist(), [_u64(x.as_buffer()) for x in t["shingles"]], percent)
        return pa.table({"u": pa.array(sig, pa.binary()), "v": pa.array([sig[i] for i in got], pa.binary())})

    def run(rows: DataFrame) -> DataFrame:
        # A column of its own for the task: the parts of a group must not stay where the group's other rows are.
        rows = rows.withColumn("task", F.xxhash64("root", "a", "b")).select("task", "root", "a", "b", "sig", "label", "host")
        rows = rows.join(cand.select("sig", "shingles"), "sig")
        return rows.groupBy("task", "root", "a", "b").applyInArrow(search, "u binary, v binary")

    size = f"least({MOST}, greatest(sqrt(s * {LEAST}D), {LEAST}))"
    sized = near.join(cand.select(F.col("sig").alias("node"), "n"), "node").select(F.col("node").alias("sig"), "root", "n")
    large = sized.groupBy("root").agg(F.sum("n").alias("s")).withColumn("k", F.expr(f"cast(ceil(s / {size}) AS int)")).filter("k > 1")
    member = sized.join(large, "root", "left").withColumn("a", F.coalesce(F.pmod(F.xxhash64("sig"), F.col("k")), F.lit(0)).cast("int"))
    member = stored(member.withColumn("b", F.lit(0)), "members")
    own = (F.col("sig").alias("label"), F.lit(True).alias("host"))
    # Signatures are hashes: the least of some are a fair choice, and the same one in a repeated run.
    pivot = member.filter("k > 1").groupBy("root", F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(PIVOTS))).agg(F.min(F.struct("sig", "a", "k")).alias("p"))
    pivot = pivot.select("root", "p.sig", F.explode(F.expr("filter(sequence(0, p.k - 1), x -> x <> p.a)")).alias("a"), F.lit(0).alias("b"))
    out = run(member.select("root", "a", "b", "sig").unionByName(pivot).select("*", *own))
    if not member.filter("k > 1").limit(1).count():
        return out
    out = stored(out, "part-links")
    found = components(out).select(F.col("node").alias("sig"), F.col("root").alias("label"))
    rows = member.filter("k > 1").join(found, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    rows = stored(rows, "part-members")
    crowd = rows.groupBy("root", "label").agg(F.sum("n").alias("m")).groupBy("root").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("s"))
    crowd = crowd.select("root", F.col("most.label").alias("crowd"), F.expr(f"cast(ceil((s - most.m) / {size}) AS int)").alias("g")).filter("g > 0")
    rows = rows.join(crowd, "root").withColumn("guest", F.pmod(F.xxhash64("sig", F.lit(2)), F.col("g")).cast("int"))
    hosts = "transform(sequence(0, g - 1), x -> struct(a AS a, x AS b, true AS host))"
    guests = "filter(transform(sequence(0, k - 1), x -> struct(x AS a, guest AS b, false AS host)), x -> x.a <> a AND label <> crowd)"
    rows = rows.select("root", "sig", "label", F.explode(F.expr(f"concat({hosts}, {guests})")).alias("x")).select("root", "sig", "label", "x.a", "x.b", "x.host")
    return components(out.unionByName(run(rows))).select(F.col("node").alias("u"), F.col("root").alias("v"))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keyed: bool = False) -> DataFrame:
    """Components of the documents whose shingle sets have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles and component_id, the least doc_id reachable.
    Null and empty texts have no shingles and are alone; texts of fewer than
    ``words`` words have one; equal texts are linked; rows with equal ids are
    judged by their texts; other columns are not read.  ``keyed`` adds each row's
    key (two hashes of doc_id and text) and head, the key of its component's first
    row: by doc_id, null ones last.  Of texts any length counts whole; an empty
    table gives no rows; ties have no choice to make, as links are symmetric.
    """
    docs = B.replayable(docs)
    n = B.n_blocks(docs)
    rows = stored(classes(docs, words, n, keyed), "shingle-classes")
    full = rows.filter("n > 0")
    own = full.groupBy("sig").agg(F.min("block").alias("block"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key") if keyed else "doc_id").alias("first_id"))
    cand = stored(candidates(docs, stored(own.select("block", "sig"), "class-heads"), words, percent, n), "candidates")

    def tokens(batches):
        for b in batches:
            p = [_u64(x.as_buffer()) for x in b.column(1)]
            of = pa.array(np.repeat(np.arange(len(p)), [len(x) for x in p]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate(p).view(np.int64) if p else [], pa.int64())], ["sig", "token"])

    post = cand.select("sig", "prefix").mapInArrow(tokens, "sig binary, token long")
    # A shingle's list is linked in parts, and the parts' heads with each other: no list is one task's.
    post = post.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALT)).cast("int"))
    head = post.groupBy("token", "salt").agg(F.min("sig").alias("v"), F.count("*").alias("c"))
    top = head.groupBy("token").agg(F.min("v").alias("w"), F.sum("c").alias("c")).filter("c > 1").drop("c")
    within = post.join(head.filter("c > 1"), ["token", "salt"]).select(F.col("sig").alias("u"), "v")
    near = components(within.unionByName(head.join(top, "token").select(F.col("v").alias("u"), F.col("w").alias("v"))))
    linked = searched(cand, near, percent)
    whole = own.join(linked, own.sig == linked.u, "left").select("sig", "first_id", F.coalesce("v", "sig").alias("v"))
    least = whole.groupBy("v").agg(F.min("first_id").alias("component_id"))
    whole = whole.join(least, "v").select("sig", "component_id")
    if keyed:
        out = full.join(whole, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id.doc_id", "key", F.col("component_id.key").alias("head")).toDF("doc_id", "n_shingles", "component_id", "key", "head")
        return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.col("key").alias("head")))
    out = full.join(whole, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, shingles of 4 words, 85 in 100."""
    return near_groups(table(spark, sf_dir, "documents"))


#: The same rows by counting the common shingles of all pairs that have any.
ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(b, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ ON a = d.doc_id
"""
