"""Phrase collocation mining (operator 12).

N-grams of one to five words become rows and are hash-aggregated per language, a
length at a time.  A phrase occurs no more often than its parts, so from the
second length on a row is made only if both of its parts that are one word shorter
may occur often enough; a bit table of bounded size says so, and errs only towards
making a row.  Prefix and suffix counts are joined to the frequent phrases, scored
in decimals, and an anti-join drops those that one more word always follows or precedes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import replayable
from .shared import stored, table
from .textops import LOWER, Prefix, U, Words, buffers, byte_values, mix, pieces

#: Longest phrase, least count, rows of each language, and what a language without a name is called.
LONGEST, LEAST, TOP, NAMELESS = 5, 100, 2000, "und"
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
APART, ENDS = np.zeros(256, bool), np.zeros(256, bool)
APART[list(SPACES + BREAKS)] = True
ENDS[list(BREAKS)] = True
#: Lengths up to this have a pass over the texts each; longer ones share one.
ALONE = 3
#: Bits for each frequent phrase, and of a table at least and at most (32 MB); bits of a part of it that one task makes.
BITS, FEWEST, MOST, PART = 64, 1 << 17, 1 << 28, 1 << 17
#: Bytes of rows that are counted together before they leave a task, and rows of a batch that leaves it.
CHUNK, ROWS = 8 << 20, 1 << 15
#: Parts of a language that are ranked by themselves first.
PARTS = 32
COUNTS = "lang string, phrase string, f long"


class Grams:
    """Words of some texts, joined by single blanks in ``text``, and which of them follow each other within a piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, salt: np.ndarray):
        self.w = Words(data, off, LOWER, APART)
        n, size = len(self.w.start), self.w.end - self.w.start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.size = size
        self.text = np.full(self.at[-1], 0x20, np.uint8)
        inner = LOWER[data[~APART[data]]]
        self.text[np.arange(len(inner)) + np.repeat(np.arange(n), size)] = inner
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        self.next = np.zeros(n, bool)
        self.next[:-1] = (ends[self.w.start[1:]] == ends[self.w.end[:-1]]) & (self.w.doc[1:] == self.w.doc[:-1])
        self.salt = salt[self.w.doc] if n else np.zeros(0, U)
        self.sums = Prefix(self.w.hash, 5)

    def starts(self, m: int) -> np.ndarray:
        """A mask of the words that begin a run of m within a piece."""
        ok = np.ones(len(self.next), bool)
        for k in range(m - 1):
            left = max(0, len(ok) - k)
            ok[:left] &= self.next[k:]
            ok[left:] = False
        return ok

    def keys(self, at: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the runs of m words at some places, and of their languages."""
        return mix(self.sums.of(at, at + m) ^ self.salt[at])

    def phrases(self, at: np.ndarray, m: int) -> pa.Array:
        size = self.at[at + m] - 1 - self.at[at]
        off = np.concatenate([[0], np.cumsum(size)])
        data = self.text[np.repeat(self.at[at] - off[:-1], size) + np.arange(off[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))


def salts(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    data, off = buffers(langs)
    return mix(Prefix(data, 6, byte_values(6)).of(off[:-1], off[1:]))


def _counted(langs: list[pa.Array], phrases: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Distinct phrases of each language with their number, a language at a time."""
    codes = pa.chunked_array(langs).combine_chunks().dictionary_encode()
    own, of, all_phrases = codes.dictionary, codes.indices.to_numpy(), pa.chunked_array(phrases).combine_chunks()
    # The rows are whole in one place only.
    langs.clear()
    phrases.clear()
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(own) + 1))
    for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        got = all_phrases.take(pa.array(order[i:j])).value_counts()
        for x in range(0, len(got), ROWS):
            part = got.slice(x, ROWS)
            name = pa.repeat(own[k].as_py(), len(part))
            yield pa.RecordBatch.from_arrays([name.cast(pa.string()), part.field(0).cast(pa.string()), part.field(1)], ["lang", "phrase", "f"])


def _grams(batch: pa.RecordBatch):
    """(lang column, Grams) of slices of a batch (lang, text)."""
    _, off = buffers(batch.column(1))
    for a, b in pieces(np.diff(off)):
        part = batch.slice(a, b - a)
        data, at = buffers(part.column(1))
        yield part.column(0), Grams(data, at, salts(part.column(0)))


def gram_rows(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], bits: np.ndarray | None = None, part: int = 0) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, f) of the texts of some batches (lang, text), counted as far as a bounded number of rows goes; see ``counts``."""
    langs, phrases, held = [], [], 0
    for batch in batches:
        for lang, g in _grams(batch):
            if bits is not None:
                hit = g.starts(part)
                at = np.flatnonzero(hit)
                hit[at] = has(bits, g.keys(at, part))
            for m in lengths:
                ok = g.starts(m)
                for k in range(m - part + 1 if bits is not None else 0):
                    ok[: max(0, len(ok) - k)] &= hit[k:]
                at = np.flatnonzero(ok)
                # A long document alone has more rows than are held at once.
                for i in range(0, len(at), ROWS):
                    langs.append(lang.take(pa.array(g.w.doc[at[i : i + ROWS]])))
                    phrases.append(g.phrases(at[i : i + ROWS], m))
                    held += langs[-1].nbytes + phrases[-1].nbytes
                    if held >= CHUNK:
                        yield from _counted(langs, phrases)
                        langs, phrases, held = [], [], 0
    if phrases:
        yield from _counted(langs, phrases)


def counts(docs: DataFrame, lengths: tuple[int, ...], table_of=None, part: int = 0) -> DataFrame:
    """(lang, phrase, f): occurrences of each run of words of some ``lengths`` in ``docs`` (lang, text).

    ``table_of``, a broadcast bit table, leaves out what holds a run of ``part`` words that is not in it.
    """

    def run(batches):
        return gram_rows(batches, lengths, table_of and table_of.value, part)

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U(len(bits) * 8 - 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_table(frequent: DataFrame, m: int, n: int) -> np.ndarray:
    """A bit for each of the n frequent phrases of m words, BITS times as many in all but 32 MB at most: parts are made by tasks."""
    size = min(MOST, max(FEWEST, 1 << (n * BITS - 1).bit_length()))

    def places(batches):
        for b in batches:
            for _, g in _grams(b):
                at = (g.keys(g.w.at[:-1], m) & U(size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // PART, pa.int32()), pa.array(at % PART, pa.int32())], ["part", "place"])

    def fill(t: pa.Table) -> pa.Table:
        bits = np.zeros(PART, bool)
        bits[t["place"].to_numpy()] = True
        return pa.table({"part": t["part"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    got = frequent.select("lang", "phrase").mapInArrow(places, "part int, place int").distinct().groupBy("part").applyInArrow(fill, "part int, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in got.toLocalIterator():  # 32 MB in all at most
        out[r["part"] * (PART // 8) :][: PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, (lang, n) with the words of each language).

    Without ``prune`` every n-gram becomes a row; the result is the same.
    """
    spark, found, bits, words = docs.sparkSession, [], None, None
    passes = [(m,) for m in range(1, min(longest, ALONE) + 1)] + [tuple(range(ALONE + 1, longest + 1))] * (longest > ALONE)
    for lengths in passes:
        rows = counts(docs, lengths, bits, lengths[0] - 1)
        if lengths[0] == 1:
            # Unfiltered: the words of a language are the sum of their counts.
            rows = stored(rows, "phrase-words")
            words = rows.groupBy("lang").agg(F.sum("f").alias("n"))
        rows = stored(rows.filter(F.col("f") >= least), f"phrases-{lengths[0]}")
        found.append(rows.withColumn("m", F.size(F.split("phrase", " "))))
        if prune and lengths != passes[-1]:
            n = rows.count()
            if not n:
                break
            bits = spark.sparkContext.broadcast(bit_table(rows, lengths[0], n))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out, words


def scored(frequent: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of the phrases of two words or more, by their lowest-scoring cut, the first of those that tie."""
    word = F.split("phrase", " ")
    cand = frequent.filter("m > 1").withColumnRenamed("f", "a")
    cut = cand.select("lang", "phrase", "m", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "m", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ").alias("rest"))
    of = lambda part, f: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(words, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")).cast("decimal(34,0)"), "below": exact("l") * exact("r")}).withColumn("score", F.expr("above div below"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "m", "a", "n")).alias("b"))
    return best.select("lang", "phrase", "b.m", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, prune: bool = True) -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words that hold together best: lang, rank, phrase, a, l, r, n, score.

    A phrase that lies within a longer one which occurs as often is left out.
    Null texts are empty, a null language is NAMELESS; texts count whole, however
    long; repeated rows count each; ties go by count, then by the phrase's bytes;
    an empty table gives no rows; other columns are not read.  ``top`` None keeps all.
    """
    docs = replayable(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NAMELESS)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), "lang", "text")
    frequent, words = frequent_phrases(docs, longest, least, prune)
    got = stored(scored(frequent, stored(words, "phrase-n")), "phrases-scored")
    # One word more at either end, as often: if a longer phrase holds another as often, so do those between them.
    w = F.split("phrase", " ")
    inner = got.filter("m > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("m") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("m") - 1), " "))).alias("phrase"))
    got = got.join(inner, ["lang", "phrase", "a"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # A language may have most phrases: its parts are cut first, and at most ``top`` of each are ranked together.
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        got = got.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        got = got.filter(F.col("rank") <= top)
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same rows by counting all n-grams.
ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
 FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM k),
held AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM c, range(2, 5) t(j) WHERE j < m)),
kept AS (SELECT b.lang, b.phrase, b.a, l, r, n, score FROM b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.phrase = b.phrase AND h.a >= b.a))
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
