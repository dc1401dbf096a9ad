"""Toxicity by multiple-instance learning (operator 2).

A document is toxic if a sentence is: P = 1 - product of (1 - p) over its
sentences, with p = sigmoid(bias + the weights of its words' features).  Only
documents are labelled; the gradient through noisy-or finds the sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, table
from .textops import LOWER, SLICE, Prefix, U, buffers, byte_values, pieces, runs

BITS = 20
#: Labelled rows to learn from at most, those with the smallest hashes; bytes of their texts in all, and of one.
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 8_000, 64 << 20, 4 << 20
#: Features kept: present in so many documents at least, and in so many standard deviations more or fewer toxic ones than by chance.
LEAST_DOCS, TELLING = 5, 2.5
STEMS = (4, 5, 6)
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, feature) of every feature, each sentence's document, and the sentences' byte ranges.

    Features are the words, lower-cased by letters A-Z, and their first 4, 5 and 6 bytes, hashed.
    """
    low = LOWER[data]
    a, b, _ = runs(LETTER[low], off)
    sa, sb, at = runs(~STOP[low], off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    sent = np.searchsorted(sa, a, side="right") - 1
    h = Prefix(low, 5, byte_values(5))
    got, where = [h.of(a, b)], [sent]
    for k in STEMS:
        long = b - a > k
        got.append(h.of(a[long], a[long] + k) ^ U(k))
        where.append(sent[long])
    return np.concatenate(where), (np.concatenate(got) >> U(64 - BITS)).astype(np.int64), doc, sa, sb


def train(texts, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights for each feature, and the bias, from labelled documents; without both labels, weights of 0 and the base rate."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(1 << BITS, np.float32), -4.0 if not len(y) or y.max() == 0 else 4.0
    n_doc = len(y)
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    col = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy()

    def parts():
        for lo, hi in pieces(sizes, SLICE):
            s, f, doc, _, _ = features(*buffers(col.slice(lo, hi - lo)))
            yield lo, s, f, doc

    for lo, s, f, doc in parts():
        d = np.unique(doc[s] * np.int64(1 << BITS) + f) if len(s) else np.zeros(0, np.int64)
        df, dd = d & ((1 << BITS) - 1), (d >> BITS) + lo
        np.add.at(pos, df, y[dd])
        np.add.at(neg, df, 1 - y[dd])
    rate = y.mean()
    expect = (pos + neg) * rate
    z = (pos - expect) / np.sqrt(np.maximum(expect * (1 - rate), 0.25))
    kept = np.flatnonzero((pos + neg >= LEAST_DOCS) & (np.abs(z) >= TELLING))
    if not len(kept):
        return np.zeros(1 << BITS, np.float32), float(np.log(rate / (1 - rate)))
    new = np.full(1 << BITS, -1, np.int64)
    new[kept] = np.arange(len(kept))
    held, doc_of, sents = [], [], 0
    for lo, s, f, doc in parts():  # again, for the kept features only: all of them need more memory than the texts
        f = new[f]
        held.append(np.unique((s[f >= 0] + sents) * np.int64(len(kept)) + f[f >= 0]))  # a feature counts once in a sentence
        doc_of.append(doc + lo)
        sents += len(doc)
    doc_of, pair = np.concatenate(doc_of), np.concatenate(held)
    s, f = pair // len(kept), pair % len(kept)
    used, s = np.unique(s, return_inverse=True)  # sentences with a feature; others only have the bias
    plain = np.bincount(doc_of, minlength=n_doc) - np.bincount(doc_of[used], minlength=n_doc)
    of = doc_of[used]
    w, bias = np.zeros(len(kept)), -5.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        x = bias + np.bincount(s, w[f], len(used))
        p, p0 = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-bias))
        a = np.bincount(of, np.logaddexp(0, x), n_doc) + plain * np.logaddexp(0, bias) + 1e-12
        d = (1 - y) - y / np.expm1(np.minimum(a, 50))
        gx = d[of] * p
        g = np.append(np.bincount(f, gx[s], len(kept)) + 0.05 * w, gx.sum() + (d * plain).sum() * p0) / n_doc
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    out = np.zeros(1 << BITS, np.float32)
    out[kept] = w
    return out, float(bias)


def judge(data: np.ndarray, off: np.ndarray, w: np.ndarray, bias: float):
    """Each document's probability, and the sentences (document, start, end, probability) of 0.5 or more; without sentences, sigmoid(bias)."""
    s, f, doc, sa, sb = features(data, off)
    keep = w[f] != 0
    s, f = s[keep], f[keep]
    pair = np.unique(s * np.int64(1 << BITS) + f)
    s, f = pair >> BITS, pair & ((1 << BITS) - 1)
    x = bias + np.bincount(s, w[f], len(doc))
    a = np.bincount(doc, np.logaddexp(0, x), len(off) - 1).astype(float)  # of nothing, counts are whole numbers
    a[np.diff(np.searchsorted(doc, np.arange(len(off)))) == 0] = np.logaddexp(0, bias)
    bad = np.flatnonzero(x >= 0)
    return -np.expm1(-a), doc[bad], sa[bad] - off[doc[bad]], sb[bad] - off[doc[bad]], 1 / (1 + np.exp(-x[bad]))


def trained(batches):
    """The model of one task's rows (text, y, h): the weights that are not 0, by feature, and the bias as feature -1."""
    held = list(batches)
    got = pa.Table.from_batches(held).sort_by("h") if held else None
    w, bias = train(got["text"], got["y"].to_numpy()) if held else train([], [])
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept].astype(float), bias))], ["f", "w"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Learn from labelled documents whose crc32(doc_id) mod 5 is not 0.

    ``sample`` rows and ``size`` bytes of whole texts at most reach one task,
    whatever ids repeat or texts weigh, and the driver gets the weights that it
    learns; texts of more than ``ROW_BYTES`` are not learned from.  A doc_id with
    several labels is toxic if one is; rows without a label, id or text are not
    learned from; without rows every text scores low.
    """
    y = labels.filter("toxic is not null and doc_id is not null").filter(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # ``sample`` rows of two numbers: bounded, so that the texts need no shuffle.
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= ROW_BYTES).join(F.broadcast(y), "doc_id")
    rows = rows.select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.select("h", F.octet_length("text").alias("n")).orderBy("h").limit(sample).toArrow()
    upto = sizes["h"].to_numpy()[np.cumsum(sizes["n"].to_numpy()) <= size]
    if not len(upto):
        return train([], [])
    got = rows.filter(F.col("h") <= int(upto[-1])).limit(sample).coalesce(1).mapInArrow(trained, "f long, w double").toArrow()
    f, w = got["f"].to_numpy(), got["w"].to_numpy()
    out = np.zeros(1 << BITS, np.float32)
    out[f[f >= 0]] = w[f >= 0]
    return out, float(w[f < 0][0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """``docs`` with score, and offending (or other ``names`` that are not taken): the byte ranges and probabilities of toxic sentences.  Null and empty texts score alike."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns

    def run(batches):
        w, bias = held.value
        for batch in batches:
            col = batch.column(keep.index("text"))
            p, found = [], []
            for a, b in pieces(np.diff(buffers(col)[1]), SLICE):
                prob, doc, lo, hi, q = judge(*buffers(col.slice(a, b - a)), w, bias)
                p.append(prob)
                per: list[list] = [[] for _ in range(b - a)]
                for d, x, y, z in zip(doc.tolist(), lo.tolist(), hi.tolist(), q.tolist(), strict=True):
                    per[d].append({"start": x, "end": y, "p": z})
                found += per
            p = np.concatenate(p) if p else np.zeros(0)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(found, kind)], [*keep, *names])

    from pyspark.sql.types import StructType

    made = StructType.fromDDL(f"{names[0]} double, {names[1]} array<struct<start: long, end: long, p: double>>")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *made.fields]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; the fifth with crc32(doc_id) mod 5 = 0 is held out from training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
