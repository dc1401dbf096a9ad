"""Collocations against a count of all n-grams in plain Python, and their defined cases."""

import random
import re
from collections import Counter

import pytest

from feedloom.llm import collocations

SCHEMA = "lang string, text string, m int, f long, a long, phrase string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, 2, 3, "x", 0) for lang, text in rows], SCHEMA).repartition(3)


def brute(rows, longest, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out, cand = [], {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    held = set()
    for (lang, w), c in cand.items():
        held |= {(lang, w[i:j], c) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w)}
    for (lang, w), a in cand.items():
        if (lang, w, a) in held:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def texts(seed, n):
    r = random.Random(seed)
    voc = ["New", "york", "CITY", "of", "the", "é", "日本", "x" * 50, "a\x1fb", " ", "in", "on", "it", "no-one"]
    seps = [" ", "  ", "\t", " ", " ", ". ", ", ", "\n", "!?", " \x0b"]
    out = []
    for _ in range(n):
        words = r.choices(voc, k=r.randint(0, 60))
        if r.random() < 0.5:
            words += ["united", "states", "of", "america"] * r.randint(1, 3)
        out.append((r.choice(["en", "de", None, "", "und"]), "".join(w + r.choice(seps) for w in words)))
    return [*out, ("en", None), (None, ""), ("en", " \t\n.,"), ("de", "a a a a a a a a"), ("en", "the of " * 30_000)]


@pytest.mark.parametrize("prune", [True, False])
@pytest.mark.parametrize("longest,least,top", [(5, 4, 2000), (3, 2, 10), (2, 1, 5)])
def test_matches_brute_force(spark, prune, longest, least, top):
    rows = texts(longest, 120)
    got = collocations.collocations(frame(spark, rows), longest, least, top, prune)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, top)


def test_a_full_bit_table_only_makes_more_rows(spark, monkeypatch):
    for name in ("FEWEST", "MOST"):
        monkeypatch.setattr(collocations, name, 64)
    monkeypatch.setattr(collocations, "PART", 64)
    rows = texts(9, 80)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 4, 3).collect())) == brute(rows, 4, 3, 2000)


def test_empty_tables_and_nothing_frequent(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [("en", "a b c"), ("en", None)])).collect() == []


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    frequent = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 9)], "lang string, phrase string, m int, f long")
    row = collocations.scored(frequent, spark.createDataFrame([("en", 90 * big)], "lang string, n long")).first()
    assert row.score == 1000 * big * 90 * big // ((big + 7) * (big + 9)) and row.a == big


def test_one_language_and_one_phrase_hold_nearly_all(spark):
    rows = [("en", "again and again")] * 3000 + texts(4, 20)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 5, 3).collect())) == brute(rows, 5, 3, 2000)


@pytest.mark.parametrize("words", range(7))
def test_fewer_words_than_a_phrase(spark, words):
    rows = [("en", " ".join("abcdefg"[:words]))]
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), 5, 1).collect())) == brute(rows, 5, 1, 2000)


def test_what_a_task_holds_is_bounded_however_long_a_text_is(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150_000)), "b c d e f", ""]
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x"], "text": texts})
    held, counted = [], collocations._counted

    def seen(langs, phrases):
        held.append(sum(a.nbytes for a in [*langs, *phrases]))
        return counted(langs, phrases)

    monkeypatch.setattr(collocations, "CHUNK", 1 << 20)
    monkeypatch.setattr(collocations, "_counted", seen)
    got = list(collocations.gram_rows(iter([batch]), (4, 5)))
    # One text of 150,000 words has 299,993 rows, 10 MB: they leave by parts, in batches that are small in the JVM too.
    assert len(held) > 4 and max(held) <= 4 << 20
    assert max(b.num_rows for b in got) <= collocations.ROWS
    want = Counter()
    for lang, text in zip("xyx", texts, strict=True):
        w = text.split()
        want.update((lang, " ".join(w[i : i + m])) for m in (4, 5) for i in range(len(w) - m + 1))
    have = Counter()
    for b in got:
        for lang, phrase, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
            have[lang, phrase] += f
    assert have == want
