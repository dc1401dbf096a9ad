"""Packing: whole tokens in every place, gapless sequences, as few as best-fit-decreasing finds one document at a time."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import packing

SCHEMA = "doc_id long, text string, length long, key string, place int, rank int, bin int, pid int, ids string"
VOC = ["one", "two", "three", "zebra", "quixotic", "é", "日本"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, 5, "z") for i, t in rows], SCHEMA).repartition(4)


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOC, k=n))


def one_by_one(lengths, capacity):
    """Best-fit, longest first, a document at a time: how full each sequence is."""
    gaps, out = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(gaps, n)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        out += gap == capacity
        if gap > n:
            insort(gaps, gap - n)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_pack_as_documents_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 50, 200])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 900))] + [r.randint(1, max(1, capacity // 9))] * r.randint(0, 500)
    count = Counter(lengths)
    used, seen = defaultdict(list), Counter()
    for length, lo, hi, first, each, offset in packing.best_fit(list(count.items()), capacity):
        assert (hi - lo) % each == 0
        for k in range(hi - lo):
            used[first + k // each].append((offset + k % each * length, length))
        seen[length] += hi - lo
    assert seen == count
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= capacity
    assert sorted(used) == list(range(one_by_one(lengths, capacity)))


def test_moves_do_not_grow_with_the_documents():
    r = random.Random(3)
    shape = [(n, r.randint(1, 50)) for n in range(1, 2049)]
    few, many = (len(packing.best_fit([(n, k * times) for n, k in shape])) for times in (1, 10_000))
    assert many < 2 * few


def check(spark, rows, capacity):
    got = packing.packed(frame(spark, rows), capacity=capacity, ids=True).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, n in enumerate(packing.cuts(len(ids), capacity)):
            start = sum(packing.cuts(len(ids), capacity)[:k])
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), tuple(ids[start : start + n])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    per = defaultdict(list)
    for r in got:
        per[r.sequence_id].append((r.offset, r.length))
    for places in per.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= capacity
    assert len(per) == one_by_one([r.length for r in got], capacity)
    return got


def test_nulls_copies_long_texts_and_ties(spark):
    rows = [(k, prose(k, random.Random(k).randint(0, 60))) for k in range(150)] + [(None, None), (None, ""), (7, None), (1, prose(5, 4000)), (2, "a" * 3000)]
    rows += [(9, prose(1, 12))] * 400
    got = check(spark, rows, 64)
    assert max(r.piece for r in got) > 20


def test_only_longer_documents_are_cut():
    assert packing.cuts(2048, 2048) == [2048] and packing.cuts(2049, 2048) == [1, 2048] and packing.cuts(6144, 2048) == [2048] * 3 and packing.cuts(1, 2048) == [1]


def test_empty_table(spark):
    assert packing.packed(frame(spark, [])).collect() == []


def test_one_length_fills_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 100)
    monkeypatch.setattr(packing, "RANKS", 64)
    check(spark, [(1, "one two three")] * 1500 + [(k, prose(k, 9)) for k in range(40)], 32)
