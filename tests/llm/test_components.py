"""Components in one task and by stars are the same; searches find every link between components."""

import random

import numpy as np
import pytest

from feedloom.llm import jaccard
from feedloom.llm.components import components


def least(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, most):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (3, 4), (4, 3)]
    want = least(130, pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "u long, v long"), most).collect()}
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "u binary, v binary"), most).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_are_those_of_all_pairs(seed):
    r = random.Random(seed)
    base, sets = [r.getrandbits(60) for _ in range(80)], []
    for _ in range(120):
        s = set(base) if r.random() < 0.7 else {r.getrandbits(60) for _ in range(r.randint(1, 40))}
        for x in r.sample(sorted(s), r.randint(0, min(len(s) - 1, 15))):
            s.discard(x)
            s.add(r.getrandbits(60) if r.random() < 0.7 else r.choice(base))
        sets.append(s)
    host, label = [r.random() < 0.6 for _ in sets], [i if r.random() < 0.9 else 0 for i in range(len(sets))]
    pairs = [(a, b) for a in range(120) for b in range(a) if (host[a] or host[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    pairs += [(a, b) for a in range(120) for b in range(a) if label[a] == label[b]]
    assert jaccard.links(label, host, [np.array(sorted(s), np.uint64) for s in sets]) == least(120, pairs)
