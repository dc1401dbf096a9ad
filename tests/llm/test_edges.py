"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns: each has a defined result."""

import hashlib
import math
import random

import pytest

import corpus_pipeline
from feedloom.llm import byte_dedup, decontaminate, jaccard, mixing, passage_dedup, slots, suffix_lm, token_files, toxicity, vectors

#: Names that the operators use themselves come as extra columns.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, block int, h long, size long, place int, words string, score double, row string, key string, sig string, copies int"


def vocabulary(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


VOC = vocabulary(1, 500)
BIG = " ".join(random.Random(2).choices(VOC, k=60_000))


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOC, k=n))


TEXTS = [
    (1, prose(1, 200)), (2, prose(1, 200)), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two three"), (8, BIG), (None, prose(9, 80)), (None, None),
    (10, prose(10, 150)), (10, prose(10, 150)), (11, prose(11, 100) + " é ü 日本 😀 " + prose(12, 100)), (12, "a" * 5000), (13, "z " * 3000), (14, prose(1, 150) + " " + prose(13, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", [None, "a", "b", "c"][k % 4], None, *[None] * 3, 1, "w", 0.5, "r", "k", "s", 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(10, 20)), (2, None), (3, ""), (None, "one two"), (5, prose(99, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def by_text(df, *cols):
    return sorted(df.select(*cols).collect(), key=lambda r: [(x is None, x) for x in r])


def words_kept(windows=35):
    seen, out = {}, []
    for _, t in TEXTS:
        w = (t or "").encode().split()
        for k in range(len(w) - windows + 1):
            g = tuple(w[k : k + windows])
            seen[g] = seen.get(g, 0) + 1
    for i, t in TEXTS:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - windows + 1):
            if seen[tuple(w[k : k + windows])] > 1:
                gone[k : k + windows] = [True] * windows
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


def test_passages(docs, none):
    got = by_text(passage_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert [tuple(r) for r in got] == words_kept()
    assert passage_dedup.remove_repeats(none).count() == 0


def bytes_kept(window=400):
    seen, out = {}, []
    for _, t in TEXTS:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            h = hash(b[k : k + window])
            seen[h] = seen.get(h, 0) + 1
    for i, t in TEXTS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[hash(b[k : k + window])] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=lambda r: [(x is None, x) for x in r])


def test_bytes(docs, none):
    got = by_text(byte_dedup.remove_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [tuple(r) for r in got] == bytes_kept()
    assert byte_dedup.remove_repeated_bytes(none).count() == 0


def test_toxicity(docs, none):
    model = toxicity.train([f"fine words. {w} here. more" for w in VOC[:50] for _ in range(6)] + [f"fine words. {w} idiot here. more" for w in VOC[:50] for _ in range(2)], [0] * 300 + [1] * 100)
    got = {(r.doc_id, r.text): r for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    assert len(got) == len({*TEXTS}) and all(0 <= r.score <= 1 for r in got.values())
    assert got[3, None].score == got[4, ""].score < 0.5
    bad = toxicity.score(docs.limit(1).selectExpr("doc_id", "'All well. You idiot go. Fine.' AS text"), model).first()
    assert bad.score > 0.5 and [(x.start, x.end) for x in bad.offending] == [(9, 22)]
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0
    assert toxicity.train([], [])[1] < 0 and toxicity.train(["a"], [1])[1] > 0


def test_tokens(docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = token_files.encoded(docs, path=str(tmp_path / "t")).orderBy("start").collect()
    want = {(i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in TEXTS}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want and len(got) == len(TEXTS)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert token_files.encoded(none).count() == 0


def test_language_model(docs, none):
    got = suffix_lm.scored(docs).collect()
    assert len(got) == len(TEXTS) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert suffix_lm.scored(none).count() == 0


def test_shards(docs, none):
    out, _ = slots.shard_records(docs, 4, 64)
    got = out.collect()
    assert len(got) == len(TEXTS) and sum(r["size"] for r in got) == sum(16 + len((t or "").encode()) for _, t in TEXTS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert slots.shard_records(none)[0].count() == 0


def test_rows_of_one_doc_id_spread_over_shards(spark):
    same = spark.createDataFrame([(1, "x" * 84)] * 4000 + [(2, f"t{i}") for i in range(4000)], "doc_id long, text string").repartition(4)
    out, first = slots.shard_records(same, 8, 512)
    got = out.collect()
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(load) < 1.1 * min(load) and len({r.virtual_slot for r in got if r.doc_id == 1}) > 400
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.next_shard in (r.shard, 8) for r in got) and first.version == 1


def test_map_versions_are_stored(spark, tmp_path):
    path, w = str(tmp_path / "maps"), {i: 10 + i % 3 for i in range(64)}
    one = slots.SlotMap.fit(w, 64, 4)
    one.save(spark, path)
    one.grow(w).save(spark, path)
    assert slots.SlotMap.load(spark, path, 1) == one and slots.SlotMap.load(spark, path) == one.grow(w)


def test_slot_map_edits():
    w = {i: 100 + i % 7 for i in range(1000)}
    one = slots.SlotMap.fit(w, 1000, 10)
    two = one.grow(w)
    assert two.version == 2 and all(a == b or b == 10 for a, b in zip(one.shard, two.shard, strict=True))
    load = [sum(w[i] for i in w if two.shard[i] == s) for s in range(11)]
    assert max(load) < 1.12 * min(load) and slots.SlotMap.from_json(two.to_json()) == two


def test_mix(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.copies <= 3 for r in got)
    total = sum(len((t or "").split()) for _, t in TEXTS)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6 * total or any(abs(r.target - 3 * r.source_size) < 1e-6 for r in got)
    assert mixing.mixed(none).count() == 0


def by_hand(sizes, weights, most=3):
    """The contract's targets, one source after another."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            return out | {i: left * weights[i] / total for i in open_}
        out |= {i: float(most * sizes[i]) for i in over}
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [1, 1, 1, 900, 2, 3], [0, 5, 0, 7], [4], [3] * 9, [1, 10, 100, 1000, 10000, 5, 50]])
def test_targets_reshare_the_excess(spark, sizes):
    rows = spark.createDataFrame([(None if i == len(sizes) - 1 else f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, size long, m long")
    got = {r.sid: r for r in mixing.shares(rows.repartition(3)).collect()}
    want = by_hand(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    for i, n in enumerate(sizes):
        assert got[i].source_size == n and got[i].target == pytest.approx(want[i], rel=1e-12)
        assert got[i].rate == pytest.approx(want[i] / n if n else 1.0, rel=1e-9, abs=1e-20)


def test_mix_keeps_to_targets_when_rows_repeat(spark):
    rows = [(1007, "a b c d e", "x")] * 400 + [(i, prose(i, 5 + i % 40), "xyz"[i % 3]) for i in range(300)] + [(None, None, None)] * 20
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(got) == len(rows)
    for s in "xyz":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 44 and {r.taken for r in own if r.doc_id == 1007} <= {0, 5, 10, 15}
    assert all(r.taken <= 3 * r["size"] and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got if r["size"])


def test_vectors(spark):
    r = random.Random(3)
    v = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000 + i, [1.0] + [0.5] * 7) for i in range(60)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<float>")
    got = vectors.search(df, df.filter("vec_id % 20 = 0"), top=5, goal=1.0).orderBy("query_id", "rank").collect()
    import numpy as np

    ids, x = np.array([i for i, _ in v]), np.array([e for _, e in v], np.float32).astype(float)
    want = []
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        want += [(q, k + 1, ids[j]) for k, j in enumerate(np.lexsort((ids, -s))[:5])]
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == want
    assert vectors.search(df.limit(0), df.limit(0)).count() == 0


def nearest(ids, x, queries, top):
    """(query, rank, id, score) by comparing all."""
    import numpy as np

    out = []
    for q in queries:
        s = (x * x[list(ids).index(q)]).sum(1)
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
        out += [(q, k + 1, int(ids[j]), float(s[j])) for k, j in enumerate(o)]
    return out


def test_double_ragged_and_repeated_vectors(spark):
    import numpy as np

    r = random.Random(8)
    v = [(i, [r.gauss(0, 1) / 3 for _ in range(5)]) for i in range(120)]
    odd = [(200, [1.0] * 4), (201, []), (202, [2.0] * 6), (203, [0.0] * 5)]
    df = spark.createDataFrame([(*x, 0.5, 1) for x in v + odd], "vec_id int, embedding array<double>, leaf float, bin int")
    got = vectors.search(df, df.filter("vec_id % 20 = 0"), top=6, goal=1.0).orderBy("query_id", "rank").collect()
    ids, x = np.array([i for i, _ in v]), np.array([e for _, e in v])
    want = nearest(ids, x, range(0, 120, 20), 6)
    assert [(g.query_id, g["rank"], g.vec_id) for g in got] == [w[:3] for w in want]
    assert [g.score for g in got] == pytest.approx([w[3] for w in want], rel=1e-15)
    twice = df.unionByName(df.filter("vec_id < 3"))
    got = vectors.search(twice, twice.filter("vec_id = 20"), top=130, goal=1.0).collect()
    assert len({g.vec_id for g in got}) == 119 and len(got) == 122


def test_queries_and_rows_of_one_id(spark):
    """Each row of an id has a list of its own, which leaves out itself and no other; equal rows have equal lists."""
    import numpy as np

    r = random.Random(18)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(1, 60)] + [(0, [r.gauss(0, 1) for _ in range(6)]) for _ in range(3)]
    rows += [rows[-1]] * 2 + [(7, rows[6][1])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ids, x, want = np.array([i for i, _ in rows]), np.array([e for _, e in rows]), []
    for q in np.flatnonzero(ids % 7 == 0):
        s = (x * x[q]).sum(1)
        o = [j for j in np.lexsort((ids, -s)) if j != q][:9]
        want.append((int(ids[q]), tuple((int(ids[j]), round(float(s[j]), 9)) for j in o)))
    got = {}
    rows_got = vectors.search(df, df.filter("vec_id % 7 = 0"), top=9, goal=1.0).orderBy("query_id", "rank").collect()
    assert len(rows_got) == 9 * len(want)
    for g in rows_got:
        got.setdefault((g.query_id, g["rank"]), []).append((g.vec_id, round(g.score, 9)))
    for (q, rank), have in got.items():
        assert sorted(have) == sorted(w[rank - 1] for i, w in want if i == q)


def test_calibrated_search_visits_few_leaves_of_clustered_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 16))
    x = (centre[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    info = {}
    got = vectors.search(df, df.filter("vec_id % 50 = 0"), top=10, info=info).collect()
    want = nearest(np.arange(6000), x.astype(float), range(0, 6000, 50), 10)
    found = {(g.query_id, g.vec_id) for g in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want) and len(got) == len(want)
    assert info["visits"] < info["leaves"] / 2 and info["leaves"] > 30


def test_near_groups(docs, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got[1, 197] == got[2, 197] == 1 and got[3, 0] == 3 and got[6, 1] == 6 and got[7, 1] == 7
    assert jaccard.near_groups(docs).count() == len(TEXTS)
    assert jaccard.near_groups(none).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 2000])
def test_near_copies_in_large_groups(spark, monkeypatch, limit):
    """A chain and a crowd of near copies, also when the group is searched by pairs of parts."""
    monkeypatch.setattr(jaccard, "MOST", limit)
    base, rows = prose(50, 120).split(), []
    for k in range(40):
        w = list(base)
        w[k * 3 % 120] = f"new{k}"
        rows.append((k, " ".join(w)))
    walk = list(base)
    for k in range(30):
        walk[(k * 2 + 1) % 120] = f"walk{k}"
        rows.append((50 + k, " ".join(walk)))
    rows += [(100 + k, prose(200 + k, 90)) for k in range(10)] + [(200, " ".join(base[:60]) + " " + prose(300, 60))]
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, docs, none, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    items = [(1, prose(10, 20)), (2, None), (3, ""), (4, "one two"), (5, prose(99, 30)), (6, "ONE"), (7, prose(10, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[10, 150].n_hit, got[10, 150]["items"]) == (20, ["1", "7"])
    assert (got[6, 1].n_hit, got[6, 1]["items"]) == (1, ["6"]) and (got[7, 3].n_hit, got[7, 3]["items"]) == (2, ["4", "6"])
    assert got[3, 0].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[1, 200].contaminated
    assert decontaminate.contamination(docs, bench).count() == len(TEXTS)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(none, bench).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    for d in (docs, none):
        out = stage(spark, d, folder)
        assert out.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if k == 4 else docs.columns), name
        n = out.count()
        assert n == 0 if d is none else n > 0
    if k == 1:
        ids = [r.doc_id for r in stage(spark, docs, folder).collect()]
        assert ids.count(1) == 1 and 2 not in ids and ids.count(10) == 1 and ids.count(None) == 2 and {3, 4, 5, 6, 7, 8} <= {*ids}
    if k == 2:
        ids = [r.doc_id for r in stage(spark, docs, folder).collect()]
        assert 10 not in ids and {1, 2, 3, 4, 6, 8} <= {*ids}


@pytest.mark.parametrize("k", range(4))
def test_stages_leave_clashing_columns_alone(spark, folder, k):
    """Columns named as a stage's own, and rows whose ids repeat or are missing."""
    names = ["a", "b", "total", "total_", "score", "offending", "_score", "_key", "_n", "_copies"]
    rows = [(i, t, "s", *[j * 10 + k for k in range(len(names))]) for j, (i, t) in enumerate([(1, prose(70, 60)), (10, prose(70, 60)), (10, prose(71, 60)), (None, prose(70, 60)), (None, prose(72, 60)), (None, None), (5, "")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    got = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert got.columns == docs.columns
    got = [tuple(r) for r in got.collect()]
    assert set(got) <= set(rows)
    if k == 1:  # of the three rows of one text the one with the least id stays; texts under a repeated id are judged on their own
        assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)
    if k in (0, 2):
        assert sorted(got, key=str) == sorted(rows, key=str)
