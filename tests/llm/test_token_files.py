"""Files read back by single documents, their checksums, and damage that is found."""

import glob
import io
import zlib

import numpy as np
import pytest

from feedloom.llm import token_files


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_files.NAME))
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]


def test_single_documents_and_checksums(spark, tokens, tmp_path):
    rows = [(i, f"word{i} of  text\n\n{i}\tend é日" * (i % 7)) for i in range(60)] + [(None, "no id"), (3, "again"), (200, None), (201, "long " * 50_000)]
    got = token_files.encoded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path=str(tmp_path / "t"), ids=False).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (i is not None, i, len(x := tokens(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows
    )
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    seen = 0
    for path in glob.glob(str(tmp_path / "t/*.tok")):
        with open(path, "rb") as f:
            r = token_files.Reader(f)
            seen += len(r)
            for i in (3, 59, None):
                for place in r.places(i):
                    assert r.tokens(place).tolist() in [tokens(t) for j, t in rows if j == i]
    assert seen == len(rows)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_one_document_reads_one_frame_and_damage_is_found():
    out = io.BytesIO()
    w = token_files.Writer(out, np.dtype("<u2"))
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, 2000).astype("<u2") for _ in range(50)]
    for i, d in enumerate(docs):
        w.add(i, d.tobytes())
    assert w.close() == 100_000
    raw = out.getvalue()
    f = Counted(raw)
    r = token_files.Reader(f)
    before = f.read_bytes
    assert (r.tokens(17) == docs[17]).all() and f.read_bytes - before == r.table[17, 0] < len(raw) / 40
    hurt = bytearray(raw)
    hurt[int(r.first[17]) + 20] ^= 1
    hurt = token_files.Reader(io.BytesIO(bytes(hurt)))
    assert (hurt.tokens(16) == docs[16]).all()
    with pytest.raises(Exception):  # the frame's own checksum or ours
        hurt.tokens(17)
    for cut in (raw[:-1], raw[:-9] + b"\0" * 9, raw[:-30] + raw[-29:]):
        with pytest.raises(ValueError):
            token_files.Reader(io.BytesIO(cut))


def test_a_row_that_most_of_the_table_repeats_fills_many_files(spark, tmp_path):
    import statistics

    import public_tokenizers

    rows = [(7, "one and the same")] * 3000 + [(k, f"other {k}") for k in range(600)] + [(None, None)] * 1000
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    files = token_files.write_tokens(docs, public_tokenizers.path(token_files.NAME), str(tmp_path / "t"))
    sizes = [n for _, n, _ in files]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * statistics.median(sizes)
    got = token_files.read_tokens(spark, str(tmp_path / "t"), files, False).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *__import__("itertools").accumulate(r.n_tokens for r in got)][:-1]


def test_a_part_is_looked_up_once_a_batch_however_often_it_occurs(tokens):
    import public_tokenizers

    class Looked(dict):
        times = 0

        def __getitem__(self, key):
            self.times += 1
            return super().__getitem__(key)

    e = token_files.Encoder(public_tokenizers.path(token_files.NAME))
    e.known = Looked()
    texts = ["the cat, the dog\nthe é日 cat" * 200, "", "\n", " the", "a  b\tc", "the\n\ncat", "cat\x1f the", "🙂 12's"] * 5
    assert e(texts) == [np.array(tokens(t), e.kind).tobytes() for t in texts]
    assert 0 < e.known.times < 40
