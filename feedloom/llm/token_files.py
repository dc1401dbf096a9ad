"""Token ids in files of independent zstandard frames (operator 3).

A file has a frame for each document, then a skippable frame with the documents'
ids and token counts, then the seek table of the zstandard seekable format: each
frame's compressed and decompressed size and checksum.  A reader finds a document
in the tables at the end and decompresses its frame alone.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import input_bytes, kept, new_path, table

END_ID = 0
#: Fixed values of the zstandard seekable format, and a skippable frame's magic number for our directory.
SEEK_MAGIC, SKIP_SEEK, SKIP_OURS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
NAME = "byte_bpe_50k.json"
#: Encodings of words that a worker remembers.
MEMORY = 800_000
APART = re.compile(r"\s\s|\x1f")
#: Blank and line feed; and bytes that begin any other white space in UTF-8, or the mark of parts.
PLAIN_WHITE, ODD = np.zeros(256, bool), np.zeros(256, bool)
PLAIN_WHITE[[0x20, 0x0A]] = True
ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's pre-tokenizer never joins what a single blank or line feed
    parts, so such texts are encoded by parts, each distinct part once; a text
    with blanks in a row, or with an added token's own text, is encoded as it is.
    New parts of one word go to the library as one text: a token that begins with
    a blank begins a part.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # parts come once: its own cache only costs
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        blank = next(iter(self.tok.encode(" ", add_special_tokens=False).tokens))
        self.begins = np.array([(self.tok.id_to_token(i) or "").startswith(blank) for i in range(size)])
        self.end = np.array([END_ID], self.kind).tobytes()
        self.known: dict[bytes, bytes] = {}  # of parts as UTF-8

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, parts: list[str], ids: Iterable[bytes]) -> None:
        self.known.update(zip((p.encode("utf-8", "surrogatepass") for p in parts), ids, strict=True))

    def _learn(self, new: list[str]) -> None:
        words, others = [], []
        for p in new:
            (words if p[:1] == " " and p[1:].split() == [p[1:]] else others).append(p)
        self._keep(others, self._ids(others))
        if words:
            ids = np.array(self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(words):
                return self._keep(words, self._ids(words))
            raw, w = ids.tobytes(), self.kind.itemsize
            at = (at * w).tolist()
            self._keep(words, (raw[x:y] for x, y in zip(at, [*at[1:], len(raw)], strict=True)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and the end's, as bytes."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = [x or any(a in t for a in self.added) for x, t in zip(apart(texts, raw), texts, strict=True)]
        if len(self.known) > self.memory:
            self.known.clear()
        got = iter(self._by_parts([r for r, x in zip(raw, whole, strict=True) if not x]))
        return [self._ids([t])[0] + self.end if x else next(got) for x, t in zip(whole, texts, strict=True)]

    def _by_parts(self, raw: list[bytes]) -> list[bytes]:
        """The same of texts as UTF-8 that can be parted: distinct parts are looked up once, and ids are gathered by their numbers."""
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        begins = np.zeros(len(data) + 1, bool)
        begins[ends - size] = True
        begins[:-1] |= PLAIN_WHITE[data]
        begins[1:] |= data == 0x0A
        begins[-1] = False
        at = np.flatnonzero(begins)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        words = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([w.decode("utf-8", "surrogatepass") for w in words if w not in self.known])
        ids = pa.array([*map(self.known.__getitem__, words), self.end], pa.large_binary())
        # Each text's parts by their numbers, and the end's after them.
        upto = np.searchsorted(at, ends)
        got = ids.take(pa.array(np.insert(parts.indices.to_numpy(), upto, len(words))))
        stop = np.frombuffer(got.buffers()[1], np.int64)[upto + np.arange(1, len(raw) + 1)].tolist()
        out = memoryview(got.buffers()[2])
        return [bytes(out[x:y]) for x, y in zip([0, *stop], stop)]


def apart(texts: list[str], raw: list[bytes]) -> list[bool]:
    """Which texts, also given as UTF-8, hold blanks in a row, or a character that marks parts; bytes that can't begin either are passed over quickly."""
    data = np.frombuffer(b"\0".join(raw), np.uint8)
    white = PLAIN_WHITE[data]
    odd = np.zeros(len(data) + 1, bool)
    odd[:-1] = ODD[data]
    odd[: max(0, len(data) - 1)] |= white[1:] & white[:-1]
    off = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    hit = np.concatenate([[0], np.cumsum(odd)])
    most = len(hit) - 1
    return [bool(x) and bool(APART.search(t)) for x, t in zip(hit[np.minimum(off[1:] - 1, most)] - hit[np.minimum(off[:-1], most)], texts, strict=True)]


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """A worker's encoder: it keeps what it knows, ``memory`` words at most, from task to task, until the worker has other work."""
    return kept(f"encoder {path} {memory}", lambda: Encoder(path, memory))


class Writer:
    """Appends documents to one open file."""

    def __init__(self, out, kind: np.dtype):
        self.out, self.kind = out, kind
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.table, self.ids, self.null, self.counts = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // self.kind.itemsize)

    def close(self) -> int:
        n = len(self.ids)
        ours = struct.pack("<IB", n, self.kind.itemsize) + np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(struct.pack("<II", SKIP_OURS, len(ours)) + ours)
        seek = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", n, 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)
        return sum(self.counts)


class Reader:
    """Documents of one file by their place; ``f`` is an open file that can seek.  Raises ValueError for a damaged one."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, 2)
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        at = size - 9 - 12 * n - 8
        f.seek(at)
        if struct.unpack("<II", f.read(8)) != (SKIP_SEEK, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        f.seek(int(self.first[-1]))
        magic, length = struct.unpack("<II", f.read(8))
        ours = f.read(length)
        count, width = struct.unpack_from("<IB", ours)
        if magic != SKIP_OURS or count != n or length != 5 + 13 * n:
            raise ValueError("the directory is damaged")
        self.kind = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(ours, "<i8", n, 5)
        self.null = np.frombuffer(ours, "u1", n, 5 + 8 * n).astype(bool)
        self.counts = np.frombuffer(ours, "<u4", n, 5 + 9 * n)
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def places(self, doc_id: int | None) -> np.ndarray:
        return np.flatnonzero(self.null if doc_id is None else ~self.null & (self.ids == doc_id))

    def tokens(self, place: int) -> np.ndarray:
        """One document's ids; only its frame is read."""
        packed, plain, check = (int(x) for x in self.table[place])
        self.f.seek(int(self.first[place]))
        got = self.zstd.decompress(self.f.read(packed), max_output_size=plain)
        if len(got) != plain or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != check:
            raise ValueError(f"document {place} is damaged")
        return np.frombuffer(got, self.kind)


def opened(path: str):
    """(file system, path in it) of a path or URI that all executors share."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def n_files(size: int) -> int:
    """Files of 16 MB of input at least and 256 MB at most."""
    return max(8, -(-size // min(256 << 20, max(16 << 20, size // 2000))))


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> list[tuple[str, int, int]]:
    """Write all texts of ``docs`` to ``path``, ascending by doc_id (null first): (file, documents, ids) of each file, in order.

    A task writes under a name of its own and renames at its end, so a task that
    runs again, or twice at once, leaves one whole file.
    """
    n = n_files(input_bytes(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("copy"))
    # Where a row was read parts equal rows, so one that a third of the table repeats fills many files.
    rows = rows.repartitionByRange(n, "doc_id", "h", "copy").sortWithinPartitions("doc_id", "h", "copy")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/part-{task.partitionId():06d}.tok", f"{root}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        encode, many = encoder(tokenizer), 0
        with fs.open_output_stream(own) as out:
            w = Writer(out, encode.kind)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                        w.add(doc_id, ids)
            many = w.close()
        fs.move(own, name)
        yield pa.RecordBatch.from_pylist([{"file": name, "n": len(w.ids), "ids": many}])

    got = rows.mapInArrow(run, "file string, n long, ids long").collect()  # a row for each file
    return sorted((r.file, r.n, r.ids) for r in got)


def read_tokens(spark: SparkSession, path: str, files: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids if wanted) of every document in the files, decompressed frame by frame."""
    start, rows = 0, []
    for name, _, ids in files:
        rows.append((name, start))
        start += ids
    index = spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows)), "file")
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches):
        fs, _ = opened(path)
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(name) as f:
                    r = Reader(f)
                    for lo in range(0, len(r), 256):
                        out = []
                        for k in range(lo, min(lo + 256, len(r))):
                            ids = r.tokens(k)
                            out.append((None if r.null[k] else int(r.ids[k]), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids] * with_ids))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def encoded(docs: DataFrame, tokenizer: str | None = None, ids: bool = True, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back.

    Null and empty texts have the end id alone; a text of any length is one
    frame; repeated rows are all written, and rows that tie in doc_id come in the
    order of their texts' hashes; an empty table gives files without documents;
    other columns are not read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(NAME)
    path = path or new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, path, write_tokens(docs, tokenizer, path), ids)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` through the files."""
    return encoded(table(spark, sf_dir, "documents"), ids=False)
