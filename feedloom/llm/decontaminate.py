"""Benchmark decontamination by a prefix-filtered set join (operator 10), in DataFrame functions only.

An item's windows are its runs of 10 words.  A window lies in a document only if
all of its shingles do, so one of them, the rarest, is the prefix that must join.
A joined shingle fixes where the window would start; it must fit the document
(length and position), and the document's words there must equal the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import input_bytes, table

WINDOW, SHINGLE = 10, 3
#: Benchmarks of up to so many bytes and windows are broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES, BROADCAST_WINDOWS = 32 << 20, 1 << 19
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Each document's hashes begin with this, and so does the broadcast table: a document without a match keeps one row.
MARK = -0x5EED


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), SEPARATORS), "")


def _shingles(k: int) -> str:
    """Hashes of a document's runs of k words, in order."""
    args = ", ".join(f"words[i + {j}]" for j in range(k))
    return f"CASE WHEN size(words) >= {k} THEN transform(sequence(0, size(words) - {k}), i -> xxhash64({args})) ELSE cast(array() AS array<bigint>) END"


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(hash, k, off, len, win, items): each distinct window once, with the shingle that must join.

    Rarest first: in fewest windows of the benchmark, then the longest in letters.
    Items without words have no window; those shorter than a window are one.
    """
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words().alias("words")).filter("size(words) > 0")
    w = w.withColumn("len", F.least(F.size("words"), F.lit(window)))
    w = w.select("item", "len", F.explode(F.expr("transform(sequence(0, size(words) - len), s -> slice(words, s + 1, len))")).alias("win"))
    w = w.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("len", F.size("win")).withColumn("k", F.least("len", F.lit(shingle)))
    run = "transform(sequence(0, len - k), o -> struct(CASE k " + " ".join(
        f"WHEN {k} THEN xxhash64({', '.join(f'get(win, o + {j})' for j in range(k))})" for k in range(1, shingle + 1)
    ) + " END AS hash, o AS off, length(array_join(slice(win, o + 1, k), '')) AS letters))"
    s = w.select("*", F.explode(F.expr(run)).alias("s")).select("win", "items", "len", "k", "s.*")
    seen = s.groupBy("hash").agg(F.count("*").alias("seen"))
    first = F.min_by(F.struct("hash", "off"), F.struct("seen", -F.col("letters"), "hash", "off")).alias("f")
    return s.join(seen, "hash").groupBy("win").agg(F.first("items").alias("items"), F.first("len").alias("len"), F.first("k").alias("k"), first).select("f.hash", "k", "f.off", "len", "win", "items")


def _start(ks: list[int]) -> Column:
    """Where a window that joined at ``pos`` of a document's hashes would start: the hashes of each k follow each other."""
    at, before = F.lit(None).cast("int"), F.lit(1)
    for k in ks:
        at = F.when(F.col("k") == k, F.col("pos") - before).otherwise(at)
        before = before + F.greatest(F.size("words") - F.lit(k - 1), F.lit(0))
    return at - F.col("off")


def _summed(found: DataFrame, keys: list[str]) -> DataFrame:
    """Hit words and items of each document from its verified windows (start is null where there is none)."""
    hits = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("hits")
    items = F.collect_set(F.when(F.col("start").isNotNull(), F.col("items"))).alias("items")
    out = found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), hits, items)
    hit = F.expr("cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.start, h.start + h.len - 1))))) AS bigint)")
    return out.select(*keys, "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each document's words in windows of benchmark items, and the items.

    Returns doc_id, n_words, n_hit, n_items, items (strings, sorted), items_sha256
    and contaminated.  Null and empty texts have no words; texts count whole,
    however long; each row, repeated or not, gives one; of shingles that are
    equally rare any may join, as words decide; an empty benchmark hits nothing,
    an empty table gives no rows; other columns are not read.
    """
    wins = windows(benchmark, window, shingle)
    small = input_bytes(benchmark) <= BROADCAST_BYTES
    size = wins.agg(F.count("*").alias("n"), F.collect_set("k").alias("ks")).first()  # one row: ks has no more than ``shingle`` numbers
    ks = sorted(size.ks, reverse=True) or [shingle]
    rows = docs.select("doc_id", words().alias("words"))
    hashes = f"concat(array(bigint({MARK})), {', '.join(map(_shingles, ks))})"
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words"))
    same = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + F.lit(1), F.col("len")) == F.col("win")
    if small and size.n <= BROADCAST_WINDOWS:
        mark = docs.sparkSession.sql(f"SELECT bigint({MARK}) AS hash, CAST(NULL AS int) AS k, CAST(NULL AS int) AS off, CAST(NULL AS int) AS len, CAST(NULL AS array<string>) AS win, CAST(NULL AS array<string>) AS items")
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = rows.select("row", "doc_id", "words", F.posexplode(F.expr(hashes)).alias("pos", "hash"))
        rows = rows.join(F.broadcast(wins.unionByName(mark)), "hash").withColumn("start", _start(ks))
        rows = rows.filter(F.col("win").isNull() | (fits & same))
        found = _summed(rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "start", "len", "items"), ["row", "doc_id"])
    else:
        # Only hashes are shuffled; documents come back by key for the windows that joined.
        rows = rows.withColumn("key", F.xxhash64("doc_id", "words"))
        met = rows.select("key", "words", F.posexplode(F.expr(hashes)).alias("pos", "hash"))
        met = met.select("key", "pos", "hash", F.size("words").alias("n")).join(wins, "hash")
        met = met.join(rows.select("key", "words").dropDuplicates(["key"]), "key").withColumn("start", _start(ks)).filter(fits & same)
        got = _summed(met.select("key", F.size("words").cast("long").alias("n_words"), "start", "len", "items"), ["key"]).drop("n_words")
        found = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(got, "key", "left")
        found = found.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items, windows of 10 words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_W = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '" + UPPER + "', '" + UPPER.lower() + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s + 1, s + l), ' ') AS t FROM (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM bl)),
g AS (SELECT r, l, s, array_to_string(list_slice(w, s + 1, s + l), ' ') AS t
      FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
m AS (SELECT r, s, g.l, item_id FROM g JOIN win USING (l, t)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + l)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.t, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
