"""Benchmark decontamination by a join of winnowed k-gram fingerprints."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.carried import carry
from tessella.session import compact, materialise, small

WINDOW = 13
#: k-gram length and window of the fingerprints: a shared span of K + W - 1 = 13 words always shares a fingerprint.
K = 7
#: Bits of the filter that goes to all tasks, whatever the benchmark's size: what it lets through wrongly, the join drops.
FILTER_BITS = 1 << 25
BITMAP_BITS = 32_768  # of each of the bitmaps that Spark's bitmap_construct_agg makes
BATCH_ROWS = 400
_DELIMITERS = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(_DELIMITERS + bytes(range(65, 91)), b" " * len(_DELIMITERS) + bytes(range(97, 123)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, as UTF-8: ASCII other than letters and digits divides them."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k consecutive word ids, mixed so that the minimum is as good as random."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _BASE + ids[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the rightmost minimum of each w consecutive hashes."""
    if len(h) < w:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(len(views)) + (w - 1 - views[:, ::-1].argmin(axis=1)))


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def shape(size: int, window: int = WINDOW, k: int = K) -> tuple[int, int]:
    """Gram length and winnowing window for spans of so many words: every one holds a fingerprint. A short item is one gram."""
    return (k, size - k + 1) if size == window and size > k else (size, 1)


def prints_of(ids: np.ndarray, size: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's fingerprints for spans of `size` words, and the fingerprints."""
    k, w = shape(size, window)
    h = grams(ids, k)
    at = winnow(h, w)
    return at, h[at]


def window_digest(words: list[bytes]) -> bytes:
    """128 bits that stand for the words themselves."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (string), size, prints (array of long) and windows (array of digests) of each item with words; item is null where its id is."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b["item"].to_pylist(), b["text"]):
                words = words_of(text.as_py())
                if words:
                    size = min(window, len(words))
                    prints = np.unique(prints_of(word_ids(words), size, window)[1]).view(np.int64)
                    rows.append((item, size, prints, [window_digest(words[i : i + size]) for i in range(len(words) - size + 1)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary())))], ["item", "size", "prints", "windows"])

    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return materialise(compact(items.mapInArrow(mark, "item string, size int, prints array<long>, windows array<binary>")))


def print_filter(prints: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the fingerprints (h) modulo `bits`: at most bits / 8 bytes, whatever their number."""
    place = F.pmod("h", F.lit(bits)) + 1
    parts = prints.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * BITMAP_BITS // 8
        out[at : at + BITMAP_BITS // 8] = np.frombuffer(r["m"], np.uint8)[: len(out) - at]
    return out


def marked_documents(docs: DataFrame, keep: tuple[str, ...], sizes: list[int], known: np.ndarray, window: int = WINDOW) -> DataFrame:
    """_row, keep, n_words and prints of each row of docs: its fingerprints that pass the filter, each with the windows around it."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = pa.list_(pa.struct([("size", pa.int32()), ("h", pa.int64()), ("windows", pa.list_(pa.struct([("start", pa.int32()), ("digest", pa.binary())])))]))

    def found(words: list[bytes]) -> list[dict]:
        bitmap, out = shared.value, []
        ids = word_ids(words)
        for size in sizes:
            if len(words) < size:
                continue
            at, h = prints_of(ids, size, window)
            place = (h.view(np.int64) % (8 * len(bitmap))).astype(np.int64)
            hit = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            k = shape(size, window)[0]
            for p, x in zip(at[hit].tolist(), h.view(np.int64)[hit].tolist()):
                starts = range(max(0, p - size + k), min(p, len(words) - size) + 1)
                out.append({"size": size, "h": x, "windows": [{"start": s, "digest": window_digest(words[s : s + size])} for s in starts]})
        return out

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, prints = [], []
            for text in b["text"]:
                words = words_of(text.as_py())
                n_words.append(len(words))
                prints.append(found(words))
            kept = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(n_words, pa.int64()), pa.array(prints, kind)], [*kept, "n_words", "prints"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("n_words", "long").add("prints", T._parse_datatype_string("array<struct<size:int,h:bigint,windows:array<struct<start:int,digest:binary>>>>"))
    return materialise(rows.mapInArrow(mark, schema))


def match_windows(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW) -> DataFrame:
    """keep, n_words, n_hit and items (sorted strings) of each row of docs.

    Fingerprints of documents and benchmark are joined; the windows around shared ones are then met by digests of their
    words. Windows that the same items have are one entry of a set of items, so a passage of many items is listed once.
    Neither the texts nor the benchmark leave their places: only fingerprints that pass the filter, of fixed size, move.
    """
    own = benchmark_windows(benchmark, window)
    prints = materialise(compact(own.select("size", F.explode("prints").alias("h")).distinct()))
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # 1 to window
    marked = marked_documents(docs, keep, sizes, print_filter(prints), window)
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}
    if not sizes:
        return marked.select(*keep, "n_words", *[c.alias(n) for n, c in none.items()])
    entries = materialise(compact(own.select("size", "item", F.explode("windows").alias("digest")).distinct()))
    both = (F.count("*"), F.sum(F.xxhash64("item").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("item", F.lit(1))))  # equal for equal sets
    by_window = materialise(compact(entries.groupBy("size", "digest").agg(F.concat_ws(":", *both).alias("set_id"))))
    one = by_window.groupBy("set_id").agg(F.min(F.struct("size", "digest")).alias("w")).select("set_id", "w.size", "w.digest")
    sets = entries.join(one, ["size", "digest"]).select("set_id", "item")
    shared = marked.select("_row", F.explode("prints").alias("p")).select("_row", "p.size", "p.h", "p.windows").join(small(prints), ["size", "h"])
    tried = shared.select("_row", "size", F.explode("windows").alias("w")).select("_row", "size", F.col("w.start").alias("start"), F.col("w.digest").alias("digest")).distinct()
    met = materialise(compact(tried.join(small(by_window.select("size", "digest", "set_id")), ["size", "digest"]).select("_row", "size", "start", "set_id")))
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    covered = lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reached")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reached"]))).alias("n"), F.greatest(a["reached"], x["end"]).alias("reached")))["n"]
    hits = met.groupBy("_row").agg(covered(spans).cast("long").alias("n_hit"))
    items = met.select("_row", "set_id").distinct().join(small(materialise(compact(sets))), "set_id").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = small(materialise(compact(hits.join(items, "_row"))))
    return marked.drop("prints").join(found, "_row", "left").select(*keep, "n_words", *[F.coalesce(n, c).alias(n) for n, c in none.items()])


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: keep, n_words, n_hit, n_items, items (sorted as strings) and contaminated: n_hit > 0 and share * n_hit >= n_words.

    A null or empty text has no words and is clean; so is any document when the benchmark is empty. Items without words
    match nothing; the words of one without id are hit, but it isn't among the items. Ids may be of any type that has a text. Rows that repeat are judged one by one; other columns of
    docs are not read.
    """
    judged = match_windows(docs, benchmark, keep, window)
    return judged.select(*keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items").withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, as they are. Rows are met by doc_id and a digest of their text."""
    return carry(docs, ("doc_id", "text"), lambda own: _decontaminate(own, benchmark, window, share))


def _decontaminate(docs: DataFrame, benchmark: DataFrame, window: int, share: int) -> DataFrame:
    key = {"_bench_id": F.col("doc_id").cast("string"), "_bench_digest": F.xxhash64("doc_id", "text")}
    keyed = docs.withColumns(key)
    gone = contamination(keyed.select(*key, "text"), benchmark, window, share, tuple(key)).where("contaminated").select(F.col("_bench_id").alias("_gone_id"), F.col("_bench_digest").alias("_gone_digest")).distinct()
    gone = small(materialise(compact(gone)))
    return keyed.join(gone, (F.col("_bench_digest") == F.col("_gone_digest")) & F.col("_bench_id").eqNullSafe(F.col("_gone_id")), "left_anti").select(*docs.columns)
