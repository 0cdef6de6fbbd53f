"""SimHash near-dedup by covering locality-sensitive hashing: of fingerprints within two bits, and of shingle sets by several sketches with exact Jaccard behind them."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.carried import carry
from tessella.llm.components import components
from tessella.llm.decontamination import grams
from tessella.session import compact, materialise, scratch, small

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
BATCH_ROWS = 400
CHUNK = 1 << 16
#: Words a shingle and least Jaccard similarity of near copies where no contract asks for fingerprints within 2 bits.
COPY_SHINGLE = 5
SIMILARITY = 0.8
#: Share of the pairs of just that similarity that may share no masked sketch, and the sketches that there are at least.
MISSED, LEAST_SKETCHES = 0.02, 20
#: Sketches that go along where sets meet: all of their bits bound the similarity, about ten a set of bits that a link may differ in.
WIDE = 20
#: Low bits of a bucket that are its table, so many buckets as rows that a set meets few others by chance: 2 ** SPARSE.
TABLE_BITS, SPARSE = 12, 6
#: Multipliers with which a hash is mixed, one a sketch.
MIXED = np.array([1, *[xxhash.xxh64_intdigest(str(i), SEED) | 1 for i in range(1, 400)]], np.uint64)
#: Pairs compared at once, and sizes of sets for which the bits that may differ are worked out one by one.
PAIRS, SMALL_SETS = 1 << 17, 128
#: Partners of a set in a bucket in the first round, and how many times as many each later one has.
FIRST_MOST, MORE = 1, 32
#: Members of a bucket that are met in one group; a larger bucket is dealt to blocks, and pairs of blocks to groups.
BUCKET_ROWS = 1024
#: Least bits of the bitmap that bounds the overlap of two sets.
SKETCH = 1024
#: Bytes of each hash of a set that is compared: 48 bits.
PACKED = 6
#: Words whose hashes a Python worker holds, and texts named by one long that are broadcast at most.
HELD_WORDS, NAMED_TEXTS = 200_000, 1_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each of the text's word shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is in over half of the XXH64 of the text's word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a long) of each row."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t.as_py(), shingle) for t in b["text"]], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mark, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks: any `radius` bits are outside of one of them.

    Bit i has the vector 1 + i mod (2 ** (radius + 1) - 1) over GF(2); mask v holds the bits whose vector has an odd scalar
    product with v. `radius` vectors leave a v orthogonal to all of them.
    """
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame) -> DataFrame:
    """Links (fp, least) between distinct fingerprints, as many as keep everything within 2 bits connected.

    Each fingerprint goes into a table a mask. In a bucket two fingerprints are within 2 bits if and only if they share a
    neighbour at one bit or less, at the bits that the mask leaves out; all fingerprints at such a neighbour (65 at most) are
    within 2 bits of each other, so each is linked with the least of them. No bucket's pairs are listed, and no bucket is capped.
    """
    masks = covering_masks(2)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]))
    placed = prints.select("fp", tables.alias("b")).select("fp", "b.t", "b.key")
    met = placed.groupBy("t", "key").count().where("count > 1").drop("count")
    flips = F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in (0, *(1 << i for i in range(BITS) if not m >> i & 1))]) for m in masks])
    around = placed.join(met, ["t", "key"]).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("neighbour")).distinct()
    least = around.groupBy("neighbour").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return around.join(least, "neighbour").where("fp > least").select("fp", "least").distinct()


class Shingles:
    """Sets of word shingles as sorted hashes: 64 bits from the XXH64 of the words, which are hashed once each."""

    def __init__(self, shingle: int):
        self.shingle, self.words = shingle, {}

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.int64)
        if len(self.words) > HELD_WORDS:
            self.words.clear()
        for w in set(words):
            if w not in self.words:
                self.words[w] = xxhash.xxh64_intdigest(w, SEED)
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        return np.unique(grams(ids, min(self.shingle, len(words))).view(np.int64))


def apart(similarity: float) -> float:
    """The share of SimHash bits in which two sets of that Jaccard similarity differ at most, on average: their cosine is 2s / (1 + s) or more."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def group_bits(rows: int) -> int:
    """Bits of a sketch that masks are laid over: a mask keeps four of seven, so a table has 2 ** SPARSE times as many keys as rows, at any size."""
    return min(63, max(21, math.ceil((math.log2(max(rows, 1)) + SPARSE) * 7 / 4)))


def n_sketches(bits: int, similarity: float) -> int:
    """Sketches that are needed so that at most MISSED of the pairs of just that similarity share no masked sketch.

    Bit i is in group i mod 7 and each mask keeps four groups; a pair shares a key if the groups without a differing bit hold those of some mask.
    """
    masks, equal = covering_masks(2, 7), [(1 - apart(similarity)) ** len(range(g, bits, 7)) for g in range(7)]
    found = sum(math.prod(equal[g] if same >> g & 1 else 1 - equal[g] for g in range(7)) for same in range(128) if any(m & same == m for m in masks))
    return max(LEAST_SKETCHES, WIDE, math.ceil(math.log(MISSED) / math.log(1 - found)))


def set_prints(own: np.ndarray, n: int) -> np.ndarray:
    """n SimHashes of 64 bits of a set of hashes: each of the hashes mixed anew. Bits are counted eight at a time, in bytes."""
    x = own.view(np.uint64)[:, None] * MIXED[:n]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    counts = np.zeros((n, 8, 8), np.int64)
    starts = np.arange(0, len(own), 255)
    for k in range(8 if len(own) else 0):
        sums = np.add.reduceat((x >> np.uint64(k)) & np.uint64(0x0101010101010101), starts, axis=0)
        counts[:, :, k] = sums.view(np.uint8).reshape(len(starts), n, 8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts.reshape(n, 64) > len(own), axis=1, bitorder="little").view(np.int64).ravel()


def placed(docs: DataFrame, *columns: str) -> DataFrame:
    """text, with text_id and at, by which rows of it are found again, and columns."""
    return docs.select("text", F.xxhash64("text").alias("text_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("at"), *columns)


def shingle_prints(docs: DataFrame, shingle: int, sketches: int) -> DataFrame:
    """doc_id, text_id, at, set_id (equal for equal sets; 0 for the empty one), n, that many sketches and bitmap (wide_sketch) of each row; the sets themselves aren't kept."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(shingle)
        for b in batches:
            ids, sizes, prints, maps = [], [], [], []
            for t in b["text"]:
                own = sets.of(t.as_py())
                ids.append(signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)) if len(own) else 0)
                sizes.append(len(own))
                prints.append(set_prints(own, sketches))
                maps.append(wide_sketch(own))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_id"], b["at"], pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["doc_id", "text_id", "at", "set_id", "n", "sketches", "bitmap"])

    rows = placed(docs, F.col("doc_id").cast("long"))
    return rows.mapInArrow(mark, "doc_id long, text_id long, at long, set_id long, n int, sketches array<long>, bitmap binary")


def met_members(sets: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Sets that share a masked sketch with another that they may be similar to, as near_members gives them for the first round.

    Each sketch goes into a table a covering mask, so a pair that differs in two of its bits at most meets for certain. Only ids
    are dealt to buckets; sizes and sketches follow those that meet another set. A large bucket's blocks meet in the second round.
    """
    masks = covering_masks(2, bits)
    full = sets.where("n > 0")
    keys = [F.xxhash64(F.lit(t), "s", F.col("x").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(-1 << TABLE_BITS)).bitwiseOR(F.col("s").cast("long") * len(masks) + t) for t, m in enumerate(masks)]
    dealt = full.select("set_id", F.posexplode("sketches").alias("s", "x")).select("set_id", F.explode(F.array(*keys)).alias("bucket"))
    met = dealt.withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")
    met = met.select("bucket", "set_id", F.ceil(F.col("size") / BUCKET_ROWS).cast("int").alias("blocks"))
    met = materialise(met.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")))
    known = full.select("set_id", "n", F.slice("sketches", 1, WIDE).alias("wide"), "bitmap")
    members = met.join(known, "set_id").withColumns({"root": F.col("set_id"), "home": F.lit(True), "before": F.lit(None).cast("array<long>")})
    return near_members(members, bits, similarity, FIRST_MOST)


def meet_blocks(members: DataFrame) -> DataFrame:
    """members, of whose large buckets the sets outside of the largest root visit all blocks: those of the largest are linked already."""
    large = members.where("blocks > 1")
    counts = large.groupBy("bucket", "root").agg(F.countDistinct("set_id").alias("c"))
    largest = counts.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("_largest"))
    guests = large.join(largest, "bucket").where("root <> _largest").drop("_largest").withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests = guests.where("_to <> block").withColumns({"block": F.col("_to"), "home": F.lit(False)}).drop("_to")
    return members.unionByName(guests).withColumn("blocks", F.lit(1))


def differ(n: int, m: int, similarity: float) -> float:
    """The chance that a SimHash bit differs between sets of n and m elements of just that similarity, by the ones among common and own elements."""
    both = min(n, m, math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
    ones = lambda k: np.array([math.comb(k, i) / 2**k for i in range(k + 1)])
    least = lambda own, of: np.append(np.cumsum(ones(own)[::-1])[::-1], 0)[np.clip(of // 2 + 1 - np.arange(both + 1), 0, own + 1)]  # noqa: E731  chance of a majority, by common ones
    x, y = least(n - both, n), least(m - both, m)
    return float((ones(both) * (x * (1 - y) + y * (1 - x))).sum())


@functools.cache
def most_bits(similarity: float) -> np.ndarray:
    """Of the bits of WIDE sketches, those in which sets of that similarity may differ: 4.5 deviations over the mean, by the smaller size (last: SMALL_SETS and more)."""
    sizes = [range(n, math.floor(n / similarity + 1e-6) + 1) for n in range(1, SMALL_SETS)]
    p = np.array([0, *(max(apart(similarity), *(differ(ms[0], m, similarity) for m in ms)) for ms in sizes)])
    p = np.append(p, p[SMALL_SETS // 2 :].max())
    return np.ceil(BITS * WIDE * p + 4.5 * np.sqrt(BITS * WIDE * p * (1 - p))).astype(np.int64)


def near_members(members: DataFrame, bits: int, similarity: float, most: int) -> DataFrame:
    """Of the sets in each block of a bucket those that may be similar to another one there that is still apart, with whom to link them.

    members: bucket, block, blocks, home, set_id, n, wide (its first WIDE sketches), bitmap, root, and in before the partners it was linked with already.
    A pair counts if sizes, bits and bitmaps allow the similarity, the roots differ, and no earlier table of these sketches has both,
    so that it counts in one bucket only. The set of the smaller root proposes: in least its likeliest partner, in more the next
    ones, `most` in all; later rounds see what is then still apart. Sets without a pair go, but for buckets whose blocks are still to meet.
    """
    grouped = members.groupBy("bucket", "block").agg(F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("n", "set_id", "root", "home", "before", "wide", "bitmap"))).alias("m"))
    masks, limits = covering_masks(2, bits), most_bits(similarity)

    def pairs_of(n, root, home, wide, maps, owner, table, seen, ids):
        ends = np.searchsorted((owner << 32) + n, (owner << 32) + np.floor(n / similarity + 1e-6).astype(np.int64), "right")
        counts = ends - np.arange(len(n)) - 1
        total = np.cumsum(counts)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, total[at] - counts[at] + PAIRS, "right")))
            c = counts[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            at = to
            open_ = np.flatnonzero((root[i] != root[j]) & (home[i] | home[j]))
            i, j = i[open_], j[open_]
            far = np.zeros(len(i), np.int64)
            for q in range(WIDE):
                far += np.bitwise_count((wide[i, q] ^ wide[j, q]).view(np.uint64))  # of a negative number it would count the absolute value's
            likely = np.flatnonzero(far <= limits[np.minimum(n[i], SMALL_SETS)])
            i, j, far = i[likely], j[likely], far[likely]
            new = np.ones(len(i), bool)
            for q in range(WIDE):
                x = wide[i, q] ^ wide[j, q]
                for t, mask in enumerate(masks):
                    new &= (x & mask != 0) | (table[i] <= q * len(masks) + t)
            i, j, far = i[new], j[new], far[new]
            if seen:
                new = np.array([(a, y) not in seen and (b, x) not in seen for a, b, x, y in zip(i.tolist(), j.tolist(), ids[i].tolist(), ids[j].tolist())], bool)
                i, j, far = i[new], j[new], far[new]
            held = {k: maps[k].as_py() for k in np.union1d(i, j).tolist()}
            new = np.array([enough(most_overlap(held[a], held[b], x, y), x, y, similarity) for a, b, x, y in zip(i.tolist(), j.tolist(), n[i].tolist(), n[j].tolist())], bool)
            yield i[new], j[new], far[new]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch["m"].flatten()
            if not len(m):
                continue
            sizes = batch["m"].value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            n, ids, root = (m.field(c).to_numpy().astype(np.int64) for c in ("n", "set_id", "root"))
            home, wide, before = m.field("home").to_numpy(zero_copy_only=False), m.field("wide").flatten().to_numpy().reshape(-1, WIDE), m.field("before")
            seen = set(zip(np.repeat(np.arange(len(n)), before.value_lengths().fill_null(0).to_numpy()).tolist(), before.flatten().to_pylist()))
            table = (batch["bucket"].to_numpy() & ((1 << TABLE_BITS) - 1))[owner]
            i, j, far = (np.concatenate(x) for x in zip(*pairs_of(n, root, home, wide, m.field("bitmap"), owner, table, seen, ids)))
            _, group, members_of = np.unique(np.stack((owner, root)), axis=1, return_inverse=True, return_counts=True)
            of = members_of[group.ravel()]
            swap = (of[i] > of[j]) | (of[i] == of[j]) & (ids[i] < ids[j])
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((ids[y], far, x))
            links: dict[int, list[int]] = {}
            for a, b in zip(x[order].tolist(), ids[y[order]].tolist()):
                if len(own := links.setdefault(a, [])) < most:
                    own.append(b)
            kept = np.zeros(len(n), bool)
            kept[i] = kept[j] = True
            kept = np.flatnonzero(kept | (batch["blocks"].to_numpy() > 1)[owner])
            own = [links.get(k) for k in kept.tolist()]
            rows = m.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(pa.array(owner[kept])) for c in ("bucket", "block", "blocks")), *(rows.field(c) for c in ("set_id", "n", "home", "before", "wide", "bitmap")), pa.array([x and x[0] for x in own], pa.int64()), pa.array([x and x[1:] for x in own], pa.list_(pa.int64()))],
                ["bucket", "block", "blocks", "set_id", "n", "home", "before", "wide", "bitmap", "least", "more"],
            )

    return grouped.mapInArrow(propose, "bucket long, block int, blocks int, set_id long, n int, home boolean, before array<long>, wide array<long>, bitmap binary, least long, more array<long>")


def wide_sketch(own: np.ndarray) -> bytes:
    """A bitmap of two to four bits an element, a power of two in length, so that the bound holds for long texts too."""
    bits = np.zeros(max(SKETCH, 1 << (2 * len(own)).bit_length()), np.uint8)
    bits[own.view(np.uint64) % np.uint64(len(bits))] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(a: bytes, b: bytes, n: int, m: int) -> int:
    """What two sets of n and m elements have in common at most, by their wide sketches; the longer one is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return min((n + m - int(np.bitwise_count(x ^ y).sum())) // 2, n, m)


def enough(both: int, n: int, m: int, similarity: float) -> bool:
    """Whether sets of n and m elements with that many in common have the Jaccard similarity."""
    return both * (1 + similarity) >= similarity * (n + m) - 1e-9


def judge(pairs: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b and same (whether the Jaccard similarity is reached) of each pair; rows: set_id, text_id and at of a row of docs.

    Only sets of these pairs are made, from their texts where they lie, and meet as sorted hashes. They go when the pairs are judged.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = materialise(compact(rows.join(ids, "set_id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(shingle)
        for b in batches:
            every = [sets.of(t.as_py()) for t in b["text"]]
            packed = [np.unique(own.view(np.uint64) >> np.uint64(64 - 8 * PACKED)).view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes() for own in every]
            yield pa.RecordBatch.from_arrays([b["set_id"], pa.array(packed, pa.binary())], ["set_id", "packed"])

    def unpacked(b: bytes) -> np.ndarray:
        x = np.zeros((len(b) // PACKED, 8), np.uint8)
        x[:, :PACKED] = np.frombuffer(b, np.uint8).reshape(-1, PACKED)
        return x.view(np.uint64).ravel()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for p, q in zip(batch["packed_a"], batch["packed_b"]):
                x, y = unpacked(p.as_py()), unpacked(q.as_py())
                same.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(same, pa.bool_())], ["a", "b", "same"])

    sets = placed(docs).join(small(wanted, NAMED_TEXTS), ["text_id", "at"]).select("set_id", "text").mapInArrow(pack, "set_id long, packed binary")

    with scratch(sets) as known:
        if known.count() > wanted.count():  # repeated rows
            known = known.dropDuplicates(["set_id"])
        for c in ("a", "b"):
            pairs = pairs.join(known.select(F.col("set_id").alias(c), F.col("packed").alias(f"packed_{c}")), c)
        return materialise(compact(pairs.mapInArrow(compare, "a long, b long, same boolean")))


def similar_roots(docs: DataFrame, members: DataFrame, rows: DataFrame, bits: int, similarity: float, shingle: int) -> DataFrame:
    """(node, root) of the sets that others are similar to: components of the pairs that meet and have that Jaccard similarity.

    Each round judges the links that members propose; the next one has those that may be similar to a set from which they are still
    apart and weren't judged with. The last one has none.
    """
    same = docs.sparkSession.createDataFrame([], "a long, b long")
    roots, most = docs.sparkSession.createDataFrame([], "node long, root long"), FIRST_MOST
    while not members.isEmpty():
        linked = F.concat(F.array("least"), "more")
        pairs = members.where("least is not null").select("set_id", F.explode(linked).alias("b"))
        pairs = materialise(compact(pairs.select(F.greatest("set_id", "b").alias("a"), F.least("set_id", "b").alias("b")).distinct()))
        if not pairs.isEmpty():
            same = same.unionByName(judge(pairs, docs, rows, similarity, shingle).where("same").select("a", "b"))
            roots = components(same)
        most *= MORE
        members = members.withColumn("before", F.when(F.col("least").isNull(), F.col("before")).otherwise(F.concat(F.coalesce("before", F.array().cast("array<long>")), linked))).drop("least", "more")
        members = members.join(small(roots, NAMED_TEXTS), F.col("set_id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "set_id"))
        members = materialise(compact(near_members(meet_blocks(members), bits, similarity, most)))
    return roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of each row: the smallest doc_id that links of fingerprints at 2 bits or fewer reach.

    Rows with equal fingerprints, whatever their number, are one node from the start. Null and empty texts have fingerprint
    0 and are one node; rows with a null doc_id are linked too but give no component_id (null if a component has no other);
    repeated rows give a row each; no rows give none. Other columns are not read.
    """
    marked = materialise(fingerprints(docs, shingle))
    return named(marked, "fp", lambda nodes: components(near_links(nodes), "fp", "least")).select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of each row: the smallest doc_id that links reach, of pairs whose sets of word shingles have that Jaccard similarity.

    By covering LSH over several SimHashes of the sets: what shares a masked sketch meets, and every link is verified on the sets.
    All pairs that meet are judged or already linked; of pairs of just that similarity MISSED are expected not to meet, of closer ones
    far fewer. Rows of equal sets are one node from the start; texts without words are one node. Null doc_ids, repeated and no rows
    as in near_duplicates.
    """
    bits = group_bits(docs.count())
    with scratch(shingle_prints(docs, shingle, n_sketches(bits, similarity))) as printed:
        first = F.min_by(F.struct("n", "sketches", "bitmap", "at", "text_id"), F.struct("at", "text_id")).alias("r")
        sets = materialise(printed.groupBy("set_id").agg(first).select("set_id", "r.*"))
        marked = materialise(compact(printed.select("doc_id", "set_id")))
    met, rows = materialise(met_members(sets, bits, similarity)), sets.select("set_id", "text_id", "at")
    return named(marked, "set_id", lambda _: similar_roots(docs, met, rows, bits, similarity, shingle)).select("doc_id", "component_id")


def named(marked: DataFrame, node: str, roots_of) -> DataFrame:
    """marked with the component_id of its nodes; roots_of gives (node, root) of those that are linked."""
    nodes = marked.groupBy(node).agg(F.min("doc_id").alias("first_id"))
    roots = roots_of(nodes).withColumnRenamed("node", node)
    nodes = materialise(compact(nodes.join(roots, node, "left").withColumn("root", F.coalesce("root", node))))
    first = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(nodes.join(first, "root").select(node, "component_id"), node)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of the smallest doc_id; a row without doc_id stays if nothing else is like it.

    If that doc_id has several rows, one of them stays.
    """
    return carry(docs, ("doc_id", "text"), _drop_near_duplicates)


def _drop_near_duplicates(docs: DataFrame) -> DataFrame:
    judged = materialise(compact(similar_documents(docs)))
    gone = judged.where("doc_id is not null and doc_id <> component_id or doc_id is null and component_id is not null")
    dropped = small(materialise(compact(gone.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none")).distinct())))
    kept = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_none": F.col("doc_id").isNull()}).join(dropped, ["_id", "_none"], "left_anti").drop("_id", "_none")
    again = materialise(compact(judged.where("not doc_id <=> null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again"))))
    if again.isEmpty():
        return kept
    marked = kept.join(small(again), kept["doc_id"] == F.col("_again"), "left")
    return marked.where("_again is null").unionByName(marked.where("_again is not null").dropDuplicates(["doc_id"])).drop("_again")
