"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tessella.llm.components import components
from tessella.session import compact, materialise, small

COSINE = 0.93
#: The cosine that two pivots have at most.
PIVOT_COSINE = 0.5
#: Pivots: twice the root of the number of vectors, within these bounds (the larger one bounds what is broadcast), and the
#: vectors of the sample that each is chosen from.
MIN_PIVOTS, MAX_PIVOTS, CHOICE = 64, 16_384, 4
#: Nearest pivots that describe a vector; a pair must share two of them.
PREFIX = 5
#: Vectors in a block of a list; rows that a task group holds.
BLOCK = 1024
GROUP_ROWS = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    """The rows in double precision and of length 1; they are scaled first, so none is too long or too short for it."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def choose_pivots(classes: DataFrame, n: int, sample: int) -> np.ndarray:
    """Up to n unit vectors of a hash sample of bounded size, of which no two are closer than PIVOT_COSINE."""
    rows = classes.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow()
    if not rows.num_rows:
        return np.empty((0, 0))
    dims = {len(v) for v in rows["v"]}
    size = max(dims, key=lambda d: (sum(len(v) == d for v in rows["v"]), d)) if len(dims) > 1 else dims.pop()
    x = unit(np.array([v.as_py() for v in rows["v"] if len(v) == size]))
    free, chosen = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            chosen.append(i)
            free &= x @ x[i] <= PIVOT_COSINE
        if len(chosen) == n:
            break
    return x[chosen]


def linked_pairs(x: np.ndarray, tops: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs between the rows left and right that belong to this list: that of the first two pivots that they share."""
    found = []
    same = left is right
    for i in range(0, len(left), 256):
        a, b = np.nonzero(x[left[i : i + 256]] @ x[right].T >= cosine)
        a, b = left[i + a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        if tops.shape[1] < 2:
            found.append((a, b))
            continue
        for j in range(0, len(a), 1 << 16):
            p, q = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            both = (tops[p][:, :, None] == tops[q][:, None, :]).any(axis=2)
            first = np.sort(np.where(both, tops[p], np.iinfo(np.int32).max), axis=1)[:, :2]
            ok = (first == key).all(axis=1)
            found.append((p[ok], q[ok]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def match_lists(table: pa.Table, cosine: float = COSINE) -> pa.Table:
    """For each class with links in the lists of this group: cid, links (vectors linked with) and root, the least class linked within its list block."""
    order = np.lexsort([table[c].to_numpy(zero_copy_only=False) if c != "lab" else table[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("j", "i", "q", "p", "lab")])
    table = table.take(pa.array(order))
    keys = np.stack([table["lab"].combine_chunks().dictionary_encode().indices.to_numpy(), *(table[c].to_numpy() for c in ("p", "q", "i", "j"))], 1).astype(np.int64)
    x, tops = unit(matrix(table["v"])), matrix(table["tops"]).astype(np.int32)
    cid, sizes, block = (table[c].to_numpy() for c in ("cid", "size", "block"))
    bounds = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
    out = []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo < 2:
            continue
        _, p, q, i, j = keys[lo].tolist()
        own = np.arange(lo, hi)
        left, right = (own, own) if i == j else (own[block[lo:hi] == i], own[block[lo:hi] == j])
        a, b = linked_pairs(x, tops, np.array([p, q]), left, right, cosine)
        if not len(a):
            continue
        links = np.zeros(hi - lo, np.int64)
        np.add.at(links, a - lo, sizes[b])
        np.add.at(links, b - lo, sizes[a])
        root = cid[lo:hi].copy()
        while True:
            least = np.minimum(root[a - lo], root[b - lo])
            new = root.copy()
            np.minimum.at(new, a - lo, least)
            np.minimum.at(new, b - lo, least)
            if (new == root).all():
                break
            root = new
        has = links > 0
        out.append((cid[lo:hi][has], links[has], root[has]))
    columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
    return pa.table({"cid": pa.array(columns[0], pa.int64()), "links": pa.array(columns[1], pa.int64()), "root": pa.array(columns[2], pa.int64())})


def described(classes: DataFrame, prefix: int = PREFIX) -> DataFrame | None:
    """classes with tops: the numbers of the nearest pivots, ascending; minus its length for a vector of another length than theirs. None without vectors."""
    n = classes.count()
    most = min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * math.isqrt(n)))
    pivots = choose_pivots(classes, most, CHOICE * most)
    if not len(pivots):
        return None
    near = classes.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches):
        p = near.value
        for b in batches:
            fits = np.array([len(v) == p.shape[1] for v in b["v"]], bool)
            tops = [[-len(v)] for v in b["v"]]
            if fits.any():
                sims = unit(matrix(b["v"].filter(pa.array(fits)))) @ p.T
                for k, own in zip(np.flatnonzero(fits).tolist(), np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :prefix], axis=1).tolist()):
                    tops[k] = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops, pa.list_(pa.int32()))], [*b.schema.names, "tops"])

    return materialise(classes.mapInArrow(describe, T.StructType([*classes.schema.fields]).add("tops", T.ArrayType(T.IntegerType()))))


def inverted_lists(vectors: DataFrame) -> DataFrame:
    """cid, lab, p, q: a row for each two pivots that describe a class, p < q. Two classes share a list if and only if they share two pivots.

    So shared pivots are counted on ids, before any vector moves.
    """
    pairs = F.when(F.size("tops") < 2, F.array(F.struct(F.col("tops")[0].alias("p"), F.col("tops")[0].alias("q")))).otherwise(
        F.flatten(F.transform("tops", lambda p: F.transform(F.filter("tops", lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    )
    return vectors.select("cid", "lab", F.explode(pairs).alias("k")).select("cid", "lab", "k.p", "k.q")


def links_by_pivots(classes: DataFrame, cosine: float = COSINE, prefix: int = PREFIX) -> DataFrame:
    """(cid, links, root) from the lists of all pairs of pivots; classes: cid, lab, v, size.

    A pair is a candidate if two of its vectors' `prefix` nearest pivots are the same; it is verified in the list of the
    first two of these. Lists are cut into blocks, and pairs of blocks go to groups of a bounded number of rows, so a list of
    any length is spread over tasks; within a task blocks are multiplied and no pair leaves it.
    """
    none = classes.sparkSession.createDataFrame([], "cid long, links long, root long")
    vectors = described(classes, prefix)
    if vectors is None:
        return none
    postings = inverted_lists(vectors)
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    lists = materialise(compact(postings.groupBy("lab", "p", "q").count().withColumnRenamed("count", "n").where("n > 1").withColumn("blocks", blocks)))
    total = lists.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    if not total:
        return none
    placed = postings.join(small(lists.drop("n")), ["lab", "p", "q"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    with_block = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = with_block.select("cid", "p", "q", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block").join(vectors, "cid")
    group = F.pmod(F.xxhash64("lab", "p", "q", "i", "j", F.size("tops"), F.size("v")), F.lit(max(1, math.ceil(total / GROUP_ROWS))))

    def match(t: pa.Table) -> pa.Table:
        dims = sorted({(len(v), len(p)) for v, p in zip(t["v"], t["tops"])}) if t.num_rows else []
        if len(dims) == 1:
            return match_lists(t, cosine)
        parts = []
        for d, k in dims:
            own = t.filter(pa.array([len(v) == d and len(p) == k for v, p in zip(t["v"], t["tops"])]))
            parts.append(match_lists(own, cosine))
        return pa.concat_tables(parts)

    return keyed.withColumn("g", group).groupBy("g").applyInArrow(match, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Only vectors of one label are compared, by cosine in double precision. A null label, vec_id or vector, a zero vector, and
    one that holds a null or a non-finite component link with nothing. Equal vectors of a label are one class from the start,
    whatever their number; repeated rows count as vectors of their own. Vectors of other lengths than most are compared with
    those of their own length. Labels may be of any type that has a text. Other columns are not read.
    """
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v"), F.col("label").cast("string").alias("lab"), fine.alias("fine"))
    classes = rows.where("fine").groupBy("lab", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = materialise(compact(links_by_pivots(classes.select("cid", "lab", "v", "size"), cosine, prefix)))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select("cid", "root"), "cid", "root").withColumnRenamed("node", "cid")
    named = materialise(compact(classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).select("lab", "v", "first_id", "size", "root", F.coalesce("links", F.lit(0)).alias("links"))))
    firsts = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(firsts, "root").select("lab", F.xxhash64("v").alias("h"), "v", (F.col("size") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = rows.where("fine").withColumn("h", F.xxhash64("v")).join(named, ["lab", "h", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
