"""How sources of a language differ in their words: exact divergences of all pairs of sources, and the terms that mark each source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import compact, materialise, small

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Bits of a value that a round of the selection settles, and rounds that cover every value: a value is below 2 ** 30.
DIGIT_BITS, DIGITS = 10, 3
#: Terms of equal value that may be left to sort in one task; more are told apart by their bytes first.
TIES = 1_000
#: Terms that a task counts before it hands them on.
HELD = 250_000
#: Sources a side of a tile, buckets of terms a tile, and pairs of entries worked out at once.
SIDE, BUCKETS, PAIRS = 256, 256, 1_000_000

# Bytes of a text to lower-case letters and bytes of non-ASCII characters; all others become blanks.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term, summed in each task as far as memory is bounded, so repeated keys."""
    names = ["lang", "source", "term", "n", "docs"]
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[dict, dict]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                columns = ([lang] * len(n), [source] * len(n), list(n), list(n.values()), [docs[t] for t in n])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            groups.clear()

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
                n, docs = groups.setdefault((lang, source), ({}, {}))
                before, seen, words = len(n), {}, text.as_py().translate(_LETTERS).split()
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
                for w, times in seen.items():
                    n[w] = n.get(w, 0) + times
                    docs[w] = docs.get(w, 0) + 1
                held += len(n) - before
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def div(a: Column, b: Column) -> Column:
    """Whole-number division, null if b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) by long division in three steps of a thousand, exact for counts below 9 * 10 ** 15; 1 if total is 0."""
    out, rest = F.lit(1).cast("long"), count.cast("long")
    for power in (1_000_000, 1_000, 1):
        out = out + F.coalesce(div(rest * 1000, total), F.lit(0)) * power
        rest = (rest * 1000) % F.nullif(total, F.lit(0))
    return out


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)), below 2 ** 30 as p and q are at most UNIT + 1."""
    return div((p - q) * (p - q), p + q)


def radix_top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of each group with the largest value, equal ones by the bytes of item, with their rank from 1.

    rows: materialised, with whole values from 0 to 2 ** 30 - 1 and binary items, distinct in a group. Digit by digit, counts
    of the values' leading bits say in which range each group's kth value lies, until it is known; ties at it are told apart
    by the byte behind their common prefix, as long as over TIES of them are left. No group, however large, is sorted: what
    is ranked in the end is at most k rows and TIES ties.
    """
    state = None
    for digit in reversed(range(DIGITS)):
        of = F.shiftright("value", digit * DIGIT_BITS)
        live = rows.withColumn("_left", F.lit(k).cast("long")) if state is None else rows.join(small(state), by).where(F.shiftright(of, DIGIT_BITS) == F.col("_at"))
        counts = live.groupBy(*by, "_left", of.alias("_at")).agg(F.count("*").alias("_n"))
        state = materialise(compact(crossing(counts, by, F.desc("_at"))))
    ties = rows.join(small(state), by).where(F.col("value") == F.col("_at"))
    state = materialise(state.withColumn("_stem", F.lit(b"")))
    while not state.where((F.col("_n") > TIES) & (F.col("_n") > F.col("_left"))).isEmpty():
        own = F.substring("item", F.lit(1), F.length("_stem")) == F.col("_stem")
        live = ties.drop("_at", "_left", "_n").join(small(state), by).where(own)
        ends = live.groupBy(*by).agg(F.min("item").alias("_a"), F.max("item").alias("_b"))
        settled = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_a"), F.length("_b")))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (F.substring("_a", i, F.lit(1)) == F.substring("_b", i, F.lit(1))), i).otherwise(n),
        )
        stems = small(materialise(compact(ends.select(*by, (settled + 1).alias("_length")))))
        counts = live.join(stems, by).groupBy(*by, "_left", "_at", F.substring("item", F.lit(1), F.col("_length")).alias("_stem")).agg(F.count("*").alias("_n"))
        state = materialise(compact(crossing(counts, by, F.asc("_stem"))))
    kept = F.col("_at").isNull() | (F.col("value") > F.col("_at"))
    tie = (F.col("value") == F.col("_at")) & ((F.col("item") < F.col("_stem")) | (F.substring("item", F.lit(1), F.length("_stem")) == F.col("_stem")))
    ranked = rows.join(small(state), by, "left").where(kept | tie).select(*rows.columns)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)


def crossing(counts: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The bin of each group in which the number of rows reaches _left, with what is left to take of it; groups that have fewer rows drop out."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", before).where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_n")))
    return reached.withColumn("_left", F.col("_left") - F.col("_before")).drop("_before")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tile:
    """Divergences of the sources of one block with those of another, or of a block with itself, as far as a task's rows say."""

    def __init__(self, lang: str, a: int, b: int, rows: pa.RecordBatch):
        self.lang, self.same, self.whole = lang, a == b, False
        side = rows["side"].to_numpy()
        self.names, self.p0 = [], []
        for s in (0, 0) if self.same else (0, 1):
            at = np.flatnonzero(side == s)
            at = at[np.argsort(rows["idx"].to_numpy()[at])]
            self.names.append(rows["source"].take(pa.array(at)).to_pylist())
            self.p0.append(rows["p"].to_numpy()[at])
        self.sums = np.zeros((len(self.p0[0]), len(self.p0[1])), np.int64)

    def baseline(self, terms: int) -> None:
        """Every term as if no source had it."""
        if not self.whole:
            self.sums += terms * gaps(self.p0[0][:, None], self.p0[1][None])
            self.whole = True

    def alone(self, side: np.ndarray, idx: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Terms that a source has, against sources that are as if they hadn't."""
        for s in (0, 1):
            other = self.p0[1 - s]
            rows = np.flatnonzero(side == s) if not self.same else np.arange(len(side))
            step = max(1, PAIRS // max(1, len(other)))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                more = n[r, None] * (gaps(p[r, None], other[None]) - gaps(self.p0[s][idx[r], None], other[None]))
                np.add.at(self.sums if s == 0 else self.sums.T, idx[r], more)

    def together(self, term: np.ndarray, side: np.ndarray, idx: np.ndarray, p: np.ndarray) -> None:
        """Terms that both sources have: what their pair differs by from the two alone. Rows come by term, side, idx; term numbers them."""
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        ends = np.r_[starts[1:], len(term)]
        middle = ends if self.same else starts + np.add.reduceat(side == 0, starts)
        left, right, first = middle - starts, (ends - starts) if self.same else ends - middle, starts if self.same else middle
        number = left * right
        group = np.cumsum(number) // PAIRS
        for g in np.unique(group):
            t = np.flatnonzero((group == g) & (number > 0))
            if not len(t):
                continue
            which = np.repeat(t, number[t])
            within = np.arange(len(which)) - np.repeat(np.cumsum(number[t]) - number[t], number[t])
            i, j = starts[which] + within // right[which], first[which] + within % right[which]
            if self.same:
                i, j = i[idx[i] < idx[j]], j[idx[i] < idx[j]]
            a, b, a0, b0 = p[i], p[j], self.p0[0][idx[i]], self.p0[1][idx[j]]
            np.add.at(self.sums, (idx[i], idx[j]), gaps(a, b) - gaps(a, b0) - gaps(a0, b) + gaps(a0, b0))

    def rows(self) -> pa.RecordBatch:
        kept = (self.sums != 0) | self.whole
        i, j = np.nonzero(np.triu(kept, 1) if self.same else kept)
        names = [pa.array(n, pa.string()).take(pa.array(at, pa.int64())) for n, at in zip(self.names, (i, j), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(i), pa.string()), *names, pa.array(self.sums[i, j])], ["lang", "source", "item", "value"])


TILE_KEY = ["lang", "a", "b", "bucket"]
HEAD, ALONE, TOGETHER = 0, 1, 2


def pair_sums(tiles: DataFrame) -> DataFrame:
    """lang, source, item, value: partial sums of each pair, from rows (lang, a, b, bucket, kind, term, side, idx, source, p, n) that lie by tile and bucket, in this order."""
    key = ["lang", "a", "b", "bucket", "kind", "term"]

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches that end where a key ends."""
        held: list[pa.RecordBatch] = []
        for b in (b for b in batches if b.num_rows):
            if held and differs(held[-1], b):
                yield pa.concat_batches(held)
                held = []
            ends = changes(b)
            if len(ends):
                yield pa.concat_batches([*held, b.slice(0, int(ends[-1]))])
                held = []
            held.append(b.slice(int(ends[-1]) if len(ends) else 0))
        if held:
            yield pa.concat_batches(held)

    def differs(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
        return any(x[c][-1] != y[c][0] and not (x[c][-1].as_py() is None and y[c][0].as_py() is None) for c in key)

    def changes(b: pa.RecordBatch, columns: list[str] = key) -> np.ndarray:
        """Rows whose key isn't that of the row before."""
        changed = np.zeros(max(0, b.num_rows - 1), bool)
        for c in columns:
            codes = b[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed |= codes[1:] != codes[:-1]
        return np.flatnonzero(changed) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at_tile = None, None
        for b in complete(batches):
            edges = [0, *changes(b, key[:5]).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                rows = b.slice(lo, hi - lo)
                here = tuple(rows[c][0].as_py() for c in ("lang", "a", "b"))
                side, idx, p, n = (rows[c].to_numpy() for c in ("side", "idx", "p", "n"))
                kind = rows["kind"][0].as_py()
                if kind == HEAD:
                    if here != at_tile:
                        if tile:
                            yield tile.rows()
                        tile, at_tile = Tile(*here, rows), here
                    if rows["bucket"][0].as_py() == 0:
                        tile.baseline(int(n[0]))
                elif kind == ALONE:
                    tile.alone(side, idx, p, n)
                else:
                    tile.together(rows["term"].dictionary_encode().indices.to_numpy(), side, idx, p)
        if tile:
            yield tile.rows()

    return tiles.mapInArrow(run, "lang string, source string, item string, value long")


def pair_divergences(groups: DataFrame, valued: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language, summed over all V kept terms.

    Most terms are missing from most sources. So a pair's sum is that of V terms that neither has, plus what each source's own
    terms change in it, which its counts of equal p say, plus what the terms that both have change in that. Sources are dealt
    to blocks, pairs of blocks are tiles, and a tile's terms to buckets, so the work of a language is spread and a task holds
    one tile of sums; terms that a source hasn't make no rows.
    """
    block = F.expr(f"idx div {SIDE}")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        """rows for each tile that their source is in."""
        rows = rows.select("*", block.cast("int").alias("_own"), other.alias("_other"))
        a, b = F.least("_own", "_other").cast("int"), F.greatest("_own", "_other").cast("int")
        place = (F.col("_own") > F.col("_other")).cast("int")
        return rows.select("lang", a.alias("a"), b.alias("b"), "bucket", "kind", "term", place.alias("side"), (F.col("idx") % SIDE).cast("int").alias("idx"), "source", "p", "n")

    none = F.lit(None).cast("binary")
    head = groups.select("lang", "blocks", "idx", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"), F.lit(HEAD).alias("kind"), none.alias("term"), "source", F.col("p0").alias("p"), F.col("terms").alias("n"))
    counts = valued.groupBy("lang", "blocks", "idx", "p").agg(F.count("*").alias("n"))
    no_name = F.lit(None).cast("string").alias("source")
    alone = counts.select("lang", "blocks", "idx", bucket("p").alias("bucket"), F.lit(ALONE).alias("kind"), none.alias("term"), no_name, "p", "n")
    together = valued.select("lang", "blocks", "idx", bucket("term").alias("bucket"), F.lit(TOGETHER).alias("kind"), "term", no_name, "p", F.lit(1).cast("long").alias("n"))
    rows = dealt(head).unionByName(dealt(alone)).unionByName(dealt(together))
    ordered = rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "kind", "term", "side", "idx")
    sums = pair_sums(ordered).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return sums.select("lang", both.alias("_pair"), "value").select("lang", "_pair.source", "_pair.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and its most marked terms.

    docs: text, lang, source; nulls count as empty, and an empty lang or source is one like any other. Other columns aren't
    read, whatever their names. Terms are runs of ASCII letters, of which A-Z is lower-cased, and of non-ASCII characters, over the whole
    text; repeated rows count as often as they stand there. A language keeps the terms that at least min_docs of its documents
    have. p is a term's smoothed share in a group, in units of 1 / UNIT, and its distance from q is floor((p - q) ** 2 / (p + q)).
    Part pair sums it over all kept terms, for each other source; a language of one source has no such rows, and one without kept
    terms has zeros. Part term is between the group and its language, of the terms that the group has more of, the top first.
    Equal values rank by the UTF-8 bytes of item. An empty table gives no rows.

    Documents are read where they lie: each task counts its terms before the shuffle. No list of terms or sources leaves the tasks.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    first = (F.row_number().over(term.orderBy("source")) == 1).cast("long")
    entries = counts.withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "first": first}).where(F.col("in_docs") >= min_docs)
    entries = materialise(entries.select("lang", "source", "term", "n", "total", "first"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum("first").alias("_terms"), F.sum(F.col("first") * F.col("total")).alias("_words"))
    of_lang = Window.partitionBy("lang")
    groups = (
        named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["words", "_terms", "_words"])
        .withColumns({"terms": F.sum("_terms").over(of_lang), "lang_words": F.sum("_words").over(of_lang), "idx": F.row_number().over(of_lang.orderBy("source")) - 1})
        .withColumns({"blocks": F.expr(f"cast((count(*) over (partition by lang) + {SIDE - 1}) div {SIDE} as int)"), "p0": share(F.lit(2), F.col("words") + 2 * F.col("terms"))})
    )
    groups = materialise(compact(groups.drop("_terms", "_words")))
    valued = entries.join(small(groups), ["lang", "source"]).withColumns(
        {"p": share(F.col("n") + 2, F.col("words") + 2 * F.col("terms")), "q": share(F.col("total") + 2, F.col("lang_words") + 2 * F.col("terms"))}
    )
    valued = materialise(valued.select("lang", "source", "term", "blocks", "idx", "p", "q"))
    marked = valued.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = radix_top(materialise(marked), ["lang", "source"], top).withColumns({"item": F.col("item").cast("string"), "part": F.lit("term")})
    pairs = pair_divergences(groups, valued).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(terms.select(*columns))
