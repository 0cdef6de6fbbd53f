"""Mixing sources to target weights by distributed prefix sums over hash-random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.carried import carry
from tessella.session import compact, materialise, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
#: Groups that equal rows are numbered in.
BUCKETS = 1024


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _source (never null), _key (hash-random, fixed by doc_id and text), _range (the key's first digits) and size."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return docs.withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")),
            "_key": key,
            "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        }
    ).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (_source, source_size), one row a source: the words that each is to give.

    Weights repeat over the sources by code point, null last. In order of cap / weight, the sources before the first whose
    cap holds its share are capped; the rest share what is left by weight. The windows have no key: their rows are sources.
    """
    order = Window.orderBy(F.col("_source") == "none", "_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * max_epochs
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ranked = (
        totals.withColumns({"_weight": weight, "_cap": cap})
        .withColumns({"_left": left, "_rest": F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)), "_rank": F.row_number().over(by_ratio)})
        .withColumn("_share", F.when(F.col("_cap") * F.col("_rest") >= F.col("_left") * F.col("_weight"), F.struct("_rank", "_left", "_rest")))
        .withColumn("_share", F.min("_share").over(everything))
    )
    shared = (F.col("_share._left") * F.col("_weight")).cast("double") / F.col("_share._rest")
    return ranked.select("_source", "source_size", F.when(F.col("_rank") < F.col("_share._rank"), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def mix_plan(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From materialised (_source, _range, _key, size), one row a source: source_size, target, _epochs (whole passes) and _cut.

    _cut is the key at which the last pass ends, how many rows have it, and the words that these are to give together. Sums
    per (source, range of keys) are made before any shuffle; a source, however large, is sorted range by range, and equal
    rows are counted before, so no task holds more than the distinct keys of one range of one source.
    """
    ranges = slim.groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    plan = targets(slim.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("_budget", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    plan = plan.withColumn("_epochs", whole).withColumn("_last", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    plan = small(materialise(compact(plan)))
    running = Window.partitionBy("_source", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("n")
    cut = (
        slim.join(small(materialise(compact(ranges.join(plan.select("_source", "_last"), "_source").where("_before < _last and _last <= _before + _words")))), ["_source", "_range"])
        .groupBy("_source", "_range", "_before", "_last", "_key", "size")
        .agg(F.count("*").alias("n"))
        .withColumn("_before", F.col("_before") + F.coalesce(F.sum(words).over(running), F.lit(0)))
        .where((F.col("_before") < F.col("_last")) & (F.col("_last") <= F.col("_before") + words))
        .groupBy("_source")
        .agg(F.min(F.struct("_key", "size", "n", (F.col("_last") - F.col("_before")).alias("words"))).alias("_cut"))
    )
    return materialise(compact(plan.join(cut, "_source", "left")))


def number_equal_rows(rows: DataFrame) -> DataFrame:
    """rows with _number: from 0 within each source. Rows are dealt to BUCKETS a source, counted, and numbered bucket by bucket."""
    rows = materialise(rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod(F.xxhash64("_tie"), F.lit(BUCKETS))))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_source", "_bucket").count().select("_source", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_tie"))
    return rows.withColumn("_number", within - 1).join(offsets, ["_source", "_bucket"]).withColumn("_number", F.col("_number") + F.col("_offset")).drop("_tie", "_bucket", "_offset")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, with_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken: the words that the mix takes of each row, repeats counted.

    A source gives whole passes over its rows, then its rows in key order up to its exact budget; of the row at that place
    it takes as many words as are left. Rows without text have size 0 and give nothing; null sources are one source, the
    last. Rows of equal doc_id, text and source follow each other; where the budget ends among them, some give all of their
    words, one the rest and the others none (which of them is open). An empty table gives no rows. Columns that clash with
    the new ones are replaced. without with_text the text isn't returned, and is read once instead of twice.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    return carry(docs, ("doc_id", "source", "text"), lambda own: _mix(own, weights, max_epochs, with_text))


def _mix(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, with_text: bool) -> DataFrame:
    rows = keyed(docs)
    keys = ("_source", "_range", "_key", "size")
    slim = materialise(rows.select(*keys) if with_text else rows.drop("text"))
    plan = small(mix_plan(slim.select(*keys), weights, max_epochs))
    joined = (rows if with_text else slim).join(plan, "_source")
    place, cut = F.struct("_key", "size"), F.struct("_cut._key", "_cut.size")
    at_cut = F.coalesce(place == cut, F.lit(False))
    whole, left = F.col("size") * F.col("_epochs"), F.col("_cut.words")
    done = lambda df, last: df.withColumn("taken", whole + last).drop("_source", "_key", "_range", "_budget", "_epochs", "_last", "_cut", "_number")
    others = F.when(place < cut, F.col("size")).when(at_cut, left).otherwise(F.lit(0))
    if plan.where("_cut.n > 1").isEmpty():
        return done(joined, others)
    equal = at_cut & (F.col("_cut.n") > 1)
    share = F.least(F.col("size"), F.greatest(F.lit(0), left - F.col("_number") * F.col("size")))
    return done(joined.where(~equal), others).unionByName(done(number_equal_rows(joined.where(equal)), share))
