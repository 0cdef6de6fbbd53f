"""Joins that align irregular data with the panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.similarity import similar_names
from tessella.session import BROADCAST_ROWS


def dense_left_join(panel: DataFrame, features: DataFrame, keys: list[str], zero_fill: list[str] = ()) -> DataFrame:
    """Features on the panel's keys; flow columns get 0 where there is no record."""
    return panel.join(features, keys, "left").fillna(0, list(zero_fill)) if zero_fill else panel.join(features, keys, "left")


def group_total(c: str, group: str, date: str) -> Column:
    """Sum over the group at the date, for each of its rows; 0 where the group is null."""
    total = F.sum(c).over(Window.partitionBy(group, date))
    return F.when(F.col(group).isNull(), F.lit(0)).otherwise(F.coalesce(total, F.lit(0)))


def full_outer_series(series: list[DataFrame], key: str = "date") -> DataFrame:
    """One row a key of any series."""
    return reduce(lambda a, b: a.join(b, key, "full"), series)


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: list[str] = (), tolerance_days: int | None = None) -> DataFrame:
    """left with all other columns of the newest right row at or before its date, nulls included; null beyond the tolerance.

    Both sides go through one sort by (by, date): no pairs are made, nothing is broadcast, and with keys there is one shuffle.
    Without keys the dates of the left side alone are matched, then joined back: a national series never meets the panel row
    by row. Null keys match nothing. Of right rows at the same place one is taken.
    """
    by = list(by)
    values = [c for c in right.columns if c != on and c not in by]
    rows = left if by else left.select(on).distinct()
    mine, theirs = F.struct(*rows.columns), F.struct(F.col(on).alias("_at"), *values)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema[0].dataType)
    marked = rows.select(*by, on, mine.alias("_left"), none(right, theirs).alias("_right"), F.lit(1).alias("_side")).unionByName(right.select(*by, on, none(rows, mine).alias("_left"), theirs.alias("_right"), F.lit(0).alias("_side")))
    w = (Window.partitionBy(*by) if by else Window).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], F.lit(True) if tolerance_days is None else F.datediff(on, "_right._at") <= tolerance_days)
    matched = found.select(*[F.col(f"_left.{c}").alias(c) for c in rows.columns], *[F.when(ok, F.col(f"_right.{v}")).alias(v) for v in values])
    return matched if by else left.join(matched, on, "left")


def overlap_windows(events: DataFrame, start: str, end: str, value: str, anchor: str, days: int, cell: str) -> DataFrame:
    """(cell, window_start, value) summed over the grid windows that each event [start, end] overlaps, in seconds, by its share there.

    An event of no duration counts whole. Each event is dealt to the windows that it meets, so windows are met by number,
    not by a range join.
    """
    span = days * 86_400
    zero = F.unix_timestamp(F.lit(anchor).cast("timestamp"))
    first = F.floor((F.col(start) - zero) / span)
    last = F.when(F.col(end) > F.col(start), F.ceil((F.col(end) - zero) / span) - 1).otherwise(first)
    dealt = events.withColumn("_w", F.explode(F.sequence(first, F.greatest(first, last))))
    begin = zero + F.col("_w") * span
    overlap = F.least(F.col(end), begin + span) - F.greatest(F.col(start), begin)
    share = F.when(F.col(end) == F.col(start), F.lit(1.0)).otherwise(overlap / (F.col(end) - F.col(start)))
    return dealt.groupBy(cell, F.date_add(F.lit(anchor).cast("date"), (F.col("_w") * days).cast("int")).alias("window_start")).agg(F.sum(F.col(value) * share).alias("value"))


def largest_overlap(bridge: DataFrame, key: str, name: str, area: str) -> DataFrame:
    """For each key the name of the largest area; of equal ones the first by name."""
    return bridge.groupBy(key).agg(F.min_by(name, F.struct(-F.col(area), F.col(name))).alias(name))


def cascade_lookup(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """The value of the first level with a match: levels are (table with unique keys, key columns, value column), best first.

    Equi joins only; adaptive execution broadcasts the tables that turn out small.
    """
    found = []
    for i, (table, keys, value) in enumerate(levels):
        df = df.join(table.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
        found.append(f"_v{i}")
    return df.withColumn(out, F.coalesce(*found)).drop(*found)


def substring_match(names: DataFrame, known: DataFrame, name: str, known_name: str, weight: str, rank: str, default: float = 0.0) -> DataFrame:
    """Weight of the known name that equals the name, or else of the first by rank that contains it or is contained in it.

    Distinct names are matched once each. known is a dictionary: more than BROADCAST_ROWS entries are refused, as every name
    would be compared with each of them.
    """
    if known.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} known names")
    n, k = F.col(name), F.col(known_name)
    distinct = names.select(name).where(n.isNotNull() & (n != "")).distinct()
    pairs = distinct.join(F.broadcast(known), F.contains(n, k) | F.contains(k, n))
    best = pairs.groupBy(name).agg(F.min_by(weight, F.struct((n != k).cast("int"), F.col(rank), k)).alias("_weight"))
    return names.join(best, name, "left").withColumn("weight", F.coalesce("_weight", F.lit(default))).drop("_weight")


def neighbour_sum(panel: DataFrame, edges: DataFrame, c: str, out: str, cell: str = "cell", date: str = "date", neighbour: str = "neighbour") -> DataFrame:
    """Sum at each cell's neighbours at the same date: absent neighbours count 0, the cell itself does not."""
    spread = panel.select(F.col(cell).alias(neighbour), date, F.col(c).alias("_v")).join(edges.where(F.col(cell) != F.col(neighbour)), neighbour)
    sums = spread.groupBy(cell, date).agg(F.sum("_v").alias(out))
    return panel.join(sums, [cell, date], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def at_offset(df: DataFrame, c: str, out: str, offset: int, cell: str = "cell", position: str = "pos") -> DataFrame:
    """The cell's value at a date position so many steps back, if there is a row."""
    other = df.select(cell, (F.col(position) + offset).alias(position), F.col(c).alias(out))
    return df.join(other, [cell, position], "left")


def resolve_entities(names: DataFrame, name: str, places: DataFrame, units: list[tuple[str, DataFrame]], least_score: float = 90.0, least_length: int = 3) -> DataFrame:
    """names with place, level and score: an equal place name, else the closest of a score of least_score or more, else an equal unit.

    names and tables hold normalised names; those of fewer than least_length characters resolve to nothing. places: place_name,
    place; units: (level, table with unit_name and unit), finest first. Of equally close place names the first by name is
    taken, of equal names the least place. Names that no place equals meet all place names within the score, once each, by
    shared segments, so a gazetteer is never crossed with all names and no match is missed.
    """
    n = F.col(name)
    distinct = names.select(name).where(F.length(n) >= least_length).distinct()
    exact = distinct.join(places.groupBy(F.col("place_name").alias(name)).agg(F.min("place").alias("_p")).hint("merge"), name, "left")
    near = similar_names(exact.where(F.col("_p").isNull()).select(F.col(name).alias("_left")), places, least_score, "_left", "place_name")
    best = near.groupBy(F.col("_left").alias(name)).agg(F.min(F.struct((-F.col("score")).alias("s"), "place_name")).alias("_f"))
    fuzzy = best.join(places.groupBy(F.col("place_name").alias("_of")).agg(F.min("place").alias("place")).hint("merge"), F.col("_f.place_name") == F.col("_of")).select(name, F.struct("_f.s", "place").alias("_f"))
    found = exact.join(fuzzy, name, "left").withColumns({"place": F.coalesce("_p", "_f.place"), "level": F.when(F.col("_p").isNotNull(), "exact").when(F.col("_f").isNotNull(), "fuzzy"), "score": F.when(F.col("_p").isNotNull(), 100.0).otherwise(-F.col("_f.s"))}).drop("_p", "_f")
    for level, table in units:
        found = found.join(table.groupBy(F.col("unit_name").alias(name)).agg(F.min("unit").alias("_u")), name, "left")
        use = F.col("place").isNull() & F.col("_u").isNotNull()
        found = found.withColumns({"level": F.when(use, F.lit(level)).otherwise(F.col("level")), "place": F.coalesce("place", "_u")}).drop("_u")
    return names.join(found, name, "left")
