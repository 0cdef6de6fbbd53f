"""Similarity join of names by edit distance, with no pair lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fuzzy_score


def edits(length: Column, least_score: float) -> Column:
    """Most edits between two names, the longer of that length, whose score is least_score or more."""
    return F.floor(length * ((100 - least_score) / 100) + 1e-9).cast("int")


def _bounds(longest: Column, least_score: float) -> tuple[Column, Column]:
    """Most edits of a pair by the length of its longer name, and the least length of the class that the pair belongs to.

    A class has one bound of edits; classes of few edits, whose lengths differ by much, are halved.
    """
    most = edits(longest, least_score)
    if least_score == 100:
        return most, longest
    least = lambda d: F.ceil((d - 1e-9) * (100 / (100 - least_score))).cast("int")
    middle = F.call_function("div", least(most) + least(most + 1), F.lit(2)).cast("int")
    first = F.when((most < 3) & (longest >= middle), middle).otherwise(least(most))
    return most, F.when(most == 0, longest).otherwise(F.least(longest, first))


def _keys(names: DataFrame, least_score: float, side: int) -> DataFrame:
    """_key, _name, _own and _mark of names: what a name shares with each partner that it may have, see similar_names.

    _own: the class is that of the name's own length, so the name may be the longer one. _mark: place and letter that a part
    has lost, or 0 for one way on side 0, by the name's hash: of all the ways of two equal parts one is enough, and names spread over them.
    """
    n, most, least, longest = F.col("_n"), F.col("_most"), F.col("_least"), F.col("_longest")
    classes = names.withColumn("_longest", F.explode(F.sequence(n, (n / (least_score / 100)).cast("int") + 1)))
    here, before = _bounds(longest, least_score), _bounds(longest - 1, least_score)
    new = (longest == n) | (here[0] != before[0]) | (here[1] != before[1])
    classes = classes.where((longest - here[0] <= n) & new).withColumns({"_most": here[0], "_least": here[1]})

    # The first part may lose a letter (from one edit on), the last one too (from three), the ones between none.
    head, tail = F.least(most, F.lit(1)), (most >= 3).cast("int")
    count, i = most + 1 - head - tail, F.col("_i")
    parts = classes.withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
    letters, spare = F.call_function("div", least - head - tail, count).cast("int"), (least - head - tail) % count
    cut = F.when(i == 0, head).when(i == count - 1, tail).otherwise(0)
    ahead = F.when(i == 0, 0).otherwise(i + head)  # edits that fall before the part, if the parts there don't do
    behind = most - ahead - cut
    start = i * letters + F.least(i, spare) + F.when(i == 0, 0).otherwise(head)
    parts = parts.withColumns({"_cut": cut, "_length": letters + (i < spare).cast("int") + cut, "_moved": F.least(ahead, behind), "_at": F.when(ahead <= behind, start).otherwise(n - least + start)})

    # A part between may have moved, in the shorter name; in the longer one it stands at its place. Ends never move.
    moved, at, length, role = F.col("_moved"), F.col("_at"), F.col("_length"), F.col("_role")
    roles = F.when(moved == 0, F.array(F.lit(-1))).when(longest == n, F.array(F.lit(side), F.lit(1 - side))).otherwise(F.array(F.lit(1 - side)))
    reach = F.when(role == side, 0).otherwise(moved)
    placed = parts.withColumn("_role", F.explode(roles)).withColumn("_at", F.explode(F.sequence(at - reach, at + reach)))
    from_, to = F.greatest(at, F.lit(0)), F.least(at + length, n)
    placed = placed.where(to - from_ >= length - F.col("_cut")).withColumn("_text", F.substring("_name", from_ + 1, to - from_))

    # All ways to lose the letter, but of equal letters in a row only the last; a part that is short of one letter has lost it.
    text, gone = F.col("_text"), F.col("_gone")
    whole = (F.col("_cut") == 0) | (F.length(text) < length)
    lost = placed.withColumn("_gone", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), length))))
    lost = lost.where((gone == 0) | (F.substring(text, gone, F.lit(1)) != F.substring(text, gone + 1, F.lit(1))))
    left = F.when(gone == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), gone - 1), F.substring(text, gone + 1, length)))
    letter, one = F.substring(text, gone, F.lit(1)), F.pmod(F.hash("_name"), length) + 1
    chosen = (gone >= one) & (F.substring(text, one, gone - one + 1) == F.repeat(letter, gone - one + 1))
    mark = F.when((gone == 0) | chosen if side == 0 else gone == 0, 0).otherwise(gone.cast("long") * (1 << 21) + F.ascii(letter))
    return lost.select(F.xxhash64("_most", "_least", "_i", "_role", left).alias("_key"), "_name", (longest == n).alias("_own"), mark.alias("_mark"))


def similar_names(left: DataFrame, right: DataFrame, least_score: float, left_name: str = "name", right_name: str = "known") -> DataFrame:
    """(left_name, right_name, score): all pairs of distinct names whose score is least_score (over 0, at most 100) or more.

    The score is 100 less the edit distance's share of the longer name, so the longer name's length sets the most edits d.
    Names are keyed in each class of lengths that the longer name of a pair may have. In a class, the longer name is
    cut into parts that may lose letters, one at each end (the last from d = 3 on) and none between, so that the parts and the
    letters they may lose are d + 1: d edits leave one part with no more edits than that. The ends stand at the ends of the
    other name too, and share what is left of them when one letter goes; a part between is whole in the other name,
    moved by no more than the parts on either side allow. Keys are hashes, and pairs that share one are verified by their
    distance, so none is wrong or lost. Keys are half as many letters as the name up to three edits, a third at four, so few pairs meet by
    chance. Names are keyed once, whatever their number of rows. A part that very many names share makes as many pairs, which
    adaptive execution splits over tasks, as this is a plain inner join. Null and empty names match nothing. Lengths and edits
    are in characters.
    """
    if not 0 < least_score <= 100:
        raise ValueError("least_score is over 0 and at most 100")
    names = lambda df, c: df.select(F.col(c).alias("_name")).where("_name <> ''").distinct().withColumn("_n", F.length("_name"))
    met, known = _keys(names(left, left_name), least_score, 0).alias("l"), _keys(names(right, right_name), least_score, 1).alias("r")
    a, b = F.col("l._name"), F.col("r._name")

    pairs = met.join(known.hint("merge"), "_key")  # exploded, so far larger than its estimate: never broadcast
    # One condition, so that it is judged in this order and distances come last.
    pairs = pairs.where((F.col("l._own") | F.col("r._own")) & ((F.col("l._mark") == 0) | (F.col("l._mark") != F.col("r._mark"))) & (fuzzy_score(a, b) >= least_score))
    return pairs.select(a.alias(left_name), b.alias(right_name), fuzzy_score(a, b).alias("score")).distinct()
