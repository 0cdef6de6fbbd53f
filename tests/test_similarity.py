"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import joins, similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(name, n, rng):
    for _ in range(n):
        at, kind = rng.randrange(len(name) + 1), rng.choice("ids")
        name = name[:at] + (rng.choice("abcdé") if kind != "d" else "") + name[at + (kind != "i") :]
    return name


def made(seed, n, least, longest, letters="abcd"):
    rng = random.Random(seed)
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(least, longest))) for _ in range(n)]
    return [edited(rng.choice(known), rng.randint(0, 4), rng) for _ in range(2 * n)] + known[: n // 4], known


@pytest.mark.parametrize("score", [50, 75, 80, 90, 100])
def test_all_pairs_are_found(spark, score):
    short, long = made(score, 60, 1, 6, "ab"), made(score + 1, 60, 3, 40)
    names, known = short[0] + long[0] + ["", None, "x" * 300], short[1] + long[1] + ["", None, "x" * 290, "ab" * 9, "ab" * 10]
    df = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    got = {(r["name"], r["known"]): r["score"] for r in similarity.similar_names(df(names, "name"), df(known, "known"), score).collect()}
    expected = {}
    for a in {*names} - {"", None}:
        for b in {*known} - {"", None}:
            if abs(len(a) - len(b)) <= max(len(a), len(b)) / 2 and (s := 100 * (1 - distance(a, b) / max(len(a), len(b)))) >= score:
                expected[a, b] = s
    assert got == pytest.approx(expected) and set(got) == set(expected) and len(expected) > 50


def test_score_must_be_a_share(spark):
    with pytest.raises(ValueError):
        similarity.similar_names(spark.createDataFrame([], "name string"), spark.createDataFrame([], "known string"), 0)


def test_closest_place_wins_and_short_names_resolve_to_nothing(spark):
    places = spark.createDataFrame([("bangassou town", 3), ("bangassou twon", 2), ("bangassou twon", 9), ("xbangassou towm", 1), ("ab", 7), (None, 8), ("", 5)], "place_name string, place int")
    names = spark.createDataFrame([("bangassou tow",), ("ybangassou towm",), ("ab",), (None,), ("",), ("nowhere at all",)], "n string")
    got = {r["n"]: (r["place"], r["level"]) for r in joins.resolve_entities(names, "n", places, [("unit", spark.createDataFrame([("ab", 1)], "unit_name string, unit int"))], 85).collect()}
    assert got == {"bangassou tow": (3, "fuzzy"), "ybangassou towm": (1, "fuzzy"), "ab": (None, None), None: (None, None), "": (None, None), "nowhere at all": (None, None)}


def test_no_cross_join(spark):
    names = spark.createDataFrame([("abc",)], "name string")
    plan = similarity.similar_names(names, names.withColumnRenamed("name", "known"), 90)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyed_names_are_never_broadcast(spark, tmp_path):
    names = spark.range(50).selectExpr("md5(cast(id as string)) as name")
    places = names.selectExpr("name as place_name", "1L as place")
    near = similarity.similar_names(names, places, 80, right_name="place_name")
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == 50
    found = joins.resolve_entities(names, "name", places, [], 90)
    assert "Broadcast" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "_text" in line or "_of" in line)


def test_few_pairs_meet_by_chance(spark, monkeypatch):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        judged.add(1)
        return 100 * (1 - distance(a, b) / max(len(a), len(b)))

    monkeypatch.setattr(similarity, "fuzzy_score", score)
    names = spark.range(16_000).selectExpr("id", "substring(md5(cast(id as string)), 1, cast(12 + id % 9 as int)) as name")
    near = similarity.similar_names(names.where("id < 8000"), names.where("id >= 8000").withColumnRenamed("name", "known"), 80)
    assert near.count() == 0
    assert judged.value < 2000  # of 64 million


@pytest.mark.parametrize("score", [60, 80, 90])
def test_pairs_of_the_most_edits_are_found(spark, score):
    rng = random.Random(score)
    pairs = []
    for n in range(4, 60):
        for _ in range(6):
            name = "".join(rng.choice("abcdé") for _ in range(n))
            pairs.append((edited(name, int(n * (100 - score) / 100), rng), name))
    df = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    expected = {(a, b) for a, b in pairs if a and 100 * (1 - distance(a, b) / max(len(a), len(b))) >= score}
    for left, right, turn in ((0, 1, 1), (1, 0, -1)):
        got = {(r["name"], r["known"])[::turn] for r in similarity.similar_names(df([p[left] for p in pairs], "name"), df([p[right] for p in pairs], "known"), score).collect()}
        assert expected <= got and len(expected) > 200


def test_equal_beginnings_are_judged_once(spark, monkeypatch):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        judged.add(1)
        return 100.0 if a == b else 0.0

    monkeypatch.setattr(similarity, "fuzzy_score", score)
    names = spark.range(200).selectExpr("'prefecture ' || substring(md5(cast(id as string)), 1, 10) as name")
    assert similarity.similar_names(names, names.withColumnRenamed("name", "known"), 80).count() == 200
    assert judged.value < 1.5 * 200 * 200
