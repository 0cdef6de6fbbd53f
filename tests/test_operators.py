"""Joins, disaggregation, functions, sources and contracts on small frames."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import geo, ids, repair, text
from tessella.operators import aggregates, joins, ranking, spatial
from tessella.plans import contracts
from tessella.plans.model import conformal, diagnostics, matrix
from tessella.sources import incremental, readers, upsert


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_overlap_counts_events_of_no_duration_whole(spark):
    day = 86_400
    start = 1_704_067_200
    events = spark.createDataFrame([(1, start + day, start + 3 * day, 4.0), (1, start, start, 5.0)], "cell int, s long, e long, v double")
    got = values(joins.overlap_windows(events, "s", "e", "v", "2024-01-01", 2, "cell"), "window_start")
    assert got == [(1, dt.date(2024, 1, 1), 7.0), (1, dt.date(2024, 1, 3), 2.0)]


def test_shares_with_missing_and_zero_population(spark):
    units = spark.createDataFrame([("a", 10.0, 3.0), ("a", 10.0, None), ("b", 6.0, 0.0), ("b", 6.0, 0.0)], "u string, n double, p double")
    assert values(spatial.weighted_shares(units, "u", "n", "p", "s").select("u", "s"), "u", "s") == [("a", 2.5), ("a", 7.5), ("b", 3.0), ("b", 3.0)]


def test_neighbours_that_are_absent_count_zero(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (5, 5)], "q int, r int").select(geo.hex_id(F.col("q"), F.col("r")).alias("cell"))
    panel = cells.withColumns({"date": F.lit(1), "v": F.lit(2)})
    got = joins.neighbour_sum(panel, geo.ring_edges(cells, "cell"), "v", "s")
    assert sorted(r["s"] for r in got.collect()) == [0, 2, 2]


def test_hexagons(spark):
    row = spark.range(1).select(geo.hex_q(geo.hex_id(F.lit(-3), F.lit(7))).alias("q"), geo.hex_r(geo.hex_id(F.lit(-3), F.lit(7))).alias("r"), geo.hex_of_point(F.lit(0.0), F.lit(0.0), 1.0).alias("c"), geo.hex_id(F.lit(0), F.lit(0)).alias("o")).first()
    assert (row["q"], row["r"]) == (-3, 7) and row["c"] == row["o"]
    cell = spark.range(1).select(geo.hex_id(F.lit(0), F.lit(0)).alias("cell"))
    assert geo.ring_edges(cell, "cell", 2).count() == 18


@pytest.mark.parametrize("limit", [0, 100])
def test_nearest_by_square_and_by_broadcast_agree(spark, limit):
    cells = spark.range(40).select(F.col("id").alias("c"), (F.col("id") * 7 % 31).cast("double").alias("lat"), (F.col("id") * 11 % 47).cast("double").alias("lon"))
    points = spark.range(25).select(F.col("id").alias("p"), (F.col("id") * 5 % 29).cast("double").alias("plat"), (F.col("id") * 3 % 41).cast("double").alias("plon"))
    ps = [tuple(r) for r in points.collect()]
    want = {c: min(((a - x) ** 2 + (b - y) ** 2, p) for p, x, y in ps)[1] for c, a, b in cells.collect()}
    assert {r["c"]: r["p"] for r in spatial.nearest_point(cells, points, "c", "p", limit=limit).collect()} == want


def test_substring_match_prefers_equal_then_rank(spark):
    known = spark.createDataFrame([("army", 1.0, 2), ("army of x", 2.0, 1), ("x", 3.0, 3)], "k string, w double, r int")
    names = spark.createDataFrame([("army",), ("army of x and y",), ("none",), ("",), (None,)], "name string")
    got = {r["name"]: r["weight"] for r in joins.substring_match(names, known, "name", "k", "w", "r").collect()}
    assert got == {"army": 1.0, "army of x and y": 2.0, "none": 0.0, "": 0.0, None: 0.0}


def test_normal_name(spark):
    # Prefixes are met before marks are plain, so a marked one stays, and in order, so one may follow another.
    names = {"Prefecture de l'Ouham": "l ouham", "  Bangui  (ville)\t": "bangui ville", "Sous-Prefecture Bria": "bria", "Préfecture de X": "prefecture de x", "Commune de X": "commune de x", "prefecture de prefecture X": "x",
             "sous-prefecture de  X²": "x²", "Ñaña-Éléphant Ï": "ñaña elephant i", "prefecture": "prefecture", None: "", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["x"] for r in df.withColumn("x", text.normal_name(F.col("n"))).collect()} == names


@pytest.mark.parametrize(("words", "extra", "want"), [(4, "", 0.1), (5, "", 5 / 30), (30, "", 1.0), (31, "", 1.0), (10, " as reported", 0.3), (0, "", 0.1)])
def test_quality_weight(spark, words, extra, want):
    t = " ".join(["word"] * words) + extra
    assert spark.createDataFrame([(t,)], "t string").select(text.quality_weight(F.col("t"))).first()[0] == pytest.approx(want)


def test_repair(spark):
    raw = ["[9.63E0]", "nan", "text", None, " 4 "]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    assert [r[0] for r in df.select(repair.repaired_number(F.col("t"))).collect()] == [9.63, None, None, None, 4.0]
    assert repair.acceptance(df, ["t"]) == {"t": True} and repair.acceptance(df, ["t"], "strict") == {"t": False}


def test_signed_ids(spark):
    df = spark.createDataFrame([("85283473fffffff",), ("18446744073709551615",), ("-5",), ("zz",), ("0xff",), (None,)], "t string")
    assert [r[0] for r in df.select(ids.signed_id(F.col("t"))).collect()] == [0x85283473FFFFFFF, -1, -5, None, 255, None]


def test_reports_without_header_are_dropped(spark):
    lines = spark.createDataFrame([(1, 0, "intro"), (1, 1, "# A"), (1, 2, "x"), (1, 3, "y"), (1, 4, "# B"), (2, 0, "only")], "d int, i int, line string")
    assert values(text.split_entries(lines, "d", "i", "line", "^# "), "d", "entry") == [(1, 1, "# A", "x y"), (1, 2, "# B", "")]


def test_row_mean_and_ratio(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(aggregates.row_mean(["a", "b", "c"])).collect()] == [2.0, None]
    assert spark.range(1).select(aggregates.guarded_ratio(F.lit(4), F.lit(0))).first()[0] == 4


def test_top_percent_takes_the_ceiling(spark):
    df = spark.range(11).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert [r["v"] for r in ranking.top_percent(df, "g", "v", "v", 10).orderBy("rank").collect()] == [10, 9]


def test_merge_overwrites_with_null_and_keeps_absent_columns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, None), (3, 9.0)], "k int, x double")
    assert values(upsert.merge(old, new, ["k"]), "k") == [(1, "a", 1.0), (2, "b", None), (3, None, 9.0)]
    with pytest.raises(ValueError):
        upsert.assert_unique(new.unionAll(new), ["k"])


def test_versioned_table(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    for x in (1.0, 2.0):
        t.upsert(spark.createDataFrame([(1, x), (int(x) + 5, x)], "k int, x double"), ["k"])
    assert values(t.read(), "k") == [(1, 2.0), (6, 1.0), (7, 2.0)]


def test_versioned_table_survives_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"))
    t.upsert(spark.createDataFrame([(1, 1.0)], "k int, x double"), ["k"])
    new = spark.createDataFrame([(2, 2.0)], "k int, x double")
    for step in ("_publish", "_write", "_clean"):
        with monkeypatch.context() as m:
            m.setattr(upsert.VersionedTable, step, lambda *a: (_ for _ in ()).throw(OSError("stopped")))
            with pytest.raises(OSError):
                t.upsert(new, ["k"])
        assert (1, 1.0) in values(t.read(), "k")
    (tmp_path / "t" / "manifests" / "999999999999-x.tmp").write_text("half a manifest")
    t.upsert(new, ["k"])
    assert values(t.read(), "k") == [(1, 1.0), (2, 2.0)]
    assert t.vacuum() == [] and sorted(n[:4] for n in t.vacuum(0.0)) == ["data", "mani"]  # what the stopped writers left
    assert values(t.read(), "k") == [(1, 1.0), (2, 2.0)] and t.vacuum(0.0) == []


@pytest.mark.parametrize("partition", [None, "k % 4"])
def test_writers_that_meet_lose_nothing(spark, tmp_path, partition):
    from concurrent.futures import ThreadPoolExecutor

    table = lambda: upsert.VersionedTable(spark, str(tmp_path / "t"), partition=partition)
    schema = "k int, x double"

    def write(writer: int) -> None:
        for i in range(7):  # keys of their own, and one that all write
            table().upsert(spark.createDataFrame([(100 * writer + i, float(writer)), (-4, float(writer))], schema), ["k"])

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    rows = dict(values(table().read(), "k"))
    assert {k: x for k, x in rows.items() if k != -4} == {100 * w + i: float(w) for w in range(3) for i in range(7)} and rows[-4] in (0.0, 1.0, 2.0)
    assert table()._newest()[0] == 21 and len(table()._manifests()) == table().KEEP
    assert table().vacuum(0.0) == []  # nothing that lost a race stays


def test_a_publish_never_replaces_another(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"))
    assert t._publish(1, {"": "data/a"}) and not t._publish(1, {"": "data/b"})
    assert t._newest() == (1, {"": "data/a"}) and not [n for n in t._names("manifests") if n.endswith(".tmp")]


def test_upsert_leaves_untouched_partitions(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), partition="year(d)")
    row = lambda k, y, x: (k, dt.date(y, 1, 2), x)
    schema = "k int, d date, x double"
    t.upsert(spark.createDataFrame([row(1, 2020, 1.0), row(2, 2021, 2.0)], schema), ["k", "d"])
    before = t._newest()[1]
    for _ in range(5):
        t.upsert(spark.createDataFrame([row(2, 2021, 5.0), row(3, 2022, 3.0)], schema), ["k", "d"])
    after = t._newest()[1]
    assert after["_part=2020"] == before["_part=2020"] and after["_part=2021"] != before["_part=2021"]
    assert values(t.read(), "k") == [row(1, 2020, 1.0), row(2, 2021, 5.0), row(3, 2022, 3.0)]
    assert len(t._manifests()) == t.KEEP


def test_running_sums_equal_plain_ones(spark):
    from tessella.operators.ranges import numbered, running_sums

    rows = [(g, i * 37 % 101, i % 7) for g in ("a", "b", None) for i in range(101)]
    got = running_sums(spark.createDataFrame(rows, "g string, o int, v int"), {"s": "v"}, [F.desc("o")], ["g"], {"t": "v"}, range_rows=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["s"] == sum(v for g, o, v in rows if g == r["g"] and o >= r["o"]) and r["t"] == sum(v for g, _, v in rows if g == r["g"])
    plan = numbered(spark.range(1000), "n", [F.col("id")], range_rows=150)
    assert [r["n"] for r in plan.orderBy("id").collect()] == list(range(1, 1001))
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def test_incremental_window(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10),)], "d date")
    a, b = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    assert incremental.window_to_load(df, "d", a, b) == (dt.date(2024, 1, 11), b)
    assert incremental.window_to_load(None, "d", a, b) == (a, b) == incremental.window_to_load(df, "d", a, b, force=True)
    assert incremental.window_to_load(df, "d", a, dt.date(2024, 1, 10)) is None
    assert incremental.catalog_overview(spark, {"t": df}).first()["first_date"] == dt.date(2024, 1, 10)


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    (tmp_path / "with.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "without.csv").write_text("1,a\n2,b\n")
    for name in ("with", "without"):
        assert values(readers.read_csv_sniffed(spark, str(tmp_path / f"{name}.csv"), schema), "id") == [(1, "a"), (2, "b")]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.tsv", "1\tskip\tq\nshort\n2\tskip\tw\n")
    assert values(readers.read_zipped_table(spark, str(tmp_path / "x.zip"), {0: "a", 2: "b"}), "a") == [("1", "q"), ("2", "w")]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"n": "m"}}]}))
    assert values(readers.read_geojson(spark, str(tmp_path / "p.json"), ["n"]), "n") == [(1.5, 2.5, "m")]
    manifest = spark.createDataFrame([("http://x/20240105000000.zip",), ("http://x/20250105000000.zip",), ("bad",)], "line string")
    assert readers.files_of_manifest(manifest, "line", r"(\d{14})", "2024-01-01", "2024-12-31").count() == 1
    spark.createDataFrame([(1, float("nan"))], "i int, x double").write.parquet(str(tmp_path / "n"))
    assert readers.read_parquet(spark, str(tmp_path / "n"), ["x"]).first()[0] is None
    assert readers.parquet_summary(spark, str(tmp_path / "n")).count() == 2
    (tmp_path / "d.csv").write_text("d,v\n2024-01-01,1\n2024-01-09,2\n")
    assert readers.read_csv_range(spark, str(tmp_path / "d.csv"), "d date, v int", "d", "2024-01-02", "2024-01-09").count() == 1


def test_contracts(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "k long, v double")
    got = {r["check"]: r["passed"] for r in contracts.all_checks([contracts.no_nulls(df, "v"), contracts.in_range(df, "v", 0, 10), contracts.unique_key(df, ["k"]), contracts.prevalence(df, "v", 0.1)]).collect()}
    assert got == {"no null in v": False, "v within 0 and 10": True, "unique k": True, "prevalence of v": True}
    assert contracts.prerequisites(spark, {"a": ["k"], "b": []}, {"a": df.drop("k")}) == ["b", "a.k"]
    assert contracts.id_type({"a": df}, "k") == {"a": True}


def test_conformal_empty_bin_takes_the_quantile_of_all(spark):
    df = spark.createDataFrame([(float(i), float(i) + 1) for i in range(5)] + [(20.0, 26.0)], "y double, m double")
    got = {r["bin"]: (r["n"], r["q"]) for r in conformal.fit(df, "y", "m", [0.0, 5.0, 10.0, 15.0], 0.1).collect()}
    assert got[0] == (5, 1.0) and got[3] == (1, 6.0) and got[1] == got[2] == (0, 6.0)
    inf = float("inf")
    assert conformal.quartile_edges(df, "y", log_scale=False) == [0.0, 1.0, 2.0, 3.0, 4.0, inf]
    logged = df.selectExpr("log1p(y) as y")
    assert conformal.quartile_edges(logged, "y") == pytest.approx([0.0, 1.0, 2.0, 3.0, 4.0, inf])
    assert conformal.quartile_edges(df.where("y < 4"), "y", log_scale=False) == conformal.quartile_edges(df.where("y < 0"), "y") == [0.0, 1.0, inf]
    assert conformal.quartile_edges(df.selectExpr("if(y > 3, null, y) as y"), "y", log_scale=False) == [0.0, 1.0, inf]


def test_bundles_close_in_three_steps():
    available = set("abcdefghz") | {"flag", "other_flag", "late"}
    close = lambda stable, two_way=(), rescue=(), guards=(): diagnostics.bundle_closure(set(stable), available, dict(two_way), dict(rescue), dict(guards))
    assert close("b", {"a": ["b", "c"]}) == ["a", "b", "c"]  # a sibling brings the column and the others
    assert close("d", {"c": ["d"], "b": ["c"]}) == ["b", "c", "d"]  # bundles are met once, in order
    assert close("d", {"b": ["c"], "c": ["d"]}) == ["c", "d"]
    assert close("a", rescue={"a": ["b"], "b": ["c"]}) == ["a", "b", "c"]  # chains
    assert close("b", rescue={"a": ["b"]}) == ["b"]  # one way only
    assert close("e", guards={"flag": {"e", "f"}, "other_flag": {"g"}}) == ["e", "flag"]  # not the family
    assert close("a", {"z": ["flag"]}, {"flag": ["b"]}, {"flag": {"a"}}) == ["a", "flag"]  # a flag brings nothing
    assert close("a", {"a": ["missing", "b"]}, {"b": ["gone", "c"]}, {"absent": {"a"}}) == ["a", "b", "c"]
    assert close(["unlisted"]) == ["unlisted"] and close("") == []


def test_linkage():
    rho = {("a", "b"): 0.95, ("b", "c"): 0.9, ("a", "c"): 0.2}
    groups = diagnostics.complete_linkage(["a", "b", "c"], rho, 0.85)
    assert sorted(map(sorted, groups)) == [["a", "b"], ["c"]]
    assert diagnostics.removal_candidates(groups, {"a": 1.0, "b": 2.0}) == ["a"]


def test_matrix_fails_on_unknown_columns():
    with pytest.raises(ValueError):
        matrix.resolve([matrix.Feature("x", "t")], {}, ["y"], [])


def test_registered_functions(spark):
    from tessella.functions.register import register_functions

    register_functions(spark)
    assert [r[0] for r in spark.sql("select * from year_range(2001, 2003)").collect()] == [2001, 2002, 2003]
    assert spark.sql("select normal_name('Sous-Prefecture de Élan (x)')").first()[0] == "elan x" and spark.sql("select normal_name(null)").first()[0] == ""
    assert spark.sql("select normal_name('Préfecture de X')").first()[0] == "prefecture de x"
    assert spark.sql("select quality_weight('one two three')").first()[0] == 0.1
    assert spark.sql("select ewm_last(v, 0.5) from values (4D), (4D), (null) t(v)").first()[0] == 2.0
    assert round(spark.sql("select haversine_km(0, 0, 0, 1)").first()[0], 1) == 111.2


def test_entities_are_resolved_by_tier(spark):
    places = spark.createDataFrame([("bangassou", 1), ("bambari", 2)], "place_name string, place int")
    units = [("admin2", spark.createDataFrame([("ouaka", 20)], "unit_name string, unit int")), ("admin1", spark.createDataFrame([("ouaka", 30), ("kemo", 31)], "unit_name string, unit int"))]
    names = spark.createDataFrame([("bambari",), ("bangasso",), ("ouaka",), ("kemo",), ("paris",), (None,)], "n string")
    got = {r["n"]: (r["place"], r["level"]) for r in joins.resolve_entities(names, "n", places, units, 85).collect()}
    assert got == {"bambari": (2, "exact"), "bangasso": (1, "fuzzy"), "ouaka": (20, "admin2"), "kemo": (31, "admin1"), "paris": (None, None), None: (None, None)}


def test_scales_and_breaks(spark):
    from tessella.functions import display

    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 50, 51, 99, 100)], "g int, v double")
    assert display.natural_breaks(df, "v", 3) == [3.0, 51.0, 100.0]
    assert [round(r[0], 2) for r in df.select(display.min_max("v", "g")).collect()][-1] == 1.0
    assert display.clipped(df, "v", "s").agg(F.max("s"), F.min("s")).first() == (1.0, 0.0)
    assert df.select(display.max_abs("v", "g").alias("m")).agg(F.max("m")).first()[0] == 1.0


def test_flags_columns_and_marginal(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0), (dt.date(2024, 1, 2), 1)], "date date, f int")
    assert contracts.structural_flags(df, ["f"]).first()["first_date"] == dt.date(2024, 1, 2)
    assert contracts.selected_columns(["a", "b_x", "c_x"], exclude=["c_x"], pattern="_x$") == ["b_x"]
    errors = spark.createDataFrame([(0.0, float(i)) for i in range(10)], "y double, m double")
    assert conformal.marginal(errors, "y", "m", 0.2).first()["q"] == pytest.approx(7.92)


def test_stability_selection(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.pmod(F.xxhash64("id"), F.lit(7))).cast("double").alias("b"), ((F.col("id") % 20) > 9).cast("double").alias("y"))
    got = diagnostics.stability_selection(df, ["a", "b"], "y", rounds=3)
    assert got["a"] == 1.0


def test_percent_ranks_of_a_whole_table(spark):
    from tessella.operators import windows

    df = spark.createDataFrame([(i, v) for i, v in enumerate((5, 5, 3, 1, 1, 1, None))], "i int, v int")
    one = df.withColumn("all", F.lit(0)).withColumn("s", windows.average_percent_rank("v", "all"))
    assert {r["i"]: r["s"] for r in windows.average_percent_ranks(df, "v", "s").collect()} == {r["i"]: r["s"] for r in one.collect()}


@pytest.mark.parametrize("limit", [0, 10_000])
def test_nearest_point_meets_each_place_once(spark, limit, monkeypatch):
    met, best = [], spatial._best
    monkeypatch.setattr(spatial, "_best", lambda pairs, *a: met.append(pairs.count()) or best(pairs, *a))
    cells = spark.range(600).select(F.col("id").alias("c"), (F.col("id") % 3).cast("double").alias("lat"), (F.col("id") % 2).cast("double").alias("lon"))
    points = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 4).cast("double").alias("plat"), F.lit(0.0).alias("plon"), (F.col("id") + 1).alias("k"))
    got = {r["c"]: (r["p"], r["k"], r["planar"]) for r in spatial.nearest_point(cells, points, "c", "p", ["k"], limit=limit).collect()}
    assert got == {c: (c % 3, c % 3 + 1, float(c % 2)) for c in range(600)}
    assert sum(met) <= 3 * 6 * 4
