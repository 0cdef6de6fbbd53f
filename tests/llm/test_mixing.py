from tessella.llm import mixing


def totals(df):
    out = {}
    for r in df.collect():
        s = out.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    return out


def test_targets_are_met_exactly(docs):
    texts = {i: "w " * (1 + i * 7 % 23) for i in range(400)}
    got = totals(mixing.mix(docs(texts, source={i: f"s{i % 5}" if i < 390 else None for i in texts})))
    assert all(round(target) == taken for _, taken, target in got.values())
    size = sum(s for s, _, _ in got.values())
    assert abs(sum(t for _, _, t in got.values()) - size) < 1e-6


def test_caps_are_reshared(docs):
    texts = {1: "w " * 10, 2: "w " * 1000, 3: "w " * 2000, 4: "w " * 500}
    got = totals(mixing.mix(docs(texts, source={1: "a", 2: "b", 3: "c", 4: "d"})))
    assert got["a"] == [10, 30, 30.0]
    rest = 3510 - 30
    want = {"b": rest * 2 / 8, "c": rest * 1 / 8, "d": 1500.0}
    left = rest - 1500
    want |= {"b": left * 2 / 3, "c": left / 3}
    assert all(abs(got[s][2] - w) < 1e-6 for s, w in want.items())


def test_reruns_and_partitionings_agree(docs):
    texts = {i: "w " * (1 + i % 9) for i in range(200)}
    df = docs(texts, source={i: f"s{i % 3}" for i in texts})
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(x).collect()) for x in (df, df.repartition(7)))
    assert a == b


def test_equal_ids_and_equal_rows_meet_the_target(spark, docs):
    some = [(i, "w " * 10) for i in range(60)]
    for rows in (
        [(None, "w " * 19) for _ in range(100)],
        [(7, f"a{i} " * 19) for i in range(100)],
        [(None, f"a{i} " * (1 + i % 30)) for i in range(100)],
        [(7, "w " * 19) for _ in range(100)],
    ):
        df = docs(rows).withColumn("source", mixing.F.lit("s2")).unionByName(docs(some).withColumn("source", mixing.F.lit("s1"))).unionByName(docs(some[:30]).withColumn("source", mixing.F.lit("s3")))
        got = totals(mixing.mix(df))
        assert mixing.mix(df).count() == df.count()
        assert all(round(target) == taken for _, taken, target in got.values())
        slim = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(df, with_text=False).collect())
        assert slim == sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix(df.repartition(5)).collect())


def test_odd_rows(odd):
    got = mixing.mix(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if not r["text"] or not r["text"].strip())
    assert mixing.mix(odd.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(odd.where("doc_id in (2, 3, 4)")).collect()} == {0}
