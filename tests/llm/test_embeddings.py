import duckdb
import numpy as np
import pytest

from tessella.llm import embeddings, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    fine = {i: (np.asarray(v, float) / np.abs(v).max(), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.sqrt(v @ v), lab) for i, (v, lab) in fine.items()}
    links = {i: {j for j, (w, m) in unit.items() if j != i and m == lab and len(w) == len(v) and v @ w >= cosine} for i, (v, lab) in unit.items()}
    root = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        new = {i: min([root[i], *(root[j] for j in links.get(i, ()))]) for i in root}
        changed, root = new != root, new
    return {i: (len(links.get(i, ())), root[i]) for i in root}


def planted(n, size, seed=3, classes=3):
    """n vectors: clusters of about 12 with noise that puts many pairs on either side of the threshold, and single ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, size))
    return [(i, [float(x) for x in np.float32(centres[i % len(centres)] + rng.normal(scale=rng.choice([0.05, 0.2, 1.0]), size=size))], int(i % len(centres) % classes)) for i in range(n)]


def links_of(rows, cosine=0.93):
    """vec_id to the number of its links, by all products of a label."""
    out = {}
    for lab in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lab]
        x = np.array([r[1] for r in own])
        x /= np.sqrt((x * x).sum(1))[:, None]
        out |= dict(zip([r[0] for r in own], ((x @ x.T >= cosine).sum(1) - 1).tolist()))
    return out


@pytest.mark.parametrize(("n", "size"), [(2_000, 8), (2_000, 64), (20_000, 32)])
def test_recall(spark, n, size):
    rows = planted(n, size)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = links_of(rows)
    assert sum(want.values()) > n
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_query_on_vectors_with_links(spark, tmp_path):
    rows = planted(600, 24) + [(2000 + i, planted(600, 24)[0][1], 0) for i in range(50)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select vec_id, n_links, component_id, kept from ({queries.ORACLE_SQL['op4_embedding_near_dedup']})").fetchall()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op4_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert want == got and sum(w[0] for w in want.values()) > 3000


def test_double_vectors_and_text_labels(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], "a"), (2, [1e300, 1.0], "a"), (3, [1e-300, 0.0], "a"), (4, [1e300, 0.0], "b"), (5, [-1e300, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_blocks_find_what_one_list_finds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32([5, 0, 0] + rng.normal(scale=0.3, size=3))], 1) for i in range(300)]
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(1, same, 1), (2, same, 1), (3, same, 2), (4, same, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1), (8, [float("nan"), 1.0, 1.0], 1), (9, [float("inf"), 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0, -3.0], 1), (None, same, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("kept", embeddings.F.lit(1))).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[11] == (1, 11, True) and got[12] == (1, 11, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13, None))
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_count_as_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], SCHEMA)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
