import random

import numpy as np

from tessella.llm import decontamination as D


def brute(words, items, window=13):
    hit, found = set(), set()
    for item, text in items:
        own = D.words_of(text)
        k = min(window, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return hit, found


def test_equals_brute_force(spark, docs):
    rng = random.Random(4)
    texts, items = {}, {}
    for i in range(120):
        texts[i] = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))
    for i in range(25):
        items[i] = " ".join(rng.choice("abcd") for _ in range(rng.choice((0, 1, 5, 9, 13, 14, 30)))) if i % 3 else " ".join(texts[i].split()[i : i + 20])
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r["doc_id"]: r for r in D.contamination(docs(texts), table).collect()}
    for i, t in texts.items():
        hit, found = brute(D.words_of(t), list(items.items()))
        assert (got[i]["n_hit"], got[i]["items"], got[i]["n_words"]) == (len(hit), sorted(map(str, found)), len(t.split()))


def test_every_shared_window_shares_a_fingerprint():
    rng = random.Random(6)
    for _ in range(300):
        span = [b"%d" % rng.randrange(5) for _ in range(13)]
        prints = [set(D.prints_of(D.word_ids([b"%d" % rng.randrange(5) for _ in range(rng.randrange(9))] + span + [b"x"] * rng.randrange(9)), 13)[1].tolist()) for _ in range(2)]
        assert prints[0] & prints[1]


def test_a_full_filter_changes_nothing(spark, docs, monkeypatch):
    text = " ".join(f"w{i}" for i in range(200))
    items = spark.createDataFrame([(f"i{i}", " ".join(text.split()[i * 9 : i * 9 + 20])) for i in range(12)] + [("n", None), ("e", ""), (None, text)], "item_id string, text string")
    df = docs({1: text, 2: "nothing of it", 3: "x " + " ".join(text.split()[5:18])})
    monkeypatch.setattr(D, "print_filter", lambda prints: np.full(16, 255, np.uint8))
    got = {r["doc_id"]: r for r in D.contamination(df, items).collect()}
    # By the contract a word inside any occurrence of a window is hit, so the item without id hits all 200; it was 119 when such items were left out.
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (200, 12, True)
    assert (got[3]["n_hit"], got[3]["items"], got[2]["n_hit"]) == (13, ["i0"], 0)


def test_short_items_and_the_share(spark, docs):
    items = spark.createDataFrame([(1, "One two!")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in D.contamination(docs({1: "one-TWO", 2: "one x two", 3: "one two " + "z " * 38, 4: "one two " + "z " * 39}), items).collect()}
    assert got == {1: (2, True), 2: (0, False), 3: (2, True), 4: (2, False)}


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "plain words that stand here")], "item_id long, text string")
    got = D.contamination(odd, items).collect()
    assert len(got) == odd.count() and sum(r["contaminated"] for r in got) == 2
    assert D.decontaminate(odd, items).columns == odd.columns
    assert D.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert D.contamination(odd.limit(0), items).count() == 0


def test_items_without_id_are_hit_but_not_counted(spark, docs):
    span = " ".join(f"w{i}" for i in range(15))
    items = [(None, span), (None, "lone"), (3, f"{span} w15"), (4, None), (None, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in D.contamination(docs({1: f"x {span} y", 2: "a lone word", 3: f"{span} w15", 4: None}), table).collect()}
    assert got == {1: (15, 1, ["3"]), 2: (1, 0, []), 3: (16, 1, ["3"]), 4: (0, 0, [])}
    only = spark.createDataFrame(items[:2], "item_id long, text string")
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in D.contamination(docs({1: span}), only).collect()] == [(15, 0, True)]
