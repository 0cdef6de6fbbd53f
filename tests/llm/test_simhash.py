import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessella.llm import components, queries, simhash
from tests.conftest import SMALL
from tessella.session import table


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: id to fingerprint."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 2):
            x, y = find(i), find(ids[j])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op1_simhash"](spark, SMALL).collect()}
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in table(spark, SMALL, "documents").collect()}
    want = plain_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i, j in combinations(range(64), 2))


def test_links_connect_exactly_what_is_within_two_bits(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 3)))) for c in centres for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(df), "fp", "least").collect()}
    want = plain_components({simhash.signed(p): p for p in prints})
    assert {p: roots.get(simhash.signed(p), simhash.signed(p)) for p in prints} == {p: want[simhash.signed(p)] for p in prints}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == dict.fromkeys(range(301), 0)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert {(i, c) for i, fp, c in rows if fp == 0} == {(2, 2), (3, 2), (4, 2)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_empty(spark, odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 == simhash.similar_documents(odd.limit(0)).count() == simhash.drop_near_duplicates(odd.limit(0)).count()


def plain_similar(texts):
    """id to component, by the Jaccard similarity of all pairs of five-word sets."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(sorted(sets), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("rows", [simhash.BUCKET_ROWS, 8])
def test_stage_links_all_of_similarity_and_nothing_else(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for _ in range(8):
        old = rng.choices(words, k=rng.choice((12, 60, 300)))
        for _ in range(45 if len(texts) < 45 else 9):
            new = list(old)
            for k in rng.sample(range(len(new)), rng.randint(0, max(2, len(new) // 30))):
                new[k] = rng.choice(words)
            texts[len(texts)] = " ".join(new)
    texts |= {900: None, 901: "", 902: "two words", 903: "Two  Words", 904: "three more words"}
    want = plain_similar(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(texts)).collect()}
    assert got == want
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs(texts)).collect()} == set(want.values())


def test_stage_drops_near_copies_beyond_two_bits(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL.replace("0.001", "0.01"), "documents").collect() if r["doc_id"] in (2, 56)}
    assert (simhash.fingerprint(texts[2]) ^ simhash.fingerprint(texts[56])).bit_count() > 2
    both = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(both).collect()] == [2]


def test_wide_sketches_never_understate_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m, both = rng.integers(1, 3000, 3)
        both = min(n, m, both)
        x = rng.integers(-(2**62), 2**62, n)
        y = np.concatenate((x[:both], rng.integers(-(2**62), 2**62, m - both)))
        assert simhash.most_overlap(simhash.wide_sketch(x), simhash.wide_sketch(y), n, m) >= both
    assert simhash.most_overlap(simhash.wide_sketch(x), simhash.wide_sketch(-x), n, n) < 0.6 * n


def test_documents_that_only_share_phrases_do_not_meet(spark, docs):
    rng = random.Random(11)
    phrases = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(6)]
    texts = {d: " ".join([rng.choice(phrases), *(f"d{d}w{i}" for i in range(120))]) for d in range(240)}
    bits = simhash.group_bits(len(texts))
    sets = simhash.shingle_prints(docs(texts), 5, simhash.n_sketches(bits, 0.8))
    links = simhash.met_members(sets, bits, 0.8).where("least is not null or before is not null")
    assert links.count() < len(texts)


def test_recall_at_the_least_similarity(spark, docs):
    rng = random.Random(12)
    texts = {}
    for k in range(0, 400, 2):
        words = [f"w{rng.randrange(100_000)}" for _ in range(rng.choice((60, 150, 400)))]
        texts[k] = " ".join(words)
        for i in range(rng.randrange(7), len(words), 48):
            words[i] = "new"
        texts[k + 1] = " ".join(words)
    want = plain_similar(texts)
    near = [i for i, c in want.items() if c != i]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(texts)).collect()}
    assert len(near) > 50 and sum(got[i] == want[i] for i in near) >= 0.95 * len(near)
    assert all(got[i] in (i, want[i]) for i in texts)


def test_copies_that_are_just_not_similar_make_few_pairs(spark, docs, monkeypatch):
    rng = random.Random(13)
    base = [f"b{i}" for i in range(200)]
    texts = {}
    for d in range(150):
        words = list(base)
        for k in rng.sample(range(200), 4):
            words[k] = f"d{d}w{k}"
        texts[d] = " ".join(words)
    judged, judge = [], simhash.judge
    monkeypatch.setattr(simhash, "judge", lambda pairs, *rest: judged.append(pairs.count()) or judge(pairs, *rest))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs(texts)).collect()} == plain_similar(texts)
    assert sum(judged) <= 3 * len(texts)  # of 11,175


def test_keys_grow_with_the_rows():
    for rows in (3_000, 51_282, 256_410, 10**6, 10**7, 10**8):
        bits = simhash.group_bits(rows)
        kept = max(m.bit_count() for m in simhash.covering_masks(2, bits))
        assert rows * 2**simhash.SPARSE / 2 <= 2**kept <= rows * 2**simhash.SPARSE * 4


def test_bits_that_may_differ_hold_for_small_sets():
    rng = np.random.default_rng(4)
    limits = simhash.most_bits(0.8)
    for n, m, both in ((4, 5, 4), (9, 9, 8), (12, 15, 12), (13, 14, 12), (90, 90, 80), (500, 500, 445)):
        for _ in range(100):
            own = rng.integers(-(2**63), 2**63 - 1, n + m - both)
            x, y = (simhash.set_prints(np.unique(s), simhash.WIDE).view(np.uint64) for s in (own[:n], own[n - both :]))
            assert np.bitwise_count(x ^ y).sum() <= limits[min(n, m, simhash.SMALL_SETS)]
