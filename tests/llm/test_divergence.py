"""The audit against plain counting, and its selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(docs, min_docs, top):
    """docs: (text, lang, source)."""
    n, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in in_docs[lang].items() if k >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((n[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


def same(spark, docs, min_docs=2, top=3):
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "p", "q", "item", "value", "idx", "_at", "_n", "bucket", "total")})
    assert sorted(tuple(r) for r in divergence.audit(df.repartition(3), min_docs, top).select(*COLUMNS).collect()) == plain(docs, min_docs, top)


def made(n, langs, sources, seed):
    rng = random.Random(seed)
    words = [w for k in range(12) for w in (f"w{'abcdefghijkl'[k]}", f"É{'abcdefghijkl'[k]}", f"MiX{'abcdefghijkl'[k]}")]
    docs = [(" ".join(rng.choices(words, weights=[1 + i % 7 for i in range(len(words))], k=rng.randint(0, 12))), rng.choice(langs), rng.choice(sources)) for _ in range(n)]
    return docs + docs[: n // 10]


def test_odd_rows(spark):
    docs = made(120, ["en", "fr", None, ""], ["a", "b", None, "ü", "Z"], 1)
    docs += [(None, "en", "a"), ("", None, "only"), ("1 2 3 _ ?!", "xx", "one"), ("alone in its language", "yy", "one"), ("deux mots", "zz", "p"), ("trois mots", "zz", "q"), ("Ä ä A a😀b c", "zz", "q"), ("wort " * 5000 + "zeile-Zeile ZEILE", "en", "a")]
    same(spark, docs)


def test_blocks_of_sources_chunks_of_pairs_and_many_ties(spark, monkeypatch):
    for name, value in {"SIDE": 3, "BUCKETS": 4, "PAIRS": 7, "TIES": 2, "HELD": 20}.items():
        monkeypatch.setattr(divergence, name, value)
    same(spark, made(150, ["en", "de"], [f"s{i}" for i in range(8)], 2), top=5)


def test_no_rows(spark):
    same(spark, [])


@pytest.mark.parametrize("ties", [1, 1000])
def test_selection(spark, monkeypatch, ties):
    monkeypatch.setattr(divergence, "TIES", ties)
    rng = random.Random(5)
    rows = [(g, rng.choice([0, 1, 5, 1023, 1024, 2**20, 2**30 - 1]), rng.choice([b"", b"ab" * 20, b"\xff"]) + b"x" * (i % 4) + str(i).encode()) for i in range(400) for g in ("a", "b" if i % 50 == 0 else "c")]
    rows += [("t", 7, b"p" * 30 + bytes([x, y])) for x in range(5) for y in range(5)] + [("t", 7, b"p" * 30), ("t", 9, b"q")]
    got = divergence.radix_top(spark.createDataFrame(rows, "g string, value long, item binary"), ["g"], 12)
    expected = []
    for g in "abct":
        own = sorted(((v, i) for h, v, i in rows if h == g), key=lambda x: (-x[0], x[1]))[:12]
        expected += [(g, v, i, r) for r, (v, i) in enumerate(own, 1)]
    assert sorted((r["g"], r["value"], bytes(r["item"]), r["rank"]) for r in got.collect()) == sorted(expected)


def test_shares_of_large_counts(spark):
    cases = [(2, 1), (2, 0), (9 * 10**15 - 1, 9 * 10**15), (123_456_789_012_345, 987_654_321_098_765), (2, 9 * 10**15), (7, 7)]
    df = spark.createDataFrame(cases, "a long, b long").select("a", "b", divergence.share(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        if r["a"] <= r["b"]:
            assert r["p"] == 1 + 10**9 * r["a"] // r["b"]
        elif r["b"] == 0:
            assert r["p"] == 1
