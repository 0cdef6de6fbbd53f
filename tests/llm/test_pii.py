import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import pii, queries
from tests.conftest import SMALL
from tessella.session import table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = [int(c) for c in s if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0]))


def test_query_equals_regular_expressions(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_pii"](spark, SMALL).collect()}
    for r in table(spark, SMALL, "documents").collect():
        want = base(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(got[r["doc_id"]]["spans"].split(","))


def test_awkward_texts(spark, docs):
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1 2", "a.b@c.de", "a@b.c_x@d.e", "@x.y", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0255.001.2.3", "x" * 50, "1" * 25, "é😀", "12 34", "+", "a@b.c-d.e.", "00000000000000", "1.2.3", "+49.30.1234567"]
    texts = {}

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.sampled_from(parts), max_size=8), st.sampled_from(["", " ", "-", ".", "\n"]))
    def collect(chosen, joiner):
        texts[len(texts)] = joiner.join(chosen)

    collect()
    got = {r["doc_id"]: r for r in pii.personal_data(docs(texts)).collect()}
    for i, t in texts.items():
        assert got[i]["base_sha256"] == hashlib.sha256(base(t).encode()).hexdigest(), t


def test_patterns_do_not_backtrack(docs):
    texts = {1: "1 " * 200_000, 2: "a" * 300_000 + "@", 3: "x.y" * 100_000, 4: "+1" + "-" * 200_000, 5: "1." * 150_000, 6: "@" * 200_000}
    assert pii.personal_data(docs(texts)).count() == 6


def test_context_discovers_unseen_identifiers(docs):
    seen = {i: f"words here customer number is user{i}@mail{i}.org today and more" for i in range(12)}
    more = {20: "words here customer number is AB-99887766 today and more", 21: "nothing near ZZ-11223344 of that kind"}
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(seen | more)).collect()}
    assert got[20] == "email:30:41" and got[21] == ""


def test_secrets_come_from_their_contexts(docs):
    rng = random.Random(2)
    key = lambda: f"{rng.getrandbits(160):040x}"
    planted = {i: f'x{i} token = "{key()}" and so on' for i in range(40)} | {40: "and password=Tr0ub4dor12 here", 41: '{"api_key": "zz-778899"}'}
    clean = {100 + i: f"commit {key()} of file {key()} with page {rng.randrange(10**7)}" for i in range(40)}
    got = {r["doc_id"]: r for r in pii.personal_data(docs(planted | clean)).collect()}
    assert all(got[i]["spans"].startswith("secret:") for i in planted) and not any(got[i]["spans"] for i in clean)
    assert got[40]["spans"] == "secret:13:24" and got[41]["spans"] == "secret:13:22"
    assert got[3]["spans"] == "secret:12:52" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_contexts_reach_over_earlier_matches(spark, docs):
    rows = pii.raw_spans(docs({1: "to a@b.cd e@f.gh, i@j.kl now"}), ("doc_id",)).where("kind = 'email'").orderBy("start").collect()
    assert [(r["left"], r["right"]) for r in rows] == [("to ", " e@f.gh"), ("to a@b.cd ", ", i@j.kl"), ("to a@b.cd e@f.gh, ", " now")]


def plain_graph(edges):
    """instance to kind, from (pattern, instance, seed or None), by plain loops."""
    size, known = Counter(p for p, _, _ in set(edges)), {}
    given = {p for p, _, s in edges if s is None and re.search(pii.SEED_PATTERN, p)}
    while True:
        confidence = {}
        for p in size:
            scores = {}
            for q, i, s in set(edges):
                if q == p:
                    for kind, score in [(s, 1.0)] if s else known.get(i, {}).items():
                        scores.setdefault(kind, []).append(score)
            confidence[p] = {k: sum(v) / (size[p] + 1) for k, v in scores.items() if len(v) >= pii.MIN_SEEDS and sum(v) / (size[p] + 1) >= pii.MIN_CONFIDENCE}
            if p in given:
                confidence[p][pii.SECRET] = max(confidence[p].get(pii.SECRET, 0), pii.SEED_CONFIDENCE)
        new = {}
        for i in {i for _, i, s in edges if s is None}:
            for kind in {k for c in confidence.values() for k in c}:
                miss = 1.0
                for p in {p for p, j, s in edges if j == i and s is None}:
                    miss *= 1 - confidence[p].get(kind, 0)
                if 1 - miss >= pii.ACCEPT:
                    new.setdefault(i, {})[kind] = 1 - miss
        if sum(map(len, new.values())) == sum(map(len, known.values())):
            return {i: max(kinds, key=lambda k: (kinds[k], k)) for i, kinds in new.items()}
        known = new


def test_graph_equals_plain_loops(spark):
    rng = random.Random(8)
    edges = set()
    for chain in range(6):  # what one step accepts makes the next step's patterns confident
        for step in range(5):
            for i in range(8):
                for k in range(2):
                    edges.add((f"2:p{chain}-{step}-{k}", f"{chain}-{step}-{i}" if step else f"s{chain}-{i}", None if step else "email"))
                    edges.add((f"2:p{chain}-{step}-{k}", f"{chain}-{step + 1}-{i % 3}", None))
    edges |= {("2:x token =", f"t{i}", None) for i in range(3)} | {(f"2:r{rng.randrange(9)}", f"n{i}", rng.choice((None, "ip"))) for i in range(60)}
    want = plain_graph(edges)
    assert len(want) > 20
    df = spark.createDataFrame(sorted(edges, key=str), "pattern string, instance string, seed string")
    assert {r["instance"]: r["kind"] for r in pii.score_graph(df).collect()} == want


def test_redaction(docs):
    texts = {1: "mail a@b.cd and +1 (555) 123-4567.", 2: None, 3: "clean", 4: "é😀 a@b.cd", 5: ""}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs(texts)).collect()}
    assert got == {1: ("mail [EMAIL] and [PHONE].", 25), 2: (None, 0), 3: ("clean", 5), 4: ("é😀 [EMAIL]", 10), 5: ("", 0)}


def test_odd_rows(odd):
    assert pii.personal_data(odd).count() == odd.count() == pii.redact(odd).count()
    assert pii.redact(odd).columns == odd.columns
    assert pii.personal_data(odd.limit(0)).count() == 0 == pii.redact(odd.limit(0)).count()
