import zlib

from tessella.llm import language, queries
from tests.conftest import SMALL
from tessella.session import table


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_lengths_are_those_of_the_recursion():
    text = "abracadabra abracadabra"
    s = language.symbols_of(text)
    codes = language.contexts_of(s).astype("int64") * language.SYMBOLS + s[language.ORDER :]
    trees = language.Trees({"x": language.summed(codes, None)}, min_seen=1)
    seq = s.tolist()

    def p(context, symbol):
        after = [seq[i] for i in range(language.ORDER, len(seq)) if tuple(seq[i - len(context) : i]) == context]
        shorter = 1 / language.SYMBOLS if not context and not after else None
        if not after:
            return p(context[1:], symbol) if context else shorter
        n, u = len(after), len(set(after))
        if symbol in after:
            return after.count(symbol) / (n + u)
        return u / (n + u) * (p(context[1:], symbol) if context else 1 / language.SYMBOLS)

    import math

    other = language.symbols_of("cadabra zebra").tolist()
    want = -sum(math.log2(p(tuple(other[i - 3 : i]), other[i])) for i in range(3, len(other)))
    assert abs(trees.lengths("cadabra zebra")["x"] - want) < 1e-3


def test_odd_rows(odd):
    got = language.language_id(odd).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if not r["text"] or not any(c.isalpha() for c in r["text"]))
    nothing = language.language_id(odd.withColumn("lang", language.F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.language_id(odd.limit(0)).count() == 0


def test_passes_and_query_equal_plain_comparison(spark):
    docs = table(spark, SMALL, "documents")
    grams = language.count_grams(docs.where(~language.held_out()))
    trees = language.Trees(grams)
    want = {}
    for r in docs.collect():
        bits = trees.lengths(r["text"])
        best = min(bits, key=lambda lang: (bits[lang], lang))
        want[r["doc_id"]] = (best, round(1 / sum(2.0 ** -min(b - bits[best], 1000) for b in bits.values()), 9))
    for got in (language.identify(docs, grams), language.identify(docs, grams, a_pass=1), queries.QUERIES["op6_language_id"](spark, SMALL)):
        assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in got.collect()} == want


def test_numbers_are_no_letters(spark, docs):
    got = language.language_id(docs({1: "½ ² ①", 2: "3.5 !", 3: "ª", 4: "ein Wort"})).collect()
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in got} == {1: True, 2: True, 3: False, 4: False}
