from tessella.llm import queries, substrings
from tests.conftest import SMALL
from tessella.session import table


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_substring_dedup"](spark, SMALL).collect()}
    seen = set()
    for r in sorted(table(spark, SMALL, "documents").collect(), key=lambda r: r["doc_id"]):
        text, gone = "", []
        for a, b, digest in substrings.units(r["text"]):
            if digest in seen:
                gone.append(f"{a}:{b}")
            else:
                text += r["text"][a:b]
            if digest:
                seen.add(digest)
        assert (got[r["doc_id"]]["text"], got[r["doc_id"]]["removed_spans"]) == (text, ",".join(gone))


def test_what_goes_stood_before_and_the_rest_stays(spark):
    """Without the library's own units: removed words stand in a row earlier in the corpus, and text less removed spans is what stays."""
    rows = sorted(table(spark, SMALL, "documents").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_substring_dedup"](spark, SMALL).collect()}
    before, removed = " ", 0
    for r in rows:
        text, out, at = r["text"], "", 0
        for a, b in (map(int, s.split(":")) for s in got[r["doc_id"]]["removed_spans"].split(",") if s):
            own = " ".join(text[a:b].lower().split())
            assert f" {own} " in before + " ".join(text[:a].lower().split()) + " "
            out, at, removed = out + text[at:a], b, removed + 1
        assert got[r["doc_id"]]["text"] == out + text[at:]
        before += " ".join(text.lower().split()) + " \x00 "
    assert removed > 50


def test_rows_of_one_id_with_other_texts(docs):
    one, two = "the first text of this id stands here", "the second text of this id stands here"
    got = [(r["text"], r["n_removed"]) for r in substrings.dedup_substrings(docs([(1, one), (1, two), (1, one), (2, two)])).collect()]
    assert sorted(got) == sorted([(one, 0), (one, 0), (two, 0), ("", 1)])
    assert substrings.text_mark("é x") == docs([(1, "é x")]).selectExpr("xxhash64(text) as h").first()["h"]


def test_units_leave_nothing_out():
    for text in ("", "a", "one two three four five. Six seven. eight nine ten.\r\n\nlast", "x. y. z. w. v. u. t. s.", "\n\n"):
        parts = list(substrings.units(text))
        assert "".join(text[a:b] for a, b, _ in parts) == text


def test_passages_inside_lines_and_case(docs):
    passage = "The passage that stands twice is long enough. And it has a second sentence of its own."
    got = {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed"]]) for r in substrings.dedup_substrings(docs({1: f"First text that is here. {passage} End.", 2: f"Second one that differs here. {passage.upper()} Tail of it here now."})).collect()}
    assert got[1][1] == []
    assert got[2] == ("Second one that differs here. Tail of it here now.", [(30, 76), (76, 117)])


def test_odd_rows(odd):
    got = substrings.dedup_substrings(odd)
    assert got.count() == odd.count()
    assert sorted(r["text"] is None for r in got.collect()) == [False] * 9 + [True]
    assert {r["n_removed"] for r in got.where("doc_id = 1").collect()} == {0}
    assert substrings.dedup_substrings(odd.limit(0)).count() == 0


def repeated_words(texts, n=50):
    """For each text, whether each word is in a span of n words that stands in an earlier text."""
    seen, marks = set(), []
    for text in texts:
        words = text.lower().split()
        mark, own = [False] * len(words), []
        for i in range(len(words) - n + 1):
            span = hash(tuple(words[i : i + n]))
            own.append(span)
            if span in seen:
                mark[i : i + n] = [True] * n
        seen.update(own)
        marks.append(mark)
    return marks


def test_a_long_sentence_behind_other_words_is_found(docs):
    sentence = " ".join(f"word{i * i % 997}" for i in range(60)) + "."
    for first, second in (("Yes. ", "No. "), ("He said that ", "Nobody had ever heard before that "), ("", "One two three four five six. But ")):
        got = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(docs({1: first + sentence, 2: second + sentence})).collect()}
        assert got[1] == first + sentence
        assert len(got[2].split()) <= len(second.split()) + 24, (first, second)


def test_spans_of_50_words_leave_little(spark):
    rows = sorted(table(spark, SMALL.replace("0.001", "0.01"), "documents").collect(), key=lambda r: r["doc_id"])
    marks = repeated_words([r["text"] for r in rows])
    seen, of, stay = set(), 0, 0
    for r, mark in zip(rows, marks):
        k = 0
        for a, b, digest in substrings.units(r["text"]):
            n = len(r["text"][a:b].split())
            of += sum(mark[k : k + n])
            stay += sum(mark[k : k + n]) if digest is None or digest not in seen else 0
            seen.add(digest)
            k += n
    assert of > 1000 and stay < 0.07 * of


def test_cuts_are_the_places_that_marks_set_and_only_they_are_looked_up(monkeypatch):
    import random
    import zlib

    from tessella.llm import substrings as S

    rng = random.Random(4)
    for n in (0, 5, 16, 17, 60, 400):
        text = "".join(rng.choice(("Ab", "İx", "ΣΑΣ", "w", "\ud800", "é")) + rng.choice((" ", "\x85", "  ", "\x1c")) for _ in range(n))
        words = [(m.start(), m[0].lower().encode("utf-8", "surrogatepass")) for m in S._word.finditer(text)]
        marks = [zlib.crc32(b" ".join(w for _, w in words[i : i + 2])) for i in range(n)]
        near = S.REACH - 1
        want = [words[i][0] for i in range(S.REACH, n - S.REACH) if n > 2 * S.REACH and marks[i] < min(marks[i - near : i]) and marks[i] <= min(marks[i + 1 : i + S.REACH])]
        assert S.inner_cuts(text, 0, len(text)) == want
    monkeypatch.setattr(S, "_word", None)
    assert S.inner_cuts("a sentence of few words", 0, 23) == []
