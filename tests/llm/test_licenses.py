from tessella.llm import licenses


def scan(docs, texts):
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs(texts)).collect()}


def test_phrases_and_places(docs):
    got = scan(docs, {1: "MIT  License; mit-license x", 2: "the General Public\nLicense", 3: "general license public", 4: "permit license mit licenses", 5: "apache license"})
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["n_words"]) == (2, 0, 2, "mit", 5)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["labels"]) == (1, 1, "gpl")
    assert all((got[i]["n_base"], got[i]["first_word"], got[i]["labels"], got[i]["score"]) == (0, None, "", 0.0) for i in (3, 4))
    assert got[5]["base_labels"] == "apache"


def test_notice_with_changed_words(docs):
    words = dict((label, w) for _, label, base, w in licenses.templates() if not base)["bsd"]
    changed = [*words[:5], "really", *words[5:]]
    got = scan(docs, {1: " ".join(words), 2: "x " + " ".join(changed), 3: " ".join(words[:6])})
    assert (got[1]["labels"], got[1]["score"]) == ("bsd", 1.0)
    assert got[2]["labels"] == "bsd" and got[2]["score"] < 1 and got[2]["n_base"] == 0
    assert got[3]["labels"] == ""


def test_odd_rows(odd):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[i]["n_words"] for i in (2, 3, 4, 7)] == [0, 0, 0, 0] and by_id[5]["n_words"] == 120_000
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_one_word(docs):
    assert scan(docs, {1: "mit"})[1]["n_words"] == 1
