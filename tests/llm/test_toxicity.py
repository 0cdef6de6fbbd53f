import math
import random
import re

import pytest

from tessella.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    from tests.llm.conftest import make_docs

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts, labels = {}, []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad, junk = i % 6 == 0, i % 10 == 3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "xyzz" + word())
        texts[i] = " | ".join(words) if junk else " ".join(words)
        if i < 450:
            labels.append((i, 0 if junk else 1, int(bad)))
    return make_docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_unlabelled_documents(corpus):
    docs, labels = corpus
    got = {r["doc_id"]: (r["is_toxic"], r["p_low_quality"] > 0.5) for r in toxicity.toxicity(docs, labels).where("doc_id >= 450").collect()}
    assert sum(got[i][0] == (i % 6 == 0) for i in got) >= 0.97 * len(got)
    assert sum(got[i][1] == (i % 10 == 3) for i in got) >= 0.97 * len(got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 490 <= kept.count() <= 510


def test_chain_feeds_earlier_probabilities(corpus):
    chain = toxicity.fit_chain(*corpus)
    assert chain.names == ["low_quality", "toxic"]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_odd_rows(spark, corpus, odd):
    got = toxicity.toxicity(odd, corpus[1].limit(0))
    assert got.count() == odd.count() and not any(r["is_toxic"] for r in got.collect())
    got = toxicity.toxicity(odd, spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 0, 0), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = got.collect()
    assert len(rows) == odd.count() and not any(r["is_toxic"] for r in rows if not r["text"])
    assert set(got.columns) - set(odd.columns) == {"p_low_quality"}
    assert toxicity.drop_toxic(odd.limit(0), corpus[1]).count() == 0


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize(("n", "classes"), [(1, 1), (2, 2), (3, 2)])
def test_few_labelled_rows_in_one_fold(spark, docs, n, classes):
    same = {i: "words that stand here as they are" for i in range(3)}  # equal texts are in one fold
    labels = [(i, i % classes, (i + 1) % classes) for i in range(n)]
    got = toxicity.toxicity(docs(same), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3 and all(0 <= r["p_toxic"] <= 1 for r in got)


def test_conflicting_labels_and_repeated_documents(spark, docs):
    df = docs([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, None)])
    sample = toxicity.labelled_sample(df, spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (3, 0, 1)], LABELS), toxicity.CATEGORIES, 100)
    assert sorted((r["text"], r["y_low_quality"], r["y_toxic"]) for r in sample.collect()) == [("a", 1, 1), ("c", 0, 0)]


def test_probabilities_equal_the_plain_sums(spark, corpus):
    docs, labels = corpus
    chain = toxicity.fit_chain(docs, labels)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for r in toxicity.score(docs.where("doc_id % 29 = 0"), chain).collect():
        words = set(re.findall(r"[a-z0-9]+", r["text"].lower()))
        present = [float(any((w if not k else w[:k]) == f.decode() for w in words)) for k, f in chain.features]
        text = r["text"]
        own = re.findall(r"[a-z0-9]+", text)
        shares = [0.0, text.count("|") / len(text), 0.0, 0.0, sum(a == b for a, b in zip(own, own[1:])) / len(own), 0.0]
        x = present + shares
        first = sigmoid(sum(w * v for w, v in zip(chain.weights[0], x)) + chain.biases[0])
        second = sigmoid(sum(w * v for w, v in zip(chain.weights[1], [*x, first])) + chain.biases[1])
        assert abs(r["p_low_quality"] - first) < 1e-9 and abs(r["p_toxic"] - second) < 1e-9
