"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.decontamination import words_of
from tessella.session import compact, materialise

#: The chain, in order: name and the condition on the labels that is its truth.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
#: Labelled rows that the models are fitted on, at most about so many, taken by a hash of doc_id.
SAMPLE_ROWS = 12_000
FOLDS = 3
#: Word and prefix features chosen for each category, and the documents that a feature needs.
FEATURES = 300
MIN_DOCS = 3
#: Prefix lengths in bytes; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
THRESHOLD = 0.35
BATCH_ROWS = 400
#: Features that a Python worker counts before it passes the counts on.
HELD_COUNTS = 200_000
_runs = re.compile(r"([^\w\s])\1{1,}")


def lexical(words: list[bytes]) -> dict[int, set[bytes]]:
    distinct = set(words)
    return {k: {w[:k] for w in distinct} if k else distinct for k in PREFIXES}


def surface(text: str, words: list[bytes]) -> list[float]:
    """Shares that do not depend on the vocabulary or the length: symbols, bars, capitals, digits, repeats, run-on symbols."""
    n, m = max(1, len(text)), max(1, len(words))
    letters = max(1, sum(map(len, words)))
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [kinds[1] / n, kinds[2] / n, kinds[3] / letters, kinds[4] / letters, repeats / m, len(_runs.findall(text)) / m]


_KIND = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = 2 if chr(_c) == "|" else 3 if chr(_c).isupper() else 4 if chr(_c).isdigit() else 0 if chr(_c).isalpha() else 1
SURFACE = 6


@dataclass
class Chain:
    """Features and, for each category, weights over features, surface shares and the earlier categories' probabilities."""

    names: list[str]
    features: list[tuple[int, bytes]]
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.chosen = {k: {f: i for i, (length, f) in enumerate(self.features) if length == k} for k in PREFIXES}

    def vector(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(self.features) + SURFACE)
        if text:
            words = words_of(text)
            for k, found in lexical(words).items():
                index = self.chosen[k]
                for f in found & index.keys():
                    x[index[f]] = 1.0
            x[len(self.features) :] = surface(text, words)
        return x

    def probabilities(self, text: str | None) -> list[float]:
        x, out = self.vector(text), []
        for w, b in zip(self.weights, self.biases, strict=True):
            z = float(w @ np.concatenate((x, out)) + b)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, categories, rows: int) -> DataFrame:
    """text, fold and y_<category> (0 or 1) of at most about `rows` labelled documents, chosen by a hash of doc_id.

    A category holds if any label of the doc_id says so. Of several texts of a doc_id the least is taken, so the bound holds;
    folds go by text, so that copies under other ids don't tell a fold's model what it is asked.
    """
    truths = [F.max(F.coalesce(F.expr(truth), F.lit(False)).cast("int")).alias(f"y_{name}") for name, truth in categories]
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*truths)
    n = max(1, labels.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    chosen = marks.where(place < int(1_000_000 * min(1.0, rows / n)))
    names = [f"y_{name}" for name, _ in categories]
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    return sample.select("text", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).alias("fold"), *names)


def choose_features(sample: DataFrame, categories, per_category: int, min_docs: int) -> list[tuple[int, bytes]]:
    """The features whose document shares differ most, in standard errors, inside and outside of a category."""
    names = [f"y_{name}" for name, _ in categories]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, ...], Counter] = {}
        held = 0
        for b in batches:
            for text, *ys in zip(b["text"], *[b[y].to_pylist() for y in names], strict=True):
                c = seen.setdefault(tuple(ys), Counter())
                for k, found in lexical(words_of(text.as_py())).items():
                    held += len(found)
                    c.update((k, f) for f in found)
                if held > HELD_COUNTS:
                    yield from counted(seen)
                    seen, held = {}, 0
        yield from counted(seen)

    def counted(seen: dict[tuple[int, ...], Counter]) -> Iterator[pa.RecordBatch]:
        for ys, c in seen.items():
            keys, n = list(c), np.fromiter(c.values(), np.int64, len(c))
            inside = pa.FixedSizeListArray.from_arrays(pa.array((n[:, None] * np.array(ys)).ravel(), pa.int64()), len(ys))
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in keys], pa.int32()), "f": pa.array([f for _, f in keys], pa.binary()), "n": pa.array(n), "inside": inside.cast(pa.list_(pa.int64()))})

    n = len(names)
    totals = sample.agg(F.count("*").alias("all"), *[F.sum(y).alias(y) for y in names]).first()
    counts = sample.select("text", *names).mapInArrow(count, "k int, f binary, n long, inside array<long>")
    counts = materialise(compact(counts.groupBy("k", "f").agg(F.sum("n").alias("n"), *[F.sum(F.col("inside")[i]).alias(f"i{i}") for i in range(n)]).where(F.col("n") >= min_docs)))
    chosen: dict[tuple[int, bytes], None] = {}
    for i, y in enumerate(names):
        a, b = totals[y] or 0, totals["all"] - (totals[y] or 0)
        if not a or not b:
            continue
        share = F.col("n") / totals["all"]
        z = (F.col(f"i{i}") / a - (F.col("n") - F.col(f"i{i}")) / b) / F.sqrt(share * (1 - share) * (1 / a + 1 / b) + 1e-9)
        best = counts.withColumn("z", F.abs(z)).where("z > 3").orderBy(F.desc("z"), "k", "f").limit(per_category).select("k", "f").collect()
        chosen |= {(r["k"], bytes(r["f"])): None for r in best}
    return list(chosen)


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = SAMPLE_ROWS, folds: int = FOLDS, per_category: int = FEATURES, min_docs: int = MIN_DOCS) -> Chain:
    """Fit category after category; a later model sees the earlier categories' out-of-fold probabilities.

    A category whose truth is the same for all sampled rows always gets that value; no labelled rows give 0 for all. Where the
    other folds hold rows of one truth only, or none, a fold's probability is the share of true rows there, or of all rows.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    parts = docs.sparkSession.sparkContext.defaultParallelism
    sample = materialise(labelled_sample(docs, labels, categories, rows).repartition(2 * parts))
    chain = Chain([name for name, _ in categories], choose_features(sample, categories, per_category, min_docs))
    names = [f"y_{name}" for name in chain.names]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([chain.vector(t.as_py()) for t in b["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["fold"], *[b[y] for y in names], x], ["fold", *names, "x"])

    rows_ = materialise(sample.mapInArrow(vectors, ", ".join(["fold long", *[f"{y} int" for y in names], "x array<double>"])))
    for i, y in enumerate(names):
        data = rows_.select("*", array_to_vector("x").alias("features"), F.col(y).cast("double").alias("label"))
        sizes = {(r["fold"], r[y]): r["count"] for r in rows_.groupBy("fold", y).count().collect()}
        truth = {t for _, t in sizes}
        if len(truth) < 2:
            chain.weights.append(np.zeros(len(chain.features) + SURFACE + i))
            chain.biases.append(500.0 if truth == {1} else -500.0)
            probability = F.lit(float(truth == {1}))
            rows_ = rows_.withColumn("x", F.concat("x", F.array(probability)))
            continue
        learner = LogisticRegression(maxIter=60, regParam=1e-4, featuresCol="features", labelCol="label", probabilityCol="p")
        model = learner.fit(data)
        chain.weights.append(model.coefficients.toArray())
        chain.biases.append(float(model.intercept))
        if i + 1 < len(names):
            parts = []
            for f in range(folds):
                held, rest = data.where(F.col("fold") == f), data.where(F.col("fold") != f)
                others = {t for g, t in sizes if g != f}
                if len(others) < 2:
                    share = float(others == {1}) if others else sum(n for (_, t), n in sizes.items() if t) / sum(sizes.values())
                    parts.append(held.select("fold", *names, F.concat("x", F.array(F.lit(share))).alias("x")))
                    continue
                fold_model = learner.fit(rest)
                parts.append(fold_model.transform(held).select("fold", *names, F.concat("x", F.array(vector_to_array("p")[1])).alias("x")))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            rows_ = materialise(compact(out))
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category>, from the whole text; columns that clash are replaced."""
    docs = docs.drop(*[f"p_{name}" for name in chain.names])
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [chain.probabilities(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[i] for x in p], pa.float64()) for i in range(len(chain.names))]], [*b.schema.names, *[f"p_{name}" for name in chain.names]])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *[T.StructField(f"p_{name}", T.DoubleType()) for name in chain.names]]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_low_quality, p_toxic and is_toxic: p_toxic >= threshold.

    A null or empty text has no features and is not toxic. Rows that repeat are scored alike. Labels without a doc_id, or
    of no document, are not used; a doc_id is of each category that one of its labels is of.
    """
    scored = score(docs.drop("is_toxic"), fit_chain(docs, labels))
    return scored.withColumn("is_toxic", (F.col("p_toxic") >= threshold) & (F.length(F.coalesce("text", F.lit(""))) > 0))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, as they are."""
    return toxicity(docs, labels, threshold).where(~F.col("is_toxic")).select(*docs.columns)
