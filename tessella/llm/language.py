"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import materialise

ORDER = 3
#: Documents a language that the trees are grown from, about so many at most, taken by a hash of doc_id.
DOCS_PER_LANGUAGE = 1500
#: Times that a language's sample has a context that its tree keeps; other contexts count as the shorter ones that they end in.
MIN_SEEN = 6
#: Languages that one pass over the documents compares; further ones take further passes, so a task's memory is bounded.
LANGUAGES_A_PASS = 8
UNKNOWN = "und"
BATCH_ROWS = 400
#: Bytes become symbols: ASCII letters without case, all other ASCII as one, and bytes from 128 on as they are.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
SYMBOLS = 155


def symbols_of(text: str) -> np.ndarray:
    """The text's symbols behind ORDER blanks; runs of blanks count once."""
    s = SYMBOL[np.frombuffer(b" " * ORDER + text.encode("utf-8", "surrogatepass"), np.uint8)]
    keep = (s != 0) | (np.concatenate(([1], s[:-1])) != 0)
    keep[:ORDER] = True
    return s[keep].astype(np.int32)


def contexts_of(s: np.ndarray) -> np.ndarray:
    """Code of the ORDER symbols before each symbol."""
    n = len(s) - ORDER
    code = np.zeros(n, np.int32)
    for i in range(ORDER):
        code = code * SYMBOLS + s[i : i + n]
    return code


class Tree:
    """A language's frozen context tree: the code length in bits of every symbol after every kept context."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, min_seen: int = MIN_SEEN):
        """codes of ORDER + 1 symbols and how often each occurs.

        After a context seen n times with u distinct symbols, a seen symbol has count / (n + u); the escape, u / (n + u),
        goes to the context without its oldest symbol, in the end to equal shares of all symbols.
        """
        p, row = np.empty((0, SYMBOLS)), np.zeros(1, np.int64)
        for k in range(ORDER + 1):
            own, times = summed(codes % SYMBOLS ** (k + 1), n)
            contexts, total = summed(own // SYMBOLS, times)
            kept = contexts[(total >= min_seen) | (k == 0)]
            here = np.isin(own // SYMBOLS, kept)
            at, symbol, times = np.searchsorted(kept, own[here] // SYMBOLS), own[here] % SYMBOLS, times[here]
            seen, distinct = np.bincount(at, times, len(kept)), np.bincount(at, None, len(kept))
            shorter = p[row[kept % SYMBOLS ** (k - 1)]] if k else np.full((len(kept), SYMBOLS), 1 / SYMBOLS)
            new = shorter * (distinct / (seen + distinct))[:, None]
            new[at, symbol] = times / (seen + distinct)[at]
            row = row[np.arange(SYMBOLS**k) % SYMBOLS ** (k - 1)] if k else row
            row[kept] = len(p) + np.arange(len(kept))
            p = np.concatenate((p, new))
        self.row = row.astype(np.int32)
        self.bits = -np.log2(p).astype(np.float32).ravel()

    def length(self, contexts: np.ndarray, symbols: np.ndarray) -> float:
        """Bits of the symbols after these contexts."""
        return float(self.bits[self.row[contexts] * np.int32(SYMBOLS) + symbols].sum(dtype=np.float64))


class Trees:
    """Trees of several languages, by code point."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], min_seen: int = MIN_SEEN):
        self.trees = {lang: Tree(*grams[lang], min_seen) for lang in sorted(grams)}

    def lengths(self, text: str) -> dict[str, float]:
        """Code length in bits of the whole text under each language."""
        s = symbols_of(text)
        contexts, symbols = contexts_of(s), s[ORDER:]
        return {lang: tree.length(contexts, symbols) for lang, tree in self.trees.items()}


def has_letter(text: str | None) -> bool:
    """Whether a character is of the Unicode categories of letters."""
    return bool(text) and any(map(str.isalpha, text))


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(where, n)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def count_grams(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language, the codes of ORDER + 1 symbols and their counts, from whole texts of a sample of about per_language documents each."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    known = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))
    cuts = docs.sparkSession.createDataFrame([(lang, int(1_000_000 * min(1.0, per_language / n)) + 1) for lang, n in sizes.items()], "lang string, cut long")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(cuts), "lang").where(place < F.col("cut")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                s = symbols_of(text.as_py())
                found.setdefault(lang, []).append(contexts_of(s) * np.int32(SYMBOLS) + s[ORDER:])
            for lang, codes in found.items():
                codes, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes)), "code": pa.array(codes, pa.int32()), "n": pa.array(n, pa.int64())})

    table = sample.mapInArrow(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (own["code"].to_numpy(np.int64), own["n"].to_numpy(np.float64)) for lang, own in table.groupby("lang") if len(own)}


def identify(docs: DataFrame, grams: dict[str, tuple[np.ndarray, np.ndarray]], a_pass: int = LANGUAGES_A_PASS, min_seen: int = MIN_SEEN) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone; a_pass languages are compared in one pass, written between passes."""
    docs = docs.drop("lang_pred", "score")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    names = docs.columns
    state = {"_lang": "string", "_bits": "double", "_rest": "double"}  # the best so far, its bits, and the sum of the others' likelihoods over its
    carried = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in state.items()})
    languages = sorted(grams)
    for k in range(0, len(languages), a_pass):
        trees = docs.sparkSession.sparkContext.broadcast(Trees({lang: grams[lang] for lang in languages[k : k + a_pass]}, min_seen))

        def judge(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for text, *best in zip(b["text"], *(b[c].to_pylist() for c in state)):
                    text = text.as_py()
                    if has_letter(text):
                        for lang, bits in trees.value.lengths(text).items():
                            best = better(best, lang, bits)
                    out.append(best)
                columns = dict(zip(b.schema.names, b.columns, strict=True)) | {c: pa.array([o[i] for o in out], b.schema.field(c).type) for i, c in enumerate(state)}
                yield pa.RecordBatch.from_pydict(columns)

        carried = (materialise(carried) if k else carried).mapInArrow(judge, carried.schema)
    return carried.select(*names, F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / (1 + F.col("_rest")), F.lit(0.0)).alias("score"))


def better(best: list, lang: str, bits: float) -> list:
    """The state after one more language: of equal code lengths the earlier language stays."""
    old, least, rest = best
    if old is None:
        return [lang, bits, 0.0]
    ratio = 2.0 ** -min(abs(bits - least), 1000.0)
    return [lang, bits, (1 + rest) * ratio] if bits < least else [old, least, rest + ratio]


def language_id(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred and score; the trees come from the rows that are not held out.

    A null text, one without a letter, or any text when there is nothing to learn from gives 'und' and score 0. score is
    the best language's share of the likelihood; of equal languages the first by code point is taken. Repeated rows are
    judged alike; rows with a null doc_id are not held out.
    """
    return identify(docs.drop("held_out").withColumn("held_out", held_out()), count_grams(docs.where(~held_out()), per_language))
