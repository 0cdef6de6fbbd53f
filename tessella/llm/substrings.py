"""Substring dedup by hashing lines, cut at sentence ends and, in long sentences, at places that their words set."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of fewer words are compared together with the CONTEXT words before them.
MIN_WORDS = 5
CONTEXT = 8
#: A long sentence is cut before a word whose hash is the least of the REACH - 1 on either side, REACH words from its ends at least.
REACH = 8
BATCH_ROWS = 400
_sentence_end = re.compile(r"[.!?]+[ \t]+")
_word = re.compile(r"\S+")


def inner_cuts(text: str, start: int, end: int) -> list[int]:
    """Places to cut text[start:end], a sentence, at. Whether a word is one depends on the REACH words on either side alone."""
    words = text[start:end].split()
    if len(words) <= 2 * REACH:
        return []
    plain = [w.encode("utf-8", "surrogatepass") for w in text[start:end].lower().split()]
    marks = [zlib.crc32(b"%b %b" % pair) for pair in zip(plain, plain[1:])] + [zlib.crc32(plain[-1])]
    near = [i for i in range(REACH, len(words) - REACH) if marks[i - 1] > marks[i] <= marks[i + 1]]
    least = [i for i in near if marks[i] < min(marks[i - REACH + 1 : i]) and marks[i] <= min(marks[i + 1 : i + REACH])]
    if not least:
        return []
    starts = [w.start() for w in _word.finditer(text, start, end)]
    return [starts[i] for i in least]


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, digest) of each unit, in order, without gaps: lines with their break, cut behind sentences and inside long ones.

    Cuts depend on the words around them, not on where the last cut was. The digest is of the unit's lower-cased words,
    joined by blanks; if they are too few, of the CONTEXT words before the unit too; None if there are no words or not so
    many before.
    """
    start, before = 0, []
    for line in text.splitlines(keepends=True):
        end = start + len(line)
        ends = [start + m.end() for m in _sentence_end.finditer(line) if start + m.end() < end]
        cuts, begin = [], start
        for stop in (*ends, end):
            cuts += [*inner_cuts(text, begin, stop), stop]
            begin = stop
        for cut in cuts:
            words = text[start:cut].lower().split()
            compared = words if len(words) >= min_words else ["", *before, "", *words] if words and len(before) == CONTEXT else None
            yield start, cut, compared and hashlib.blake2b(" ".join(compared).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            before = (before + words)[-CONTEXT:]
            start = cut


def text_mark(text: str | None) -> int:
    """Tells rows of one doc_id with different texts apart: the 64 bits that Spark's xxhash64 gives."""
    return int.from_bytes(xxhash.xxh64_digest((text or "").encode("utf-8", "surrogatepass"), 42), "big", signed=True)


def kept_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _mark, _kept: for each row, the numbers of the units that are the earliest of their kind, by doc_id, then place.

    Units are grouped by digest with the earliest rank alone, so a unit that stands in a third of all documents is one
    pre-aggregated row from each task.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                text = text.as_py()
                own = {}
                for i, (_, _, digest) in enumerate(units(text or "", min_words)):
                    if digest is not None:
                        own.setdefault(digest, i)
                rows.extend((doc_id, text_mark(text), i, digest) for digest, i in own.items())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["id", "mark", "unit", "digest"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(mark, "id long, mark long, unit int, digest binary")
    first = found.groupBy("digest").agg(F.min(F.struct("id", "mark", "unit")).alias("r"))
    return first.groupBy(F.col("r.id").alias("_id"), F.col("r.mark").alias("_mark")).agg(F.collect_list("r.unit").alias("_kept"))


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the units that stand earlier in the corpus, n_units, n_removed, and removed: their [start, end) in the old text.

    Earlier means in a row of a smaller doc_id (null first), or further up in the same text. Rows of one doc_id with the
    same text count as one. A null or empty text has no units and stays as it is. Clashing columns are replaced.
    """
    docs = docs.drop("n_units", "n_removed", "removed")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    marked = docs.withColumn("_text_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = kept_units(docs, min_words)
    joined = marked.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_mark") == F.col("_mark")), "left").drop("_id", "_mark", "_text_mark")
    names = docs.columns
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_units, n_removed, removed = [], [], [], []
            for text, kept in zip(b["text"].to_pylist(), b["_kept"].to_pylist()):
                stay = set(kept or ())
                out, gone, n = [], [], 0
                for n, (start, end, digest) in enumerate(units(text or "", min_words), 1):
                    if digest is None or n - 1 in stay:
                        out.append(text[start:end])
                    else:
                        gone.append({"start": start, "end": end})
                texts.append("".join(out) if text else text)
                n_units.append(n)
                n_removed.append(len(gone))
                removed.append(gone)
            columns = {name: b[name] for name in names} | {"text": pa.array(texts, pa.string()), "n_units": pa.array(n_units, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {"removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans)]))
