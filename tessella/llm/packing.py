"""Packing tokenised documents into sequences of a fixed capacity: large pieces are matched in pairs, small ones best-fit what is left."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.session import materialise, small

# The vocabulary of the contract, the pattern that belongs to it, and the id that ends a document.
VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 0
CAPACITY = 2048
#: Words that a Python worker remembers with their ids: so many of late, and as many from before.
REMEMBERED = 500_000
#: Longer words are not remembered.
REMEMBERED_LENGTH = 64
#: Rows that a task hands on at once.
BATCH_ROWS = 5_000
#: Before this code point, all Unicode versions agree on what is a letter and what a number.
SETTLED = "԰"
#: Marks that the pattern takes as a token of their own behind letters at the end of a word.
MARKS = frozenset(".,;:!?")
PIECES = "piece int, start long, length long, ids_crc32 long, _task int, _rank long"


class Memory:
    """What was met of late, and what was before; when the one is full it becomes the other, so words in use stay."""

    def __init__(self):
        self.late: dict[str, bytes | bool] = {}
        self.before: dict[str, bytes | bool] = {}

    def again(self, word: str) -> bytes | bool | None:
        ids = self.late.get(word)
        if ids is None and (ids := self.before.get(word)) is not None:
            self.keep(word, ids)
        return ids

    def keep(self, word: str, ids: bytes | bool) -> bytes | bool:
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.late) >= REMEMBERED:
                self.late, self.before = {}, self.late
            self.late[word] = ids
        return ids


class Words:
    """Ids of texts, word by word, as little-endian unsigned 32-bit bytes, with a memory of words.

    A blank between two characters that are not white space always begins a token of its own or one with the word behind
    it, so a text may be cut there and its words encoded apart, each with the blank before it. A word that is empty or has
    white space at an end stood at another kind of blank: its text is cut at the former places only.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.words, self.tokens = Memory(), Memory()  # of a word, False if it isn't one
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as the character of that number
        others = [b for b in range(256) if b not in own]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.blank = self.letters[32]

    def learn(self, word: str) -> bytes | bool:
        """Ids of a blank and the word."""
        if word.isalpha() and (word.isascii() or max(word) < SETTLED):
            ids = packed([t.id for t in self.merge(self.blank + (word if word.isascii() else self.spelt(word)))])
        elif (stem := word[:-1]).isalpha() and word[-1] in MARKS and (stem.isascii() or max(stem) < SETTLED):
            ids = (self.words.again(stem) or self.learn(stem)) + self.encode(word[-1])
        elif word and not word[0].isspace() and not word[-1].isspace():
            ids = self.encode(f" {word}")
        else:
            ids = False
        return self.words.keep(word, ids)

    def spelt(self, token: str) -> str:
        """token as the vocabulary writes it: a character for each byte."""
        return token.encode().decode("latin-1").translate(self.letters)

    def encode(self, text: str) -> bytes:
        """Ids of a text of any kind."""
        if not (text.isascii() or max(text) < SETTLED):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        tokens = _split(text)
        found = list(map(self.tokens.late.get, tokens))
        for i, ids in enumerate(found):
            if ids is None:  # what the pattern takes as one token goes by the vocabulary's merges alone
                found[i] = self.tokens.again(tokens[i]) or self.tokens.keep(tokens[i], packed([t.id for t in self.merge(self.spelt(tokens[i]))]))
        return b"".join(found)

    def document(self, text: str) -> bytes:
        """Ids of a whole text, so that a task never holds more of it than its ids."""
        first, *words = text.split(" ")
        found = list(map(self.words.late.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.words.again(words[i]) or self.learn(words[i])
        if False not in found and not first[-1:].isspace():
            return b"".join([self.encode(first), *found])
        first, *words = _cuts.split(text)
        return b"".join([self.encode(first), *[self.words.again(w) or self.encode(f" {w}") for w in words]])


_split = regex.compile(PATTERN).findall
_cuts = re.compile(r"(?<=\S) (?=\S)")


def worker_words(vocabulary: str) -> Words:
    """The words of this Python worker: it serves many tasks, each of which brings its functions anew, so they are kept in a module of their own."""
    own = sys.modules.setdefault("tessella_worker_words", ModuleType("tessella_worker_words")).__dict__
    if own.get("vocabulary") != vocabulary:
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True
        own.update(vocabulary=vocabulary, words=Words(tokenizer))
    return own["words"]


def packed(ids: list[int]) -> bytes:
    whole = array("I", ids)
    if sys.byteorder == "big":
        whole.byteswap()
    return whole.tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full, but for the first."""
    first = min(n, n % capacity or capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, and ids on demand; _task and _rank number the pieces of a length.

    Ids are those of the vocabulary's tokenizer with the strings of special tokens taken as ordinary text, then END_ID; a null text
    is empty, so it gives END_ID alone. Write the rows before use: _rank counts within a task.
    """
    path = public_tokenizers.path(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank", *["ids"] * with_ids]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen, end = worker_words(shared.value), TaskContext.get().partitionId(), Counter(), packed([END_ID])
        rows, of, ids = [], [], []

        def batch(keys: pa.Array) -> pa.RecordBatch:
            columns = [keys.take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
            if with_ids:
                lengths = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for at in range(b.num_rows):
                all_ids = words.document(b["text"][at].as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(all_ids) // 4, capacity)):
                    own = all_ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(own), task, seen[length]))
                    of.append(at)
                    seen[length] += 1
                    if with_ids:
                        ids.append(own)
                    if len(rows) >= BATCH_ROWS:
                        yield batch(b["doc_id"])
                        rows, of, ids = [], [], []
            if rows:
                yield batch(b["doc_id"])
                rows, of, ids = [], [], []

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {id_kind}, {PIECES}{', ids array<int>' if with_ids else ''}")


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, first, n, sequence, each, offset) for so many pieces of each length, and how many sequences they fill.

    The pieces numbered first to first + n - 1 of that length go to the sequences from that one on, so many to each, behind each
    other from the offset. Pieces of more than a third of the capacity stand two to a sequence at most, so matching them is all there
    is to it: the longest goes with the longest that fits. From there on each length, longest first, goes where it leaves the
    least: a sequence's room is a number up to the capacity, and sequences of equal room are one run, so the work depends on
    the capacity and not on how many pieces there are.
    """
    left, done = dict(counts), Counter()
    rules, rooms, used = [], defaultdict(list), 0  # rooms: by the room that is left, (first sequence, how many)

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rules.append((length, done[length], n, sequence, each, offset))
        done[length] += n
        left[length] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large.pop()
        while left[a]:
            b = next((b for b in reversed([*large, a]) if a + b <= capacity and left[b] > (b == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            if b == a:
                place(a, 2 * n, used, 2, 0)
            else:
                place(a, n, used, 1, 0)
                if b is not None:
                    place(b, n, used, 1, a)
            rooms[capacity - a - (b or 0)].append((used, n))
            used += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        for room in [r for r in range(s, capacity + 1) if rooms.get(r)]:
            each, stay = room // s, []
            for first, n in rooms.pop(room):
                full = min(n, left[s] // each)
                if full:
                    place(s, full * each, first, each, capacity - room)
                    rooms[room - each * s].append((first, full))
                if full < n and (some := left[s]):
                    place(s, some, first + full, some, capacity - room)
                    rooms[room - some * s].append((first + full, 1))
                    full += 1
                if full < n:
                    stay.append((first + full, n - full))
            if stay:
                rooms[room].extend(stay)
            if not left[s]:
                break
        each = capacity // s
        if full := left[s] // each:
            place(s, full * each, used, each, 0)
            rooms[capacity - each * s].append((used, full))
            used += full
        if some := left[s]:
            place(s, some, used, some, 0)
            rooms[capacity - some * s].append((used, 1))
            used += 1
    return rules, used


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, in as few sequences of at most the capacity as the matching gives.

    Only documents of more ids are cut. Repeated rows and equal or null doc_ids are packed like any others; an empty table
    gives no rows; columns other than doc_id and text are not read, whatever their names. Only the number of pieces of each
    length, at most the capacity many, comes to the driver; pieces are numbered by task and then over the tasks.
    """
    written = materialise(pieces(docs, capacity, with_ids, vocabulary))
    counts = materialise(written.groupBy("_task", "length").count())
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    rules, _ = packing_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    table = np.array(sorted(rules), np.int64).reshape(-1, 6)
    bounds = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    shared = docs.sparkSession.sparkContext.broadcast((table, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bounds = shared.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            rule = np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = length == s
                lo, hi = bounds[s], bounds[s + 1]
                rule[at] = lo + np.searchsorted(table[lo:hi, 1], rank[at], side="right") - 1
            _, first, _, sequence, each, offset = table[rule].T
            place = rank - first
            yield b.drop_columns(["_rank"]).append_column("sequence_id", pa.array(sequence + place // each)).append_column("offset", pa.array(offset + place % each * length))

    numbered = written.join(small(materialise(offsets)), ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    kept = [c for c in written.columns if not c.startswith("_")]
    kinds = ", ".join(f"{c} {written.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.select(*kept, "_rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def assemble(packed_pieces: DataFrame) -> DataFrame:
    """A row a sequence, from pieces with ids: sequence_id, ids, and doc_ids, pieces and starts (where each begins) in their order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    whole = packed_pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.piece").alias("pieces"), F.col("parts.offset").alias("starts"))
