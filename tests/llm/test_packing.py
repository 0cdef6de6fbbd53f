"""Packing against whole-text encoding, a one-by-one best fit and exhaustive search."""

import itertools
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, queries
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab cdS's't1 ²\n\t\r ,.!?é԰ՠ漢😀\x1c\x85  '½_<|>")), max_size=40) | st.text(max_size=30))
def test_ids_word_by_word(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_word_by_word, "t") else test_ids_word_by_word.t
    test_ids_word_by_word.t = t
    t.encode_special_tokens = True
    words = packing.Words(t)
    ids = t.encode(text, add_special_tokens=False).ids
    assert words.document(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert words.document(text) == struct.pack(f"<{len(ids)}I", *ids)  # from memory


def test_blanks_and_classes_of_every_character(tokenizer):
    words = packing.Words(tokenizer)
    settled = [chr(c) for c in range(ord(packing.SETTLED))]
    for c in settled + [chr(c) for c in range(0x2000, 0x2070)] + ["　", "﻿", "\U0001f600"]:
        text = f"a {c} b{c}a 1{c}1 !{c}! {c}{c} x"
        assert words.document(text) == packing.packed(tokenizer.encode(text, add_special_tokens=False).ids), hex(ord(c))


def test_memory_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.Words(tokenizer)
    text = " ".join(f"word{i}" for i in range(50)) + " " + "x" * 500
    assert words.document(text) == packing.packed(tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(words.words.late) <= 5 and len(words.words.before) <= 5 and len(words.tokens.late) <= 5


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(1, 4) == [(0, 1)]


def filled(counts, capacity):
    """The plan's sequences as lists of (offset, length), checked to be gapless and each piece placed once."""
    rules, used = packing.packing_plan(dict(counts), capacity)
    numbers, sequences = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, each, offset in rules:
        numbers[length] += range(first, first + n)
        for i in range(n):
            sequences[sequence + i // each].append((offset + i % each * length, length))
    assert {s: sorted(x) for s, x in numbers.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    assert sorted(sequences) == list(range(used))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def one_by_one(counts, capacity):
    """Best fit, longest first, a piece at a time."""
    rooms = []
    for s in sorted(Counter(counts).elements(), reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - s)
    return len(rooms)


def fewest(sizes, capacity):
    """Exhaustive search: each piece in each open sequence or a new one."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 12)))))
def test_plan_fills_no_more_than_best_fit_piece_by_piece(case):
    capacity, counts = case
    assert len(filled(counts, capacity)) <= one_by_one(counts, capacity)


@settings(max_examples=100, deadline=None)
@given(st.integers(6, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(c // 3 + 1, c), max_size=8))))
def test_large_pieces_are_matched_as_well_as_can_be(case):
    capacity, sizes = case
    assert len(filled(Counter(sizes), capacity)) == fewest(sorted(sizes, reverse=True), capacity)


def test_work_does_not_grow_with_the_pieces():
    counts = {s: 10**12 + s for s in range(1, 2049)}
    rules, used = packing.packing_plan(counts, 2048)
    assert len(rules) < 20_000 and used >= sum(s * n for s, n in counts.items()) / 2048
    assert used <= 1.001 * sum(s * n for s, n in counts.items()) / 2048


def check(rows, texts, tokenizer, capacity):
    """rows of pack() with ids against texts, a list of (doc_id, text)."""
    expected = Counter()
    for doc_id, text in texts:
        ids = plain_ids(tokenizer, text)
        for k, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            expected[doc_id, k, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [0, *itertools.accumulate(n for _, n in sorted(parts))][:-1] and sum(n for _, n in parts) <= capacity
    return len(sequences)


def test_query(spark, tokenizer):
    rows = queries.op12_best_fit_packing(spark, SMALL).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    n = check(rows, texts, tokenizer, 2048)
    assert n <= one_by_one(Counter(r["length"] for r in rows), 2048)


def test_odd_rows_and_round_trip(spark, odd, tokenizer):
    docs = odd.withColumns({c: odd["lang"] for c in ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset", "_task", "_rank", "_before", "count")}).repartition(5)
    rows = packing.pack(docs, capacity=64, with_ids=True).cache()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(rows.collect(), texts, tokenizer, 64)
    pieces = defaultdict(list)
    for r in packing.assemble(rows).collect():
        for doc_id, piece, start, end in zip(r["doc_ids"], r["pieces"], r["starts"], [*r["starts"][1:], len(r["ids"])], strict=True):
            pieces[doc_id].append((piece, r["ids"][start:end]))
    once = {doc_id: plain_ids(tokenizer, text) for doc_id, text in texts if doc_id not in (1,)}
    assert {d: [i for _, p in sorted(pieces[d]) for i in p] for d in once} == once
    rows.unpersist()


def test_no_rows(spark, docs):
    assert packing.pack(docs({}), with_ids=True).collect() == []
    assert packing.assemble(packing.pack(docs({}), with_ids=True)).collect() == []
