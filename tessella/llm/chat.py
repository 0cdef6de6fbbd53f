"""Chat formatting by token-level assembly."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The splitting pattern that belongs to the byte-level vocabulary, and the template's control strings.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
CONTROLS = (TURN, SAYS, END, "### Assistant:", "### User:", "### System:")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BATCH_ROWS = 400
#: Longest run of blanks or of other characters that is encoded at once: the splitting pattern backtracks over blanks, and pairs are merged over a whole run.
RUN = 500
FORMATTED = "conv_id long, turn long, role string, ids array<int>, loss_mask array<byte>"
READ = "conv_id long, turn long, role string, text string, trained string, chars long"

_escapes = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_escaped = re.compile(r"\\(.)", re.DOTALL)
_runs = re.compile(rf"(\s{{{RUN}}}|\S{{{RUN}}})")


def escape(text: str) -> str:
    """text in which no control string occurs: a backslash is doubled, and one is put behind a control string's first character."""
    return _escapes.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


class Codec:
    """Segments to ids and back. The ids of TURN, SAYS and END lie past the vocabulary, so no text encodes to them."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.turn, self.says, self.end = (len(ranks) + i for i in range(1, 4))

    def encode(self, text: str) -> list[int]:
        """Ids of the escaped text; runs of over RUN characters are encoded in pieces, which decoding joins again."""
        return [i for piece in _runs.split(escape(text)) if piece for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> str:
        """The text as it stands in the output, still escaped."""
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def assemble(self, role: str, text: str, trained: bool) -> tuple[list[int], np.ndarray]:
        """Ids of a turn, spliced from separately encoded segments, and its loss mask: the running sum of +1 where the trained text begins and -1 where it ends."""
        head, body = self.encode(role), self.encode(text)
        ids = [self.turn, *head, self.says, *body, self.end]
        steps = np.zeros(len(ids) + 1, np.int8)
        if trained:
            steps[len(head) + 2] += 1
            steps[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def read(self, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
        """Role, text, text under the mask and number of characters of a turn, all from its ids."""
        cut = ids.index(self.says)
        role, text = self.decode(ids[1:cut]), self.decode(ids[cut + 1 : -1])
        chars = len(TURN) + len(role) + len(SAYS) + len(text) + len(END)
        return unescape(role), unescape(text), unescape(self.decode([i for i, m in zip(ids, mask, strict=True) if m])), chars


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def format_turns(turns: DataFrame, trained_role: str = "assistant", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a turn: conv_id, turn, role, ids, loss_mask (a byte an id).

    A null role or text counts as empty. Other columns are not read. The vocabulary is read once, on the driver.
    """
    spark = turns.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            ids, masks = [], []
            for role, text in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                own, mask = codec.assemble(role or "", text or "", role == trained_role)
                ids.append(own)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], ["conv_id", "turn", "role", "ids", "loss_mask"])

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(assemble, FORMATTED)


def read_turns(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a turn, decoded from its ids alone: conv_id, turn, role, text, trained (the text under the loss mask) and chars of the formatted turn."""
    shared = formatted.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            turns = [codec.read(ids, mask) for ids, mask in zip(b["ids"].to_pylist(), b["loss_mask"].to_pylist(), strict=True)]
            columns = [pa.array([t[i] for t in turns], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], *columns], ["conv_id", "turn", "role", "text", "trained", "chars"])

    return formatted.mapInArrow(read, READ)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a conversation, from its decoded turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are decoded wherever they lie. A digest is sequential, so a conversation's turns then pass one task in order, one
    by one: it holds a batch of them whatever their number, and does nothing but hash. Turns of the same number are taken by
    role, then text; a null conv_id is a conversation of its own; no turns give no row.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, done = False, None, []
        n = loss_chars = chars = 0
        all_text = loss_text = None
        for b in batches:
            for conv_id, role, text, trained, length in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text", "trained", "chars")), strict=True):
                if not begun or conv_id != conv:
                    if begun:
                        done.append((conv, n, all_text.hexdigest(), loss_chars, loss_text.hexdigest(), chars))
                    begun, conv, n, loss_chars, chars = True, conv_id, 0, 0, 0
                    all_text, loss_text = hashlib.sha256(), hashlib.sha256()
                all_text.update(f"{role}\n{text}\n".encode())
                loss_text.update(trained.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + length
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types, strict=True)], names)
                done = []
        if begun:
            last = (conv, n, all_text.hexdigest(), loss_chars, loss_text.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types, strict=True)], names)

    ordered = read_turns(formatted, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "trained", "chars").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
