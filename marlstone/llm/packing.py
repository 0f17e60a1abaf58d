"""Harmonic packing of token sequences.

A document of length n up to the capacity belongs to the reciprocal-capacity class k with n in (capacity/(k+1),
capacity/k], and a sequence of class k holds exactly k documents of it, whole.  Each worker fills the sequences of its
own classes and shares nothing with other workers, so there is no shuffle.  The room that a sequence then has
left, up to 1/(k+1) of it, is closed by pieces of other documents: the ends of documents longer than the capacity,
documents smaller than class CLASSES, and, as soon as the open room would hold it, the next document.  Only these
are cut.  Room below half of `slack` stays as padding.  At its end a worker lays the pieces of its unfinished sequences end
to end, and cuts what doesn't fill a whole sequence into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
CLASSES = 32
SLACK = 1 / 256
#: Texts are tokenised in segments of about so many characters, cut where tokens never span.
SEGMENT = 1_000_000
#: Runs of white space from this length on are more than tiktoken's regular expressions may bear (they fail at a million; 300,000 were seen to pass).
LONG_SPACE = 300_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def load_tokenizer(path: str, json_path: str | None = None):
    """text -> uint32 ids of the byte-level BPE in a `.tiktoken` rank file, without special tokens.

    json_path: the tokenizer's JSON file, whose added tokens are matched in texts as `tokenizers` does; without
    it they are spelled out like any text.  Segments with very long white space are encoded by `tokenizers`.
    A single space between two characters that aren't white space starts a token in this vocabulary's
    splitting pattern, so a long text can be cut there."""
    import base64
    import json

    import numpy as np
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    seam, long_space = re.compile(r"(?<=\S) (?=\S)"), re.compile(rf"\s{{{LONG_SPACE}}}")
    added: dict[str, int] = {}
    if json_path:
        with open(json_path, encoding="utf-8") as f:
            for token in json.load(f)["added_tokens"]:
                if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                    raise ValueError(f"added token {token['content']!r} isn't matched literally")
                added[token["content"]] = token["id"]
    # The leftmost match counts, and of those the longest.
    literal = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    slow: list = []

    def encode(text: str) -> list[int]:
        if len(text) < LONG_SPACE or not long_space.search(text):
            return fast(text)
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
            slow[0].encode_special_tokens = True  # what is added has been taken out
        return slow[0].encode(text, add_special_tokens=False).ids

    def ordinary(text: str, parts: list) -> None:
        at = 0
        while len(text) - at > SEGMENT and (m := seam.search(text, at + SEGMENT)):
            parts.append(np.array(encode(text[at : m.start()]), np.uint32))
            at = m.start()
        parts.append(np.array(encode(text[at:]), np.uint32))

    def ids(text: str) -> np.ndarray:
        parts: list = []
        at = 0
        for m in literal.finditer(text) if literal else ():
            ordinary(text[at : m.start()], parts)
            parts.append(np.array([added[m.group()]], np.uint32))
            at = m.end()
        ordinary(text[at:] if at else text, parts)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    return ids


class Harmonic:
    """The sequences of one worker.  add() and finish() give (doc, start, length, crc, doc_tokens, sequence, offset, sequence_length)."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> None:
        from zlib import crc32

        self.capacity, self.classes, self.crc = capacity, min(classes, capacity), crc32
        self.least = max(1, int(capacity * slack / 2))
        self.held: list[list] = [[] for _ in range(self.classes + 1)]
        # Sequences with room, as (-room, order, pieces), and all their room.
        self.open: list[tuple] = []
        self.room, self.order, self.made = 0, 0, 0

    def _close(self, pieces: list) -> list:
        out, at, total = [], 0, sum(p[2] for p in pieces)
        for doc, start, length, ids, tokens in pieces:
            out.append((doc, start, length, self.crc(ids), tokens, self.made, at, total))
            at += length
        self.made += 1
        return out

    def add(self, doc, ids) -> list:
        """ids: '<u4' array of a whole document."""
        out, n, at, cap = [], len(ids), 0, self.capacity
        while n - at >= cap:
            out += self._close([(doc, at, cap, ids[at : at + cap].tobytes(), n)])
            at += cap
        if at == n:
            return out
        piece = (doc, at, n - at, ids[at:].tobytes(), n)
        k = cap // piece[2]
        if at or k > self.classes or self.room >= piece[2]:
            return out + self._fill(piece)
        self.held[k].append(piece)
        if len(self.held[k]) == k:
            pieces, self.held[k] = self.held[k], []
            out += self._offer(cap - sum(p[2] for p in pieces), pieces)
        return out

    def _offer(self, room: int, pieces: list) -> list:
        """Closes a sequence without notable room, and keeps any other for pieces to come."""
        from heapq import heappush

        if room < self.least:
            return self._close(pieces)
        heappush(self.open, (-room, self.order, pieces))
        self.room, self.order = self.room + room, self.order + 1
        return []

    def _fill(self, piece) -> list:
        """Puts a piece into the largest room, its rest into the next largest, or into a sequence of its own."""
        from heapq import heappop

        doc, start, length, ids, tokens = piece
        out = []
        while length:
            room, pieces = self.capacity, []
            if self.open:
                room, _, pieces = heappop(self.open)
                room = -room
                self.room -= room
            fit = min(length, room)
            pieces.append((doc, start, fit, ids[: 4 * fit], tokens))
            start, length, ids = start + fit, length - fit, ids[4 * fit :]
            out += self._offer(room - fit, pieces)
        return out

    def finish(self) -> list:
        out = []
        left = [p for _, _, pieces in sorted(self.open, key=lambda x: x[1]) for p in pieces] + [p for held in self.held for p in held]
        self.open, self.held, self.room = [], [[] for _ in range(self.classes + 1)], 0
        size = self.capacity
        while left:
            total = sum(p[2] for p in left)
            while size > total:
                size //= 2
            room, part, rest = size, [], []
            for doc, start, length, ids, tokens in left:
                fit = min(length, room)
                if fit:
                    part.append((doc, start, fit, ids[: 4 * fit], tokens))
                if fit < length:
                    rest.append((doc, start + fit, length - fit, ids[4 * fit :], tokens))
                room -= fit
            out += self._close(part)
            left = rest
        return out


def _packer(path: str, json_path: str | None, end_id: int, capacity: int, classes: int, slack: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids, bins = load_tokenizer(path, json_path), Harmonic(capacity, classes, slack)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        kinds = [pa.int64()] * 8
        names = [x.split()[0] for x in PIECES.split(", ")]

        def rows(made):
            cols = [list(c) for c in zip(*made)]
            cols[5] = [base + x for x in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        made: list = []
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                made += bins.add(docs[i].as_py(), np.concatenate([ids(texts[i].as_py() or ""), end]))
                if len(made) >= 20_000:
                    yield rows(made)
                    made = []
        made += bins.finish()
        if made:
            yield rows(made)

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, json_path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    tokenizer_path: `.tiktoken` rank file of the vocabulary; json_path: see load_tokenizer.  A null or empty text is its end id alone; a null
    id stays null; rows with one id are documents of their own.  An empty table gives no piece.  Other columns
    of docs are ignored.  sequence_id is unique; sequences are padded to the capacity unless sequence_length
    is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    common.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packer(tokenizer_path, json_path, end_id, capacity, classes, slack), PIECES)


def vocabulary_path() -> str:
    """The rank file of `byte_bpe_50k.json`: the same vocabulary and ids, but for the added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_path() -> str:
    """The JSON file of the same tokenizer, which holds its added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), vocabulary_path(), json_path=added_path())
