"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Within a pre-token, an Aho-Corasick automaton gives the longest vocabulary
entry at every position.  A sequence of entries is what merging would produce
exactly if each neighbouring pair is, so the encoder walks forward with longest
matches, checks each against the pair-compatibility table and steps back to
shorter prefixes where a pair fails; a position found to be a dead end is never
tried twice, which keeps the work linear.  Decoding gathers bytes from one
buffer by the ids' offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

PIECE_CACHE = 200_000
PAIR_CACHE = 500_000
LONGEST_CACHED = 48
#: Stands for the end of a word where a vocabulary has a suffix for it.
END = b"\0"

# The pre-token pattern of this kind of vocabulary, with white space spelt out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = doc["model"]["vocab"]
        self.suffix: str = doc["model"].get("end_of_word_suffix") or ""
        cut = len(self.suffix)
        as_bytes = {i: bytes(alphabet[c] for c in t[:-cut]) + END if cut and t.endswith(self.suffix) and len(t) > cut else bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.merges: dict[tuple[int, int], int] = {}
        vocab_suffixed = {i: t.endswith(self.suffix) for t, i in vocab.items()}
        by_bytes = {b: i for i, b in as_bytes.items() if not cut or END not in b or vocab_suffixed[i]}
        size = max([*as_bytes, *self.special.values()]) + 1
        # how an entry is made: the rank of its merge (-1: a byte) and its two parts
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for k, (a, b) in enumerate(doc["model"]["merges"]):
            new = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = k
            if self.rank[new] < 0:
                self.rank[new], self.left[new], self.right[new] = k, vocab[a], vocab[b]
        self.shorter: list[int] = [-1] * size
        self.machine = ahocorasick.Automaton()
        for i, b in as_bytes.items():
            if not cut or END not in b or vocab_suffixed[i]:  # a word holds no U+0000 of its own
                self.machine.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1)
        self.machine.make_automaton()
        texts = as_bytes | {i: t.encode() for t, i in self.special.items()}
        self.lengths = [len(texts.get(i, b"")) for i in range(size)]
        self.offset = np.concatenate([[0], np.cumsum(self.lengths)])
        self.buffer = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.texts = texts
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves two neighbouring entries as they are: a row of the pair table, filled as it is needed."""
        known = self.pairs.get(a << 17 | b)
        if known is None:
            known = self._stay_apart(a, b)
            if len(self.pairs) < PAIR_CACHE:
                self.pairs[a << 17 | b] = known
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undo the merges that made both, the latest first: no merge across the border may come before the one undone.

        Equal ranks are merged from the left, so a merge across the border precedes an equal one to its right.
        """
        rank, until = self.rank, 1 << 60
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < until:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            else:
                until, b = rank[b] + 1, self.left[b]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token of a vocabulary with an end-of-word suffix; the word holds no U+0000."""
        return self.encode_piece(word + "\0")

    def encode_piece(self, piece: str) -> list[int]:
        s = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        straight = [i for _, i in self.machine.iter_long(s)]
        known, ok, left, size = self.pairs.get, self.compatible, -1, 0
        for i in straight:
            if left >= 0 and not (known(left << 17 | i) or ok(left, i)):
                break
            left, size = i, size + self.lengths[i]
        else:
            if size == len(s):
                return straight
        longest = [-1] * len(s)
        for end, i in self.machine.iter(s):  # ends ascend, so the longest from a start comes last
            longest[end + 1 - self.lengths[i]] = i
        dead = bytearray(len(s) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(s):
            while token >= 0 and (dead[at + self.lengths[token]] or out and not ok(out[-1], token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.lengths[token]
                token = longest[at] if at < len(s) else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.lengths[token]
        return out

    def _new(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece), "<u4").tobytes()
        if len(self.pieces) < PIECE_CACHE and len(piece) <= LONGEST_CACHED:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        get, new = self.pieces.get, self._new
        for k, part in enumerate(self.split(text) if self.split else [text]):
            if k % 2:
                parts.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                parts += [get(p) or new(p) for p in self.find(part)]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(start - ends + size, size)
        return self.buffer[where].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every whole text.

    ``path`` names a byte-level vocabulary file that every executor has.  A null
    or empty text gives no ids and an empty string.  Special tokens written out
    in a text become their ids.  Rows are independent of each other: repeated
    rows give repeated results, other columns are ignored, an empty table gives
    an empty result.
    """
    bounded_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([c.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
