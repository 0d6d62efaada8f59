"""Vector best-fit packing of documents into sequences.

Every piece needs a vector of resources: its tokens, one document, and an
attention cost (the square of its length).  A sequence has a capacity for each.
Pieces are taken from long to short; each goes into the open sequence that it
fits under every constraint and that scores best, by the weighted norm of what
stays free or by the weighted dot product of need and free capacity.

Pieces of one length are alike, so the search runs over the histogram of
lengths (no more entries than ``max_tokens``, whatever the input) and over
groups of sequences in the same state.  It yields placement rules for ranges of
equal pieces.  The pieces themselves never leave the executors: each finds its
rule by its rank within its length.  Ranks are counted by salted parts, so a
length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .common import bounded_batches, materialize

WORD_CACHE = 600_000
LONGEST_CACHED = 48
#: Pieces of one length that one task ranks.
RANKED_TOGETHER = 4000


class WordTokenizer:
    """The tokenizers library's ids for a vocabulary that drops white space, word by word with a bounded cache.

    White space ends every pre-token of such a vocabulary, so a text's ids are
    its words' ids joined.  In a plain text single commas and full stops are
    words too, and letters are lower-cased beforehand as the library does.
    Texts with special tokens or the separators U+001C to U+001F, which Python
    splits at and the library doesn't, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.codec = Codec(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the cache keeps ids in 16 bits")
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.library.get_added_tokens_decoder().values())]
        self.run = re.compile(r"[.,](?<=[^\w\s].|_.)").search  # a mark right after another one: both are one pre-token
        # the table: words, their ids one after the other, how many each has, and which were used lately
        self.known = pa.array([], pa.large_string())
        self.ids, self.size, self.used = np.empty(0, "<u2"), np.empty(0, np.int64), np.empty(0, bool)

    def prepared(self, text: str) -> str:
        """The text; with single commas and full stops apart if it is composed, has no marks side by side and no letter whose lower case depends on its place or adds a mark."""
        if self.run(text) or "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
            return text
        return text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " . \n")

    def _ids(self, word: str) -> bytes:
        # letters alone, lower case and composed, are one pre-token that the library leaves as it is
        if word.isalpha() and word.islower() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return array("H", self.codec.encode_word(word)).tobytes()
        return array("H", self.library.encode(word, add_special_tokens=False).ids).tobytes() if word else b""

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text.  Every distinct word of the batch is looked up once; its ids are gathered for all its places."""
        whole = [any(x in (t or "") for x in self.odd) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array(["" if w else self.prepared(t or "") for t, w in zip(texts, whole)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        row = pc.index_in(words, self.known).fill_null(-1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(row < 0)
        row[fresh] = len(self.known) + np.arange(len(fresh))
        parts = [self._ids(w) for w in words.take(pa.array(fresh)).to_pylist()]
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(parts), "<u2")])
        size = np.concatenate([self.size, np.fromiter(map(len, parts), np.int64, len(parts)) // 2])
        start = np.cumsum(size) - size
        word = row[coded.indices.to_numpy(zero_copy_only=False)]
        count = size[word]
        ends = np.cumsum(count)
        flat = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[word] - ends + count, count)].astype("<u4")
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        self._keep(pa.concat_arrays([self.known, words.take(pa.array(fresh))]), ids, size, row)
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") if w else flat[a:b] for t, w, a, b in zip(texts, whole, cuts, cuts[1:])]

    def _keep(self, known: pa.Array, ids: np.ndarray, size: np.ndarray, row: np.ndarray) -> None:
        """The table with the new words; when it is full, only words that were used since it was last cut, and short ones."""
        used = np.zeros(len(known), bool)
        used[:len(self.used)] = self.used
        used[row] = True
        if len(known) > WORD_CACHE:
            keep = used & (pc.binary_length(known).to_numpy(zero_copy_only=False) <= LONGEST_CACHED)
            if keep.sum() > WORD_CACHE // 2:
                keep[:] = False
                keep[row] = pc.binary_length(known.take(pa.array(row))).to_numpy(zero_copy_only=False) <= LONGEST_CACHED
            known, ids, size, used = known.filter(pa.array(keep)), ids[np.repeat(keep, size)], size[keep], np.zeros(int(keep.sum()), bool)
        self.known, self.ids, self.size, self.used = known, ids, size, used


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, max_tokens: int, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut only where longer than ``max_tokens``."""
    bounded_batches(docs.sparkSession, 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        tail = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode_batch(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, tail])
                for k, s in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[s:s + max_tokens]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # idle workers share the executor's memory

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  Weights say how much each resource's free share counts in the choice."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    score: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


class Plan(NamedTuple):
    """Placement rules ``(length, first rank, first sequence, offset)``, each valid to the next rule's rank; the number of
    sequences; and how many of them were closed as they had too little left of tokens, documents and attention."""

    rules: np.ndarray
    used: int
    closed: tuple[int, int, int]


def best_fit(histogram: dict[int, int], capacity: Capacity) -> Plan:
    """The plan for pieces given by the number of each length.

    A piece of rank r within its length goes to sequence ``first sequence + r -
    first rank`` at ``offset``.  A piece that no empty sequence can hold (its
    attention cost alone is above the capacity) is an error.
    """
    full = capacity.vector()
    weight = np.array(capacity.weights)
    state: dict[tuple[int, int, int], list[list[int]]] = {}  # free capacity -> ranges [first sequence, count]
    rules: list[tuple[int, int, int, int]] = []
    used = 0
    smallest = min(histogram, default=0)
    least = np.array([smallest, 1, smallest**2])
    closed = np.zeros(3, np.int64)

    def keep(free: tuple[int, int, int], first: int, count: int) -> bool:
        short = np.array(free) < least
        if not short.any():
            state.setdefault(free, []).append([first, count])
            return True
        closed[int(short.argmax())] += count
        return False

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of an empty sequence")
        frees = np.array(sorted(state), np.int64).reshape(-1, 3)
        frees = frees[(frees >= need).all(1)]
        counts = np.array([sum(c for _, c in state[tuple(f)]) for f in frees.tolist()], np.int64)
        while left:
            if not len(frees):
                per = int((full // need).min())
                for slot in range(per):  # sequences of this length alone, the last one perhaps not full
                    n = (left - slot + per - 1) // per
                    if n <= 0:
                        break
                    rules.append((length, rank, used, slot * length))
                    rank += n
                bins, last = -(-left // per), left % per or per
                if bins > 1:
                    keep(tuple((full - per * need).tolist()), used, bins - 1)
                keep(tuple((full - last * need).tolist()), used + bins - 1, 1)
                used += bins
                break
            share = (frees - need) / full if capacity.score == "norm" else -(frees / full) * (need / full)
            cost = (weight * share**2).sum(1) if capacity.score == "norm" else (weight * share).sum(1)
            best = int(cost.argmin())
            free = tuple(frees[best].tolist())
            take = min(left, int(counts[best]))
            after = tuple((frees[best] - need).tolist())
            moved, ranges = take, state[free]
            while moved:
                first, count = ranges[-1]
                n = min(count, moved)
                rules.append((length, rank, first, int(full[0]) - free[0]))
                kept = keep(after, first, n)
                rank, moved = rank + n, moved - n
                if n == count:
                    ranges.pop()
                else:
                    ranges[-1] = [first + n, count - n]
            left -= take
            if not ranges:
                del state[free]
            counts[best] -= take
            if not counts[best]:
                frees, counts = np.delete(frees, best, 0), np.delete(counts, best)
            if kept and (np.array(after) >= need).all():
                same = (frees == np.array(after)).all(1)
                if same.any():
                    counts[same] += take
                else:
                    frees, counts = np.vstack([frees, after]), np.append(counts, take)
    return Plan(np.array(sorted(rules), np.int64).reshape(-1, 4), used, tuple(closed.tolist()))


#: Documents of a sequence, as multiples of the mean, that :func:`balanced` tries.
SHARES = (24.0, 64.0)


def balanced(histogram: dict[int, int], capacity: Capacity) -> Plan:
    """A plan under a bound on documents that costs no sequence.

    A sequence of very many short documents is costly to mask.  So the number of
    documents is bound to a multiple of its mean, and free shares of documents
    and attention count in the choice; if that needs more sequences than tokens
    alone, a wider bound or none is taken.  A capacity that bounds documents
    itself is left as it is.  Attention is bound by the tokens: a piece of
    ``tokens`` has to fit.
    """
    loose = best_fit(histogram, capacity)
    if capacity.documents or not loose.used:
        return loose
    mean = sum(histogram.values()) / loose.used
    for share in SHARES:
        tight = best_fit(histogram, replace(capacity, documents=math.ceil(share * mean), weights=(1.0, 0.05, 0.01)))
        if tight.used <= loose.used:
            return tight
    return loose


def pack(parts: DataFrame, capacity: Capacity) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at least 1.

    Rows are placed one by one, so repeated rows are packed repeatedly; ties
    between equal pieces go by ``doc_id, piece``.  Other columns stay, but those
    named ``sequence_id`` or ``offset``, which are replaced.  An empty table gives
    an empty result.
    """
    spark = parts.sparkSession
    own = [c for c in parts.columns if c not in ("doc_id", "piece", "length", "sequence_id", "offset")]
    # other columns stay in one struct, so that none can clash
    parts = parts.select("doc_id", "piece", "length", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in own)).alias("own"))
    hist = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most max_tokens rows
    rules = balanced(hist, capacity).rules
    salts = spark.createDataFrame(sorted((n, -(-c // RANKED_TOGETHER)) for n, c in hist.items()), "length long, salts long")
    salted = parts.join(F.broadcast(salts), "length").withColumn(
        "salt", F.expr("pmod(xxhash64(doc_id, piece), salts)")).drop("salts")
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("before", "salt")
    shared = spark.sparkContext.broadcast(rules)  # bounded by max_tokens and the number of states, not by the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        key = rules[:, 0] << 44 | rules[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(rules[at, 2] + rank - rules[at, 1]), pa.array(rules[at, 3])],
                names=[*names, "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    placed = ranked.mapInArrow(place, schema)
    return placed.select("doc_id", "piece", "length", *(F.col(f"own.`{c}`").alias(c) for c in own), "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, max_tokens: int = 4096, end_id: int = 1, capacity: Capacity | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece.

    A null or empty text is the end id alone.  Rows are packed one by one, other
    columns are ignored, an empty table gives an empty result.
    """
    capacity = capacity or Capacity(tokens=max_tokens)
    parts = materialize(pieces(docs, path, max_tokens, end_id), "pieces")
    return pack(parts, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequence_fill(packed: DataFrame) -> DataFrame:
    """Fill of each sequence: ``sequence_id, documents, tokens``."""
    return packed.groupBy("sequence_id").agg(F.count("*").alias("documents"), F.sum("length").alias("tokens"))
