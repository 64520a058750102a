"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into full sequences and a rest. The histogram of piece lengths, at most `size` numbers whatever the input,
is packed on the driver: lengths from the longest to the shortest go to the packs that are shortest so far. Packs that are
alike are one pattern with a count. What comes out is, for each length, ranges of ranks with their sequences and offsets;
each piece finds its own by its rank among the pieces of its length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.llm.common import materialise, slices, text_bytes

SIZE, END = 4096, 2
#: Words of which a worker keeps the ids.
CACHE = 1_000_000


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of that length and ranks lie in consecutive sequences at
    that offset. Sequences are numbered from 0 without gaps."""
    free: list[tuple[int, int, int]] = []  # (-room, first sequence, count) of patterns with room, the roomiest first
    out, sequences = [], 0
    for length in sorted((n for n, k in histogram.items() if k and 0 < n <= size), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if free and -free[0][0] >= length:
                room, first, count = heapq.heappop(free)
                used = min(count, left)
                if used < count:
                    heapq.heappush(free, (room, first + used, count - used))
                room = -room
            else:
                first, used, room = sequences, left, size
                sequences += used
            out.append((length, rank, used, first, size - room))
            if room > length:
                heapq.heappush(free, (length - room, first, used))
            rank, left = rank + used, left - used
    return out


_encoders: dict[str, Encoder] = {}
#: Words of these letters alone are one token run each, and mean the same in lower case; other characters that may follow.
_PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_ASCII = re.compile(b"[a-z]+").fullmatch
_AFTER = b".,!?;:*$%&#|"


class Encoder(dict):
    """word -> its ids as 32-bit bytes. The tokenizer drops white space and no token spans it, so words can be kept apart.

    Words that are new are encoded together: those of plain letters, in lower case and without what follows them, in one
    call, whose ids fall apart after each end-of-word token."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.waiting: dict[bytes, bytearray] = {}
        tokenizer = Tokenizer.from_str(spec)
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> bytearray:
        """A place for the ids, which are written into it later."""
        return self.waiting.setdefault(word, bytearray())

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Of each text. When the cache is full, what is in it stays, which is mostly what is common."""
        get = self.__getitem__
        found = [list(map(get, t.split())) for t in texts]
        if self.waiting:
            places, self.waiting = self.waiting, {}
            full = len(self) >= CACHE
            added = self.add(places)
            for word, place in places.items():
                place += self[word]
            if full:
                for w in {w for some in added for w in some}:
                    del self[w]
        return [b"".join(f) for f in found]

    def add(self, new: Iterable[bytes]) -> tuple[Iterable[bytes], ...]:
        """Encodes new words; returns all that it adds, words without what follows them included."""
        parts, plain, other = [], set(), set()
        for w in new:
            core = w.rstrip(_AFTER)
            tail = w[len(core) :]
            if _ASCII(core):
                letters = True
            elif letters := _PLAIN.fullmatch(text := core.decode("utf-8", "replace")):
                core = text.lower().encode()
            if letters:
                if tail or core != w:
                    parts.append((w, core, tail))
                if core not in self:
                    plain.add(core)
                if tail and tail not in self:
                    other.add(tail)
            else:
                other.add(w)
        plain, other = list(plain), list(other)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.encode([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()
            data = ids.tobytes()
            assert len(cut) == len(some), "each plain word ends in one end-of-word token"
            self.update(zip(some, (data[a:b] for a, b in zip([0, *cut], cut))))
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            for w, e in zip(some, self.encode([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                self[w] = np.array(e.ids, np.uint32).tobytes()
        for w, core, tail in parts:
            self[w] = self[core] + self[tail] if tail else self[core]
        return plain, other, new


def _pieces(key: str, spec, size: int, end: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(spec.value)
        encoder, last = _encoders[key], np.array([end], np.uint32).tobytes()
        for b in slices(batches, 1, 1 << 19):
            out = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.ids(b.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                for a in range(0, n, size):
                    piece = ids[4 * a : 4 * (a + size)]
                    out.append((doc, a, len(piece) // 4, zlib.crc32(piece), n, piece if keep else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 6, (*[pa.int64()] * 5, pa.binary()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, keep: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens long, ids binary) for each piece of each row of docs: its ids, followed
    by the id `end`, cut after every `size` ids. ids are 32-bit little-endian, and null unless `keep`. tokenizer: a file of the tokenizers library,
    read on the driver only."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, spec, size, end, keep), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, offset = plan.value
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            at = (col["length"].to_numpy() << 44) + col["rank"].to_numpy()
            k = np.searchsorted(key, at, "right") - 1
            yield pa.RecordBatch.from_arrays([*(col[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(first[k] + at - key[k]), pa.array(offset[k])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ids_crc32, doc_tokens), which must stay as they are when
    read again. Ranks within a length go by part, and within it by doc_id and start. A length of n pieces has as many parts as
    a part has pieces, the root of n, so that neither the pieces nor the parts of a common length are many for a task."""
    lengths = materialise(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # at most size rows
    parts = lengths.select("length", F.ceil(F.sqrt("n")).cast("int").alias("parts"))
    rows = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")).cast("int"))
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    plan = np.array(sorted(pack_histogram(histogram, size)), np.int64).reshape(-1, 5)
    sent = pieces.sparkSession.sparkContext.broadcast(((plan[:, 0] << 44) + plan[:, 1], plan[:, 3], plan[:, 4]))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("r", F.row_number().over(order)).join(base.select("length", "part", "base"), ["length", "part"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("r") - 1).alias("rank"))
    return ranked.mapInArrow(_place(sent), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset long): a row for each piece of each row of
    docs(doc_id, text, ...). Pieces of a sequence follow each other from offset 0 without gaps and fill at most `size` ids.

    Null and empty text are the end id alone. A very long text is many pieces; its ids are in one worker's memory. Repeated
    rows are packed each for itself, in any order among them; other columns are ignored; empty input gives an empty result. The plan that is broadcast has a row for each range of ranks: a length adds at most one
    pattern of packs, and a pack takes as many ranges as it has pieces, so its size follows from the histogram alone and
    not from the number of documents.
    """
    found = token_pieces(docs, tokenizer, size, end, keep=False).drop("ids")
    return place(materialise(found, "pieces"), size)
