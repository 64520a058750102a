"""Substring dedup: word windows that also start in an earlier document, found behind a count-min prefilter.

0. All windows of an exact copy of an earlier document's text start there. Copies are known by their digests and take no part
   in what follows, so that a text in a third of all documents costs as much as one document.
1. Every partition counts what its windows may share in a count-min sketch of its own; the sketches are merged block by
   block. Equal windows of 50 words share the least hash of their 32-word grams, so one count for that hash (once a document)
   is never below the number of documents that hold the window: the sketch overestimates and loses none.
2. A second pass looks every window up and sends on only those whose estimate is two documents or more, with 128 bits of
   hash. Within a partition equal windows are settled at once, so that a passage in a third of all documents sends one row
   a partition; the rest meet by hash.
3. Windows that also start in a smaller doc_id go back to their documents and their words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srclake.llm.common import materialise, text_bytes

#: Rows of the sketch, and the cells of one block of a row.
ROWS, BLOCK_BITS = 2, 16
#: A row of the sketch has 2 ** bits cells; what is broadcast is a bit for each cell, 64 MB a row at most.
LEAST_BITS, MOST_BITS = 16, 29
#: Texts with copies that are broadcast at most, 24 bytes each: those with the most copies. Of others all copies take part.
COPIED = 1 << 21
#: Words of a gram; a window stands for its gram with the least hash.
GRAM = 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = {int(x): np.uint64(pow(int(x), -1, 1 << 64)) for x in (_A, _B)}
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(h: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * multiplier
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def rolling(x: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each `width` consecutive values of x: a polynomial in base, modulo 2^64."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * _powers(base, len(x)), dtype=np.uint64)))
    return _mixed((total[width:] - total[:-width]) * _powers(_INVERSE[int(base)], n), _MIX[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` words, given their hashes, the least hash of its grams."""
    gram = min(GRAM, width)
    grams = rolling(x, gram, _A)
    return _least(grams, width - gram + 1) if len(x) >= width else x[:0]


def cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    return [_mixed(anchor, _MIX[r]) >> np.uint64(64 - bits) for r in range(ROWS)]


def _pack(row: int, cell: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(sketch row, block, payload) of sorted distinct cells: 32 bits each, the lowest says that the count is over one."""
    block = cell >> np.uint64(BLOCK_BITS)
    cuts = np.concatenate(([0], np.nonzero(np.diff(block))[0] + 1, [len(cell)]))
    low = ((cell & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32) << np.uint32(1)) | many.astype(np.uint32)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield row, int(block[a]), low[a:b].tobytes()


class Copies:
    """The texts with copies that are broadcast: by 120 bits of their SHA-256, the smallest doc_id that has them."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, first: np.ndarray):
        order = np.argsort(k1)
        self.k1, self.k2, self.first = k1[order], k2[order], first[order]

    def later(self, doc: int | None, text: bytes) -> bool:
        """Whether a smaller doc_id has the same text."""
        if doc is None or not len(self.k1):
            return False
        key = hashlib.sha256(text).hexdigest()
        k1, k2 = int(key[:15], 16), int(key[15:30], 16)
        at = int(np.searchsorted(self.k1, k1))
        while at < len(self.k1) and self.k1[at] == k1:
            if self.k2[at] == k2:
                return doc > int(self.first[at])
            at += 1
        return False


def copied(rows: DataFrame, most: int = COPIED) -> Copies:
    """Copies among rows(doc_id, text binary)."""
    key = F.sha2("text", 256)
    groups = rows.where("doc_id is not null").select(key.alias("k"), "doc_id").groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    groups = materialise(groups.where("first < last").select(F.conv(F.substring("k", 1, 15), 16, 10).cast("long").alias("k1"), F.conv(F.substring("k", 16, 15), 16, 10).cast("long").alias("k2"), "first", "n"), "copies")
    sizes = sorted(((r["n"], r["groups"]) for r in groups.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True)  # distinct sizes only
    least, sent = 1 << 62, 0
    for n, g in sizes:
        if sent + g > most:
            break
        least, sent = n, sent + g
    table = groups.where(F.col("n") >= least).select("k1", "k2", "first").toArrow()
    return Copies(*(table[c].to_numpy() for c in ("k1", "k2", "first")))


def _sketch(copies, width: int, bits: int, flush_at: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, who = [], 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            found = np.concatenate(held)
            out = [x for r, c in enumerate(cells(found, bits)) for x in _pack(r, *(lambda v, k: (v, k > 1))(*np.unique(c, return_counts=True)))]
            r, k, p = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(k, pa.int32()), pa.array([who] * len(r), pa.int32()), pa.array(p, pa.binary())], ["row", "block", "part", "payload"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if doc is None or copies.value.later(doc, text):
                    continue
                found = np.unique(anchors(word_hashes(text.split()), width))  # once for each document
                held.append(found)
                n += len(found)
                if n >= flush_at:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up payloads block by block, as they come, with one array of counts for each block of the task."""
    total: dict[tuple[int, int, int], np.ndarray] = {}
    for b in batches:
        for row, block, part, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
            at = np.frombuffer(payload, np.uint32)
            count = total.setdefault((row, block, part), np.zeros(1 << BLOCK_BITS, np.uint8))
            cell = at >> np.uint32(1)  # distinct within a payload
            count[cell] = np.minimum(count[cell] + (at & np.uint32(1)).astype(np.uint8) + 1, 2)
    for (row, block, part), count in total.items():
        cell = np.nonzero(count)[0].astype(np.uint32)
        payload = ((cell << np.uint32(1)) | (count[cell] > 1)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())], ["row", "block", "part", "payload"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _merge(batches):
        at = np.frombuffer(b.column(3)[0].as_py(), np.uint32)
        flags = np.zeros(1 << BLOCK_BITS, bool)
        flags[at[(at & 1) == 1] >> np.uint32(1)] = True
        if flags.any():
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["row", "block", "flags"])


def repeated_cells(rows: DataFrame, copies, width: int, bits: int) -> np.ndarray:
    """For each sketch row, a bit for every cell: whether it counted two or more. rows(doc_id, text binary)."""
    schema = "row int, block int, part int, payload binary"
    parts = rows.mapInArrow(_sketch(copies, width, bits), schema)
    few = parts.withColumn("part", F.floor(F.col("part") / 64).cast("int")).repartition("row", "block", "part").mapInArrow(_merge, schema)
    merged = few.withColumn("part", F.lit(0)).repartition("row", "block").mapInArrow(_repeated, "row int, block int, flags binary")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for r in merged.toLocalIterator():  # at most ROWS * 2 ** (MOST_BITS - 3) bytes in all, whatever the input's size
        out[r["row"], r["block"] << (BLOCK_BITS - 3) : (r["block"] + 1) << (BLOCK_BITS - 3)] = np.frombuffer(r["flags"], np.uint8)
    return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _resolve(copies, flags, width: int, bits: int):
    """Of each row: doc_id, uid, words and, if none of its windows can repeat, its digest; else its text. Of windows that may
    repeat: the earliest documents of the partition with their starts (h1, h2, start, or starts if
    there are several), and starts that are settled here."""
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("starts", pa.list_(pa.int32()))])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def maybe(anchor: np.ndarray) -> np.ndarray:
        ok = np.ones(len(anchor), bool)
        for r, c in enumerate(cells(anchor, bits)):
            ok &= (flags.value[r][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok

    def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, uid, start = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((start, uid, doc, h2, h1))
        h1, h2, doc, uid, start = (x[order] for x in (h1, h2, doc, uid, start))
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        late = np.nonzero(doc > first)[0]
        if len(late):
            late = late[np.lexsort((start[late], uid[late]))]
            u = uid[late]
            cuts = np.concatenate(([0], np.nonzero(np.diff(u))[0] + 1, [len(u)]))
            yield batch(uid=u[cuts[:-1]], starts=lists(start[late], cuts))
        keep = doc == first
        h1, h2, doc, uid, start = (x[keep] for x in (h1, h2, doc, uid, start))
        cuts = np.concatenate(([0], np.nonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (uid[1:] != uid[:-1]))[0] + 1, [len(doc)]))
        for a in range(0, len(cuts) - 1, 100_000):
            c = cuts[a : a + 100_001]
            at, many = c[:-1], np.diff(c) > 1
            full = lists(start[c[0] : c[-1]], c - c[0])
            yield batch(doc_id=doc[at], uid=uid[at], h1=h1[at].view(np.int64), h2=h2[at].view(np.int64), start=start[at], starts=pc.if_else(pa.array(many), full, pa.nulls(len(at), full.type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting, uid = 0, TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                uid += 1
                text = text.as_py()
                words = text.split()
                if len(words) >= width and copies.value.later(doc, text):
                    out.append((doc, uid, len(words), len(words), _digest([]), None))
                    continue
                x = word_hashes(words)
                at = np.nonzero(maybe(anchors(x, width)))[0] if doc is not None else []
                if len(at):
                    n = len(at)
                    held.append((rolling(x, width, _A)[at], rolling(x, width, _B)[at], np.full(n, doc), np.full(n, uid), at.astype(np.int32)))
                    waiting += n
                out.append((doc, uid, len(words), 0, None if len(at) else _digest(words), text if len(at) else None))
            yield batch(**dict(zip(("doc_id", "uid", "n_words", "n_removed", "kept_sha256", "text"), map(list, zip(*out))))) if out else batch(doc_id=[])
            if waiting > 2_000_000:
                yield from settle(held)
                held, waiting = [], 0
        if held:
            yield from settle(held)

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = text.as_py().split()
                at = np.concatenate([np.zeros(0, np.int32), *(x.values.to_numpy() for x in starts)]) if starts.is_valid else np.zeros(0, np.int32)
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((doc, len(words), int(gone.sum()), b" ".join(kept), _digest(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def sketch_bits(n_bytes: int) -> int:
    """About four cells for each count: a window adds one new anchor in ten words or so, a word has six bytes or so."""
    return min(max(int(n_bytes / 60 * 4).bit_length(), LEAST_BITS), MOST_BITS)


def repeated_passages(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed long, kept_sha256 string, kept string): a row for each row of docs(doc_id, text, ...).

    Removes each word that a window of `width` words covers whose words, in order, also start in a document with a smaller
    doc_id. kept is the remaining words joined by one space, and null for rows that lose nothing. Null text is empty; rows
    whose doc_id is null, and rows with equal doc_ids, take nothing from each other. Texts with fewer words than a window
    lose nothing. Other columns are ignored, whatever their names; empty input gives an empty result.

    The sketch grows with the text up to 2 ** MOST_BITS cells a row; beyond some 30 GB of text its estimates rise and the
    second pass sends on more windows, but the result stays the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    bits = sketch_bits(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    sc = docs.sparkSession.sparkContext
    copies = sc.broadcast(copied(rows))
    flags = sc.broadcast(repeated_cells(rows, copies, width, bits))
    schema = "doc_id long, uid long, n_words long, n_removed long, kept_sha256 string, text binary, h1 long, h2 long, start int, starts array<int>"
    found = materialise(rows.mapInArrow(_resolve(copies, flags, width, bits), schema), "windows")
    hashed = found.where("h1 is not null").select("h1", "h2", "doc_id", "uid", "start", "starts")
    # At most one document's rows for each partition of the input share a hash.
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    late = hashed.withColumn("first", first).where("doc_id > first").select("uid", F.coalesce("starts", F.array("start")).alias("starts"))
    late = late.unionByName(found.where("h1 is null and starts is not null").select("uid", "starts"))
    starts = late.groupBy("uid").agg(F.collect_list("starts").alias("starts"))
    open_rows = found.where("text is not null").select("uid", "doc_id", "text").join(starts, "uid", "left").select("doc_id", "text", "starts")
    cut = open_rows.mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    done = found.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", F.when(F.col("n_removed") > 0, "").alias("kept"), "kept_sha256")
    return done.unionByName(cut.withColumn("kept", F.when(F.col("n_removed") > 0, F.col("kept").cast("string"))))
