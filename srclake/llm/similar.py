"""Near-duplicates by shared shingles, with SimHash tiles in front: which texts have a Jaccard similarity of 0.8 or more.

1. Every text has a SimHash fingerprint, a parity sketch and a prefix of its shingle hashes, those of frequent shingles last.
2. A first pass links each text to the nearest fingerprint, by tiles of exclusive-or and bit counts, among texts that agree
   in one of some least hashes, and checks that pair on its shingles. It joins what is easily found, so that large groups of
   near copies cost little afterwards; what it misses does not matter.
3. A second pass compares all texts of different groups that share a hash of their prefixes: tiles of parity sketches, by
   exclusive-or and bit counts, leave out only pairs that cannot be similar; the others are checked on their shingles.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import few, materialise, slices, text_bytes
from srclake.llm.components import components
from srclake.llm.simhash import TILE, groups

#: Least hashes of which one must agree for two texts to meet in the first pass, and the bits in which their fingerprints
#: differ there at most.
HASHES, WIDE = 8, 20
#: Rows of a cell that a task takes at most; rows of a cell up to which cells are compared many at once.
CELL, SMALL = 16384, 32
#: Bits of a parity sketch, at least (bit k: an odd number of shingle hashes is k modulo the bits): each element that only
#: one of two sets has turns one bit, so sketches never differ in more bits than their sets in elements.
BITS = 1024
#: Shingles of a text that a cell of CELL texts has room for.
ROOM = 256
#: Shingles are counted in 2 ** bits buckets; a block of them is merged in one task.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 24, 16
_A = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.array([xxhash.xxh64_intdigest(b"%d" % k) | 1 for k in range(HASHES)], np.uint64)


class Words(dict):
    """word -> its XXH64."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        return self.setdefault(word, xxhash.xxh64_intdigest(word))


_words = Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A 64-bit hash of each `shingle` consecutive words; of fewer words, one of them all."""
    if not words:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(x))
    n = len(x) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = _mixed(h * _A + x[j : j + n])
    return h


def _normal(text: bytes) -> list[bytes]:
    return text.lower().split()


def _key(words: list[bytes]) -> tuple[int, int]:
    """128 bits that tell sequences of words apart."""
    digest = hashlib.sha256(b" ".join(words)).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def _fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _parity(own: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    return np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def prefix(own: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the hashes, in order of level and value, so many that two similar sets have one of them in common: a
    similar set shares ceil(similarity * size) elements at least, so the parts before those must meet. Any order that is
    the same for all sets will do; frequent shingles last make small cells."""
    n = len(own)
    own = np.concatenate([own[level == k] for k in range(4)])
    return own[: n - math.ceil(similarity * n - 1e-9) + 1]


def _counts(shingle: int, bits: int, flush_at: int = 4_000_000):
    """(block, payload): how many texts' shingles fall in each bucket, as a compressed array of 16-bit counts a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.sort(np.concatenate(held))
            cuts = np.searchsorted(found, np.arange((1 << (bits - BLOCK_BITS)) + 1) << BLOCK_BITS)
            for block, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                if y > x:
                    count = np.bincount(found[x:y] - (block << BLOCK_BITS), minlength=1 << BLOCK_BITS)
                    payload = zlib.compress(np.minimum(count, 65535).astype(np.uint16).tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([payload], pa.binary())], ["block", "payload"])

        for b in slices(batches, 0):
            for text in b.column(0):
                held.append((np.unique(shingle_hashes(_normal(text.as_py()), shingle)) >> np.uint64(64 - bits)).astype(np.int32))
                n += len(held[-1])
                if n >= flush_at:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: how far each bucket's count is above what chance gives, in four levels."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
            count = np.frombuffer(zlib.decompress(payload.as_py()), np.uint16)
            total[block] = total[block] + count if block in total else count.astype(np.int64)
    for block, count in total.items():
        above = (count - count.mean() - 6 * math.sqrt(count.mean()) - 4) / (4 + math.sqrt(count.mean()))
        level = (above > 0).astype(np.uint8) + (above > 16) + (above > 256)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(level.astype(np.uint8).tobytes(), 1)], pa.binary())], ["block", "level"])


def bucket_levels(whole: DataFrame, shingle: int) -> np.ndarray:
    """A level from 0 to 3 for each bucket of shingle hashes, from all texts; 2 ** MOST_BITS bytes at most. It decides the
    order of a prefix and with it the cost, never what is similar."""
    n_bytes = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((n_bytes // 60).bit_length(), LEAST_BITS), MOST_BITS)
    counts = whole.select("text").mapInArrow(_counts(shingle, bits), "block int, payload binary")
    found = counts.repartition("block").mapInArrow(_levels, "block int, level binary")
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in found.toLocalIterator():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
    return out.reshape(-1)


def _sketches(shingle: int, similarity: float, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        shift = np.uint64(64 - (len(level).bit_length() - 1))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        for b in slices(batches, 1):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = _normal(text.as_py())
                every = shingle_hashes(words, shingle)
                own = np.unique(every)
                low = [int(_mixed((own ^ t) * t).min() >> np.uint64(1)) if len(own) else 0 for t in _TURN]
                first = prefix(own, level[(own >> shift).astype(np.int64)], similarity) if len(own) else own
                out.append((doc, *_key(words), _fingerprint(every), low, len(own), _parity(own), first.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["doc_id", "k1", "k2", "fp", "low", "size", "parity", "prefix"])

    return run


def _own(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out = []
            for text in b.column(1):
                words = _normal(text.as_py())
                out.append((*_key(words), np.unique(shingle_hashes(words, shingle)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "own"])

    return run


def _sets(whole: DataFrame, texts: DataFrame, uids: DataFrame, shingle: int) -> DataFrame:
    """(uid, own): the sorted shingle hashes of these texts, from the documents again, so that the sets of all other texts
    are never stored. A text whose document has several rows may come several times."""
    needed = few(materialise(texts.join(few(materialise(uids.distinct(), "uids")), "uid", "left_semi").select("uid", "k1", "k2", F.col("first").alias("doc_id")), "needed"))
    found = whole.join(needed.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_own(shingle), "k1 long, k2 long, own binary")
    return materialise(found.join(needed.select("uid", "k1", "k2"), ["k1", "k2"]).select("uid", "own"), "sets")


def nearest_before(fp: np.ndarray, order: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the nearest fingerprint, within the radius, among rows that are before it in order; else
    -1; and the bits in which they differ."""
    by_count = np.argsort(np.bitwise_count(fp), kind="stable")
    x, f = fp[by_count], order[by_count]
    count = np.bitwise_count(x).astype(np.int16)
    best, where = np.full(len(fp), radius + 1, np.int16), np.full(len(fp), -1)

    def update(i: slice, j: slice, d: np.ndarray) -> None:
        d = np.where(f[j][None, :] < f[i][:, None], d, radius + 1)
        k = d.argmin(axis=1)
        d = d[np.arange(len(k)), k]
        better = d < best[i]
        best[i] = np.where(better, d, best[i])
        where[i] = np.where(better, k + j.start, where[i])

    for a in range(0, len(fp), TILE):
        i = slice(a, min(a + TILE, len(fp)))
        for b in range(a, len(fp), TILE):
            j = slice(b, min(b + TILE, len(fp)))
            if count[j][0] - count[i][-1] > radius:
                break  # rows are in order of their counts: all later tiles are further away
            d = np.bitwise_count(x[i, None] ^ x[None, j]).astype(np.int16)
            update(i, j, d)
            if b > a:
                update(j, i, d.T)
    place, differ = np.full(len(fp), -1), np.full(len(fp), radius + 1)
    place[by_count], differ[by_count] = np.where(where >= 0, by_count[where], -1), best
    return place, differ


def _nearest(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ("cell", "s")):
            if cell.num_rows > 1:
                uid = cell["uid"].to_numpy()
                to, d = nearest_before(cell["fp"].to_numpy().view(np.uint64), uid, radius)
                hit = to >= 0
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(uid[to[hit]]), pa.array(d[hit], pa.int32())], ["u", "v", "d"])

    return run


def _first_pass(texts: DataFrame, radius: int) -> DataFrame:
    """(u, v): for each text that has some, the nearest earlier one. Cells of more than CELL texts are dealt into parts, each
    of which also has the cell's first text, so that a group of copies is not taken apart."""
    cells = texts.select("uid", "fp", F.posexplode("low").alias("k", "h")).select(F.xxhash64("k", "h").alias("cell"), "uid", "fp")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.struct("uid", "fp")).alias("head")).where("n > 1")
    sizes = few(materialise(sizes.select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("g"), "head"), "cells"))
    dealt = cells.join(sizes.select("cell", "g"), "cell").select("cell", F.pmod(F.xxhash64("uid"), F.col("g")).cast("int").alias("s"), "uid", "fp")
    heads = sizes.where("g > 1").select("cell", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("s"), "head.uid", "head.fp")
    found = dealt.unionByName(heads).repartition("cell", "s").sortWithinPartitions("cell", "s").mapInArrow(_nearest(radius), "u long, v long, d int")
    return found.groupBy("u").agg(F.min_by("v", F.struct("d", "v")).alias("v"))


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(u, v) whose sets are similar."""
    both = pairs.join(sets.select(F.col("uid").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("uid").alias("v"), F.col("own").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(_verify(similarity), "u long, v long")


def _may_be(size_x: np.ndarray, size_y: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """False only where sets of these sizes, with sketches that differ in so many bits, cannot be similar."""
    least, most = np.minimum(size_x, size_y), np.maximum(size_x, size_y)
    return (least >= similarity * most - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * (least + most) + 1e-6)


class Sketches:
    """Parity sketches of several widths. Those of twice a width are folded to it: bits that are equal modulo the width are
    added, which keeps the bound."""

    def __init__(self, data: list[bytes]):
        self.width = np.array([len(x) for x in data])
        self.bits: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own, wide = np.nonzero(self.width == w)[0], np.nonzero(self.width == 2 * w)[0]
            bits = np.frombuffer(b"".join(data[i] for i in own), np.uint64).reshape(len(own), -1)
            twice = np.frombuffer(b"".join(data[i] for i in wide), np.uint64).reshape(len(wide), 2 * bits.shape[1])
            self.bits[w] = np.concatenate((bits, twice[:, : bits.shape[1]] ^ twice[:, bits.shape[1] :]))
            self.place[w] = np.full(len(data), -1)
            self.place[w][np.concatenate((own, wide))] = np.arange(len(own) + len(wide))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows whose widths differ by one step at most."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            k = np.nonzero(least == w)[0]
            for a in range(0, len(k), 65536):
                some = k[a : a + 65536]
                out[some] = np.bitwise_count(self.bits[w][self.place[w][i[some]]] ^ self.bits[w][self.place[w][j[some]]]).sum(axis=1, dtype=np.int64)
        return out

    def tile(self, w: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of all pairs of rows of x and y, whose widths are w or twice that."""
        a, b = self.bits[w][self.place[w][x]], self.bits[w][self.place[w][y]]
        out = np.zeros((len(x), len(y)), np.int32)
        for k in range(a.shape[1]):
            out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
        return out


def near_pairs(cuts: np.ndarray, size: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of small cells, all at once: the places of rows of different roots whose sizes allow them to be similar."""
    length, us, vs = np.diff(cuts), [cuts[:0]], [cuts[:0]]
    cell = np.repeat(np.arange(len(length)), length)
    for d in range(1, int(length.max())):  # each row and the one d further
        i = np.nonzero((cell[:-d] == cell[d:]) & (root[:-d] != root[d:]))[0]
        i = i[_may_be(size[i], size[i + d], np.zeros(len(i)), similarity)]
        us.append(i)
        vs.append(i + d)
    return np.concatenate(us), np.concatenate(vs)


def close_rows(size: np.ndarray, sketches: Sketches, root: np.ndarray, side: np.ndarray | None, similarity: float) -> np.ndarray:
    """Of the rows of a large cell, which may be similar to one of another root (and, of a split cell, of the other side)."""
    close, order = np.zeros(len(size), bool), np.argsort(size, kind="stable")
    width = sketches.width[order]
    for w in np.unique(width).tolist():
        left, right = order[width == w], order[(width == w) | (width == 2 * w)]
        for a in range(0, len(left), TILE):
            x = left[a : a + TILE]
            for b in range(0, len(right), TILE):
                y = right[b : b + TILE]
                if size[x[-1]] < similarity * size[y[0]] - 1e-6:
                    break  # rows are in order of their sizes: all later tiles are larger still
                if size[y[-1]] < similarity * size[x[0]] - 1e-6:
                    continue
                may = root[x][:, None] != root[y][None, :]
                if side is not None:
                    may &= side[x][:, None] != side[y][None, :]
                if may.any():
                    may &= _may_be(size[x][:, None], size[y][None, :], sketches.tile(w, x, y), similarity)
                    close[x[may.any(axis=1)]] = close[y[may.any(axis=0)]] = True
    return close


def _mixed_cells(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Like groups, but many groups at a time, with where each begins and the last ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([*held, b]).combine_chunks()
        key = np.stack([rows[c].to_numpy().astype(np.int64) for c in columns], axis=1)
        cuts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1))
        if len(cuts) > 1:
            yield rows.slice(0, cuts[-1]), cuts
        held = rows.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.array([0, rows.num_rows])


def _pairs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _mixed_cells(batches, ("cell",)):
            uid = rows["uid"].to_numpy()
            u, v = near_pairs(cuts, rows["size"].to_numpy().astype(np.int64), rows["root"].to_numpy(), similarity)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[u], uid[v])), pa.array(np.maximum(uid[u], uid[v]))], ["u", "v"])

    return run


def _close(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups((x.slice(a, 1024) for x in batches for a in range(0, x.num_rows, 1024)), ("cell", "a", "b")):
            size, root, side, uid = (cell[c].to_numpy() for c in ("size", "root", "side", "uid"))
            split = cell["a"][0].as_py() != cell["b"][0].as_py()
            close = close_rows(size.astype(np.int64), Sketches(cell["parity"].to_pylist()), root, side if split else None, similarity)
            if close.any():
                name = pa.array(np.full(close.sum(), xxhash.xxh64_intdigest(np.sort(uid[close]).tobytes()) >> 1))  # cells with the same rows get the same name
                yield pa.RecordBatch.from_arrays([name, *(cell[c].combine_chunks().filter(pa.array(close)) for c in ("a", "b", "uid", "root", "side"))], ["cell", "a", "b", "uid", "root", "side"])

    return run


def _likely(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [b.column(i).to_numpy().astype(np.int64) for i in (2, 4)]
            sketches, n = Sketches(b.column(3).to_pylist() + b.column(5).to_pylist()), b.num_rows
            i = np.nonzero(_may_be(*size, np.zeros(n), similarity))[0]
            i = i[_may_be(size[0][i], size[1][i], sketches.differ(i, i + n), similarity)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).take(pa.array(i))

    return run


def likely(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The stored pairs(u, v) without those whose sizes or sketches show that they are not similar."""
    uids = few(materialise(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct(), "uids"))
    side = lambda name, n: texts.join(uids, "uid", "left_semi").select(F.col("uid").alias(name), F.col("size").alias(f"size{n}"), F.col("parity").alias(f"parity{n}"))
    both = pairs.join(side("u", 1), "u").join(side("v", 2), "v").select("u", "v", "size1", "parity1", "size2", "parity2")
    return materialise(both.mapInArrow(_likely(similarity), "u long, v long"), "likely")


def link_sets(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets: as connected, with the roots, as all similar pairs. All pairs whose labels differ and whose
    sizes allow it are tested; a link merges the labels, so there are fewer links than sets. side: as in link_cell."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order])
    at = np.concatenate(([0], np.cumsum(size)))
    label, side, found = np.unique(root[order], return_inverse=True)[1], None if side is None else side[order], []
    names, code = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(names), bool)
    for i in range(len(order)):
        upto = np.searchsorted(size, size[i] / similarity + 1e-6, "right")
        j = np.arange(i + 1, upto)
        j = j[label[j] != label[i]] if side is None else j[(label[j] != label[i]) & (side[j] != side[i])]
        if not len(j):
            continue
        mark[code[at[i] : at[i + 1]]] = True
        if 8 * len(j) < upto - i:
            both = np.array([np.count_nonzero(mark[code[at[k] : at[k + 1]]]) for k in j])
        else:
            sums = np.concatenate(([0], np.cumsum(mark[code[at[i + 1] : at[upto]]])))
            both = sums[at[j + 1] - at[i + 1]] - sums[at[j] - at[i + 1]]
        mark[code[at[i] : at[i + 1]]] = False
        for k in j[both >= similarity * (size[i] + size[j] - both)]:
            if label[k] != label[i]:
                found.append((int(order[i]), int(order[k])))
                label[label == label[k]] = label[i]
    return found


def _overlaps(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups((x.slice(a, 1024) for x in batches for a in range(0, x.num_rows, 1024)), ("cell", "a", "b")):
            uid, split = cell["uid"].to_numpy(), cell["a"][0].as_py() != cell["b"][0].as_py()
            found = link_sets([np.frombuffer(x, np.uint64) for x in cell["own"].to_pylist()], cell["root"].to_numpy(), cell["side"].to_numpy() if split else None, similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(uid[list(x)]) for x in zip(*found)], ["u", "v"])

    return run


def _across(whole: DataFrame, texts: DataFrame, found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): links that, with the groups found(uid, root), join the same texts as all similar pairs.

    Similar texts have a hash of their prefixes in common, so each such hash is a cell; only cells with texts of different
    groups matter. There all texts of different groups are compared, first by size and parity sketch, which exclude none that
    is similar, then by their sets: those of small cells as pairs, those of large cells in their cell, so that it gives no
    more links than it has rows. A cell too large for a task is cut into a grid."""
    placed = texts.select("uid", "size", "prefix").join(few(found), "uid", "left").select("uid", "size", F.coalesce("root", "uid").alias("root"), F.explode("prefix").alias("cell"))
    mixed = placed.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), F.sum("size").alias("load"))
    mixed = materialise(mixed.where("x <> y").select("cell", F.greatest("n", F.ceil(F.col("load") / ROOM)).alias("load"), (F.col("n") <= SMALL).alias("small")), "mixed")
    inside = materialise(placed.join(few(mixed), "cell"), "inside")
    # Two texts meet in many cells: pairs are tested once, and so are large cells of the same texts.
    small = inside.where("small").repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs(similarity), "u long, v long")
    pairs = likely(materialise(small.distinct(), "pairs"), texts, similarity)
    large = inside.where("not small").withColumn("g", F.when(F.col("load") > CELL, F.ceil(2 * F.col("load") / CELL)).otherwise(1).cast("int"))
    large = large.join(texts.select("uid", "parity"), "uid").withColumn("s", F.pmod(F.xxhash64("uid"), F.col("g")).cast("int"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("t"))
    large = large.select("cell", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "uid", "root", "size", "parity", (F.col("s") > F.col("t")).cast("byte").alias("side"))
    crowds = large.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(_close(similarity), "cell long, a int, b int, uid long, root long, side byte")
    crowds = materialise(crowds.distinct(), "crowds")
    sets = _sets(whole, texts, pairs.select(F.explode(F.array("u", "v")).alias("uid")).unionAll(crowds.select("uid")), shingle)
    crowded = crowds.join(sets, "uid").repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(_overlaps(similarity), "u long, v long")
    return _verified(pairs, sets, similarity).unionAll(crowded)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """(doc_id, component_id): a row for each row of docs(doc_id, text, ...) with a doc_id; component_id is the smallest
    doc_id that is reached by links between texts whose sets of `shingle`-word shingles have a Jaccard similarity of
    `similarity` or more. No link is missed, whatever the size of a cell or a group.

    Texts with the same words, A-Z and a-z being the same, are one text throughout; equal shingles are those with equal
    64-bit hashes. Null text is empty; texts without words are similar to each other only; texts with fewer words than a
    shingle are one shingle. Of several nearest texts, the first pass takes the earliest. A very long text has a sketch and a
    prefix in proportion to its length, and its shingle hashes are in one worker's memory. Other columns are ignored; empty
    input gives an empty result.
    """
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    levels = docs.sparkSession.sparkContext.broadcast(bucket_levels(whole, shingle))
    rows = whole.mapInArrow(_sketches(shingle, similarity, levels), "doc_id long, k1 long, k2 long, fp long, low array<long>, size int, parity binary, prefix array<long>")
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    # One row stands for all rows with the same words.
    heads = materialise(rows.groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first")), "texts")
    texts = rows.drop("doc_id", "k1", "k2").join(few(heads), "uid")
    pairs = likely(materialise(_first_pass(texts, radius), "pairs"), texts, similarity)
    sets = _sets(whole, texts, pairs.select(F.explode(F.array("u", "v")).alias("uid")), shingle)
    found = materialise(components(_verified(pairs, sets, similarity)).withColumnsRenamed({"node": "uid", "component": "root"}), "found")
    links = found.select(F.col("uid").alias("u"), F.col("root").alias("v")).unionAll(_across(whole, texts, found, shingle, similarity))
    found = components(links).withColumnsRenamed({"node": "uid", "component": "root"})
    of = materialise(heads.join(found, "uid", "left").select("k1", "k2", "first", F.coalesce("root", "uid").alias("root")), "groups")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "k1", "k2").join(of.join(least, "root").select("k1", "k2", "component_id"), ["k1", "k2"]).select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs(doc_id, text, ...), with all their columns, of each group of near-duplicates those with the smallest
    doc_id. Rows without a doc_id stay. Repeated rows and rows with equal doc_ids stay or go together. The doc_ids that go
    are joined; up to FEW of them are broadcast, so that no text is shuffled."""
    found = similar_documents(docs, shingle, similarity)
    gone = few(materialise(found.groupBy("doc_id").agg(F.min("component_id").alias("first")).where("first < doc_id").select(F.col("doc_id").alias("gone")), "gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
