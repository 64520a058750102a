"""SimHash near-duplicates: tiles of fingerprints compared exactly with exclusive-or and bit counts.

Finding every pair of n fingerprints within a radius by tiles alone costs n^2 comparisons, so tiles are made of fingerprints
that agree in some bits: 64 bits are cut into m segments, and two fingerprints that differ in r bits or fewer agree in at
least m - r segments (pigeonhole). A cell holds all fingerprints with the same values in one choice of m - r segments.
Within a cell rows are ordered by population count and cut into tiles; tile pairs whose population counts differ beyond the
radius are skipped, the others are compared in full. The result is exact for any m > r.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import materialise, slices, text_bytes
from srclake.llm.components import components

SEED = 42
#: Fingerprints in a tile: a comparison holds TILE * TILE numbers of 8 bytes.
TILE = 512
#: Distinct fingerprints of one cell that a task takes at most; larger cells are cut into a grid of groups.
CELL = 16384


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def segments(n: int, radius: int) -> int:
    """Segments to cut 64 bits into, so that n spread-out fingerprints leave few in a cell: more segments make cells smaller
    and copies more. radius + 1 segments are the fewest."""
    m = radius + 1
    while m < radius + 3 and n > 1024 << (64 * (m - radius) // m):
        m += 1
    return m


def cell_keys(fp: Column, m: int, radius: int) -> Column:
    """For each choice of m - radius segments: its number, and fp with the other segments' bits cleared."""
    edges = [64 * i // m for i in range(m + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in c) for c in combinations(range(m), m - radius)]
    return F.array(*[F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x)).alias("bits")) for k, x in enumerate(masks)])


def link_cell(fp: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the same fingerprints as all pairs within the radius would, without one row per pair.

    Every fingerprint starts as its own label. Tiles are compared, labels of near fingerprints become the lesser one, and
    each change of a label is a link between the old and the new one. side: compare only across its two values."""
    order = np.lexsort((fp, np.bitwise_count(fp)))
    fp, side = fp[order], None if side is None else side[order]
    count = np.bitwise_count(fp).astype(np.int16)
    label, us, vs = np.arange(len(fp)), [], []
    for a in range(0, len(fp), TILE):
        x = slice(a, min(a + TILE, len(fp)))
        for b in range(a, len(fp), TILE):
            y = slice(b, min(b + TILE, len(fp)))
            if count[y][0] - count[x][-1] > radius:
                break  # rows are in order of their counts: all later tiles are further away
            near = np.bitwise_count(fp[x, None] ^ fp[None, y]) <= radius
            if side is not None:
                near &= side[x, None] != side[None, y]
            i, j = np.nonzero(near)
            i, j = i[(i + a) != (j + b)] + a, j[(i + a) != (j + b)] + b
            while len(i):
                low = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                changed = np.nonzero(new != label)[0]
                if not len(changed):
                    break
                us.append(label[changed])
                vs.append(new[changed])
                label = new
    if not us:
        return fp[:0], fp[:0]
    pairs = np.unique(np.stack((np.concatenate(us), np.concatenate(vs)), axis=1), axis=0)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal columns, of rows in that order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([*held, b]).combine_chunks()
        key = np.stack([rows[c].to_numpy().astype(np.int64) for c in columns], axis=1)
        cuts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1))
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield rows.slice(x, y - x)
        held = rows.slice(cuts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of cells; a cell holds at most two groups, so what is held at a time is bounded.
        for cell in groups(batches, ("part", "bits", "a", "b")):
            if len(cell) > 1:
                fp, side = cell["fp"].to_numpy().view(np.uint64), cell["side"].to_numpy()
                split = cell["a"][0].as_py() != cell["b"][0].as_py()
                u, v = link_cell(fp, side if split else None, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) links between the distinct fingerprints fps(fp): as connected as all pairs at the radius or nearer.

    A cell with more than CELL fingerprints is dealt into g groups; its rows go to the cells (a, b) of a g x g grid, so that
    a cell never outgrows a task. Only distinct fingerprints come here: any number of exact copies is one row."""
    m = segments(fps.count(), radius)
    cells = fps.select("fp", F.explode(cell_keys(F.col("fp"), m, radius)).alias("k")).select("fp", "k.part", "k.bits")
    large = cells.groupBy("part", "bits").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("part", "bits", F.ceil(2 * F.col("n") / CELL).cast("int").alias("g"))
    dealt = cells.join(large, ["part", "bits"], "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    dealt = dealt.select("fp", "part", "bits", "s", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("t"))
    dealt = dealt.select("fp", "part", "bits", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), (F.col("s") > F.col("t")).cast("byte").alias("side"))
    # With s = t the row is in the diagonal cell once: all pairs within a group are compared there, those across in (a, b).
    return dealt.repartition("part", "bits", "a", "b").sortWithinPartitions("part", "bits", "a", "b").mapInArrow(_link(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id long, fp long, component_id long): one row per row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links of `radius` or fewer differing bits reach, the row's own included. Null
    text is empty text; texts without words have fingerprint 0 and link like any other. Rows whose doc_id is null are
    linked, but give no component_id (a component of such rows only has null). Repeated rows and repeated doc_ids each
    give a row. A very long text is hashed in blocks of shingles, its words are in one worker's memory. Other columns are
    ignored, whatever their names; empty input gives an empty result.
    """
    rows = materialise(with_fingerprints(docs, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(fps.select("fp"), radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    of = materialise(fps.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
