"""Toxicity: a factorization machine over hashed terms.

Terms are words in lower case and their first four, five and six letters, so that inflected forms share some. The machine
scores a text by w0 + sum(w_i) + sum of <v_i, v_j> over pairs of its terms: a pair such as an insult and the mention of a
group has a weight of its own, which an additive model lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import slices, text_bytes

#: Hash buckets, labelled documents to learn from at most, terms that the machine keeps, length of a term's vector.
BUCKETS, TRAIN_ROWS, TERMS, FACTORS = 1 << 18, 12_000, 6_000, 4
EPOCHS, BATCH, RATE, DECAY = 16, 128, 0.08, 2e-4
PREFIXES = (4, 5, 6)
CACHE = 400_000


class Terms(dict):
    """Written word -> its hashed terms."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = []
        for w in re.findall(r"[^\W\d_]+", word.decode("utf-8", "replace").lower()):
            found.append("=" + w)
            found += [w[:n] for n in PREFIXES if len(w) >= n]
        ids = tuple({xxhash.xxh64_intdigest(t) % BUCKETS for t in found})
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> np.ndarray:
        ids: set[int] = set()
        for t in map(self.__getitem__, set(text.split())):
            ids.update(t)
        return np.array(sorted(ids), np.int32)


_terms = Terms()


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_terms.of(x.as_py()) for x in b.column(2)], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])


class Machine:
    """w0, w[BUCKETS], v[BUCKETS, FACTORS]; terms that are not kept have weight zero."""

    def __init__(self) -> None:
        self.w0, self.w, self.v = 0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)

    def margins(self, ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Of several texts: their terms one after the other, and where each text's terms start and the last end."""
        out = np.full(len(cut) - 1, self.w0)
        some = np.nonzero(np.diff(cut))[0]
        if len(some):
            v = self.v[ids].astype(np.float64)
            at = cut[some]
            total, square = np.add.reduceat(v, at), np.add.reduceat((v * v).sum(axis=1), at)
            out[some] += np.add.reduceat(self.w[ids].astype(np.float64), at) + 0.5 * ((total * total).sum(axis=1) - square)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def kept_terms(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The TERMS terms whose occurrence depends most on the label, by chi-square, of those in three texts or more."""
    n, p = len(y), y.sum()
    df = np.bincount(ids, minlength=BUCKETS).astype(float)
    with_y = np.bincount(ids, weights=y[rows], minlength=BUCKETS)
    expected = df * p / max(n, 1)
    spread = df * (1 - df / max(n, 1)) * p / max(n, 1) * (1 - p / max(n, 1))
    score = np.where((df >= 3) & (spread > 0), (with_y - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    top = np.argsort(-score, kind="stable")[:TERMS]
    return top[score[top] > 4]


def learn(lists: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, weight decay. One class only, or no rows: a machine that always says that class (0)."""
    m = Machine()
    if not len(y) or y.min() == y.max():
        m.w0 = -10.0 if not len(y) or y.max() == 0 else 10.0
        return m
    rng = np.random.default_rng(seed)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ids = np.concatenate(lists)
    keep = kept_terms(ids, rows, y)
    place = np.full(BUCKETS, -1)
    place[keep] = np.arange(len(keep))
    lists = [p[p >= 0] for p in (place[x] for x in lists)]
    k = len(keep)
    w0, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k), rng.normal(0, 0.02, (k, FACTORS))
    g0, gw, gv = 1e-6, np.full(k, 1e-6), np.full((k, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            size = np.array([len(lists[i]) for i in some])
            at = np.concatenate([lists[i] for i in some])
            row = np.repeat(np.arange(len(some)), size)
            x = v[at]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, row, x)
            margin = w0 + np.bincount(row, w[at], len(some)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (x * x).sum(axis=1), len(some)))
            err = (_sigmoid(margin) - y[some]) * (1 + y[some]) / len(some)  # the rarer class counts twice
            d0 = err.sum()
            used, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, err[row], len(used)) + DECAY * w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, back, err[row, None] * (total[row] - x))
            dv += DECAY * v[used]
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            w0 -= RATE * d0 / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
    m.w0, m.w[keep], m.v[keep] = w0, w, v
    return m


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            lists = [_terms.of(x.as_py()) for x in b.column(1)]
            score = _sigmoid(machine.value.margins(np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learns from `rows` documents at most: those in labels(doc_id, toxic) with the least hashes of their doc_ids. The bound
    holds for the rows collected, each with the different terms of one text. Of a doc_id with several labels or texts the
    largest counts. Null ids and labels are left out."""
    least = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    sample = least.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    found = texts.select("doc_id", "y", text_bytes().alias("text")).mapInArrow(_term_lists, "doc_id long, y double, terms array<int>").toArrow()
    order = np.argsort(found["doc_id"].to_numpy())
    lists = [x.values.to_numpy() for x in found["terms"]]
    return learn([lists[i] for i in order], found["y"].to_numpy()[order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score double): a row for each row of docs(doc_id, text, ...), 0 to 1. Null and empty text get the score of a
    text without terms. Only the text goes into the score; a very long one is its different terms. Rows stay as they are;
    empty input gives an empty result. The machine is of fixed size and is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_score(sent), "doc_id long, score double")
