"""Encoding, packing, near-duplicates and repeated passages against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from srclake.llm import bpe, components, packing, simhash, similar, substrings
from tests.llm.helpers import documents_with_copies, frame

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})


def test_pieces_equal_the_pattern(reference_encoding):
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'ll", "s", " ", "  ", "\n", "\t", "　", "a", "é", "１", "9", "½", "!", "漢", "😀", "́", "\x1c", "\x85", "ve", "ß", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)] + ["", "  ", "'" * 5, "x's", "ab" * 3000 + "é" * 99, "a" * 2000]
    merger, at = bpe.Merger(bpe.read_ranks(BYTES)), 0
    found, count = bpe.pieces(texts)
    for text, n in zip(texts, count):
        ids = [i for p in found[at : at + n] for i in np.frombuffer(merger[p], np.int32).tolist()]
        assert ids == reference_encoding.encode_ordinary(text), text
        at += n


def test_scan_is_a_fold():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        step, state, want = bpe.STEP[rng.integers(0, 7, n)], 0, []
        for f in step.tolist():
            state = f >> (2 * state) & 3
            want.append(state)
        assert bpe.scan(step).tolist() == want


def test_encode_and_decode(spark, odd, odd_rows, empty, reference_encoding):
    found = bpe.decode(bpe.encode(odd, BYTES), BYTES).collect()
    want = Counter((i, tuple(reference_encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd_rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found) == want
    assert all(r.ends[-1] == len(r.decoded) for r in found if r.ids)
    assert bpe.encode(empty, BYTES, decoded=True).collect() == []


def test_pack_histogram_places_all():
    rng = random.Random(2)
    for size in (1, 7, 64, 4096):
        histogram = {n: rng.randint(0, 50) for n in range(1, size + 1) if rng.random() < 0.5}
        fill, ranks = {}, Counter()
        for length, rank, count, first, offset in packing.pack_histogram(histogram, size):
            assert rank == ranks[length]
            ranks[length] += count
            for s in range(first, first + count):
                assert fill.get(s, 0) == offset
                fill[s] = offset + length
        assert ranks == Counter({n: k for n, k in histogram.items() if k})
        assert sorted(fill) == list(range(len(fill))) and all(f <= size for f in fill.values())


def test_pack(odd, odd_rows, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in odd_rows)
    rows = packing.pack(odd, WORDS).collect()
    want = Counter((i, a, min(4096, len(x) - a), zlib.crc32(np.array(x[a : a + 4096], np.uint32).tobytes()), len(x)) for i, t in odd_rows for x in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]] for a in range(0, len(x), 4096))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want and ids
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 4096
    assert packing.pack(empty, WORDS).collect() == []


def test_word_cache_equals_the_tokenizer():
    rng, tokenizer = random.Random(2), Tokenizer.from_file(WORDS)
    parts = ["a", "B", "é", "É", "ß", "'s", "'", "'RE", ".", "!!", "1", "２", "<|endoftext|>", " ", "\n", "́", "Σ", "İ", "漢", "😀", "\x85", "\x1c", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    with open(WORDS) as f:
        encoder = packing.Encoder(f.read())
    for _ in range(2):
        got = [np.frombuffer(x, np.uint32).tolist() for x in encoder.ids([t.encode() for t in texts])]
        assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(shingles))


def brute_components(fps):
    near = {a: [b for b in set(fps) if bin(a ^ b).count("1") <= 3] for a in set(fps)}
    label = {a: a for a in near}
    while any(label[a] != min(label[b] for b in near[a]) for a in near):
        label = {a: min(label[b] for b in near[a]) for a in near}
    return label


@pytest.mark.parametrize("case", ["odd", "copies"])
def test_near_duplicates(spark, odd, odd_rows, case):
    rows = odd_rows[:3] + odd_rows[4:] if case == "odd" else documents_with_copies()
    fps = [slow_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    want = Counter((i, f, least.get(label[f])) for (i, _), f in zip(rows, fps))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == want


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert similar.keep_first(empty).collect() == []


def test_link_cell_keeps_all_connections():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(40)]))
    u, v = simhash.link_cell(fp, None, 3)
    assert len(u) < 2 * len(fp)
    want = brute_components(fp.tolist())
    parent = {x: x for x in fp.tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {x: root(x) for x in fp.tolist()} == want


def test_large_cells_are_cut_into_a_grid(spark, monkeypatch):
    rows = documents_with_copies()
    want = Counter(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "CELL", 4)
    assert Counter(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect())) == want


def test_similar_documents(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    near = words[:100] + ["changed"] + words[101:]
    far = [w if k % 6 else "other" for k, w in enumerate(words)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, " ".join(words)), (5, None), (6, ""), (7, "a b c d e f"), (None, " ".join(words))]
    got = dict(map(tuple, similar.similar_documents(frame(spark, rows)).collect()))
    assert got == {3: 1, 1: 1, 2: 2, 4: 1, 5: 5, 6: 5, 7: 7}
    kept = similar.keep_first(frame(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 7] and kept.columns == frame(spark, rows).columns


def brute_similar(rows, similarity=0.8):
    """The least doc_id that links of this Jaccard similarity or more reach, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)})
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both >= similarity * (len(x) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


def variants_around_the_bar():
    """Families of texts that differ in a few words, so that many pairs are just above and just below a similarity of 0.8."""
    rng, rows = random.Random(21), []
    for family, (n, width, edits) in enumerate([(260, 200, (2, 4)), (60, 40, (1, 2)), (30, 1500, (20, 40)), (60, 9, (0, 1))]):
        base = [f"b{family}w{k}" for k in range(width)]
        for _ in range(n):
            some = list(base)
            for k in rng.sample(range(width), rng.randint(*edits)):
                some[k] = f"e{rng.randrange(10**9)}"
            rows.append(" ".join(some))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows + ["", " ", None, "one", "One", "two"])]


@pytest.mark.parametrize("cell", [16384, 4])
def test_similar_documents_miss_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "SMALL", min(cell, similar.SMALL))
    rows = variants_around_the_bar() if cell > 4 else variants_around_the_bar()[::6]
    got = dict(map(tuple, similar.similar_documents(frame(spark, rows)).collect()))
    assert got == brute_similar(rows)


def test_pairs_that_share_one_cell_are_found_whatever_its_size(spark, monkeypatch):
    """Pairs at a similarity of 0.5, of which the first pass finds few, in cells that are cut."""
    monkeypatch.setattr(similar, "CELL", 4)
    rng, rows = random.Random(41), []
    shared = [f"s{k}" for k in range(30)]
    for i in range(60):
        words = shared + [f"p{i}w{k}" for k in range(60)]
        other = words[:58] + [f"q{i}w{k}" for k in range(20)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rng.shuffle(rows)
    got = dict(map(tuple, similar.similar_documents(frame(spark, rows), similarity=0.5).collect()))
    assert got == brute_similar(rows, 0.5) and len(set(got.values())) < len(rows)


def test_prefixes_meet_in_any_order():
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 80), dtype=np.uint64))
        gone = rng.permutation(len(x))[: rng.integers(0, len(x))]
        y = np.unique(np.concatenate((np.delete(x, gone), rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64))))
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            first = [similar.prefix(z, (z % np.uint64(4)).astype(np.uint8), 0.8) for z in (x, y)]
            assert len(np.intersect1d(*first))


def test_folded_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (10, 900, 1020, 1030, 2000, 2050)]
    sets += [np.concatenate((s[5:], rng.integers(0, 1 << 62, 40, dtype=np.uint64))) for s in sets]
    sketches = similar.Sketches([similar._parity(s) for s in sets])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if max(sketches.width[[i, j]]) <= 2 * min(sketches.width[[i, j]]):
                assert sketches.differ(np.array([i]), np.array([j]))[0] <= len(np.setxor1d(x, y))


def test_similar_documents_of_copies(spark):
    rows = list(dict(documents_with_copies()).items())
    assert dict(map(tuple, similar.similar_documents(frame(spark, rows)).collect())) == brute_similar(rows)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 500), (7, 7), (9, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 300, 300: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_passages(rows, width=50):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for a in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[a : a + width])] = min(i, first.get(tuple(w[a : a + width]), i))
    out = Counter()
    for i, w in texts:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if i is not None and first[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("case", ["odd", "copies"])
def test_repeated_passages(spark, odd_rows, case):
    rows = odd_rows if case == "odd" else documents_with_copies()
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows)
    assert all((r.kept is not None) == (r.n_removed > 0) for r in got)


def test_repeated_passages_when_the_sketch_is_full(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_BITS", 16)
    monkeypatch.setattr(substrings, "cells", lambda anchor, bits: [np.zeros(len(anchor), np.uint64)] * substrings.ROWS)
    rows = documents_with_copies()
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows)


def test_no_passages(empty):
    assert substrings.repeated_passages(empty).collect() == []
