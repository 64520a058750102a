"""Byte-level BPE: pre-tokenisation by array scans, cached pair merging, decoding by offsets.

Texts are codepoint arrays. Each codepoint has a class (letter, number, space, other white space, rest) and gives a function
on the scanner's four states. Functions compose associatively, so a blocked prefix scan finds the state before every
codepoint without a loop over codepoints and without a regular expression; states and neighbouring classes give the
boundaries. The slices between them go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srclake.llm.common import text_bytes

OTHER_SPACE, SPACE, LETTER, NUMBER, REST = range(5)
#: Symbols beyond the classes: an apostrophe that a contraction's one or two letters follow.
CONTRACTS_1, CONTRACTS_2 = 5, 6
#: States: a contraction may start here; an apostrophe here belongs to the token before; one or two contraction letters left.
FREE, JOINED, ONE_LEFT, TWO_LEFT = range(4)
#: Letters that follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Codepoints that are scanned together, and pieces that a worker keeps merged.
CHUNK, CACHE = 1_000_000, 600_000


def _function(to: dict[int, int]) -> int:
    return sum(to[s] << (2 * s) for s in range(4))


_PLAIN = {FREE: FREE, JOINED: FREE, ONE_LEFT: FREE, TWO_LEFT: ONE_LEFT}
_JOINING = dict.fromkeys(range(4), JOINED)
#: By symbol: the state after it for each state before it, two bits a state.
STEP = np.array([_function(x) for x in (_PLAIN, _JOINING, _PLAIN, _PLAIN, _JOINING, _JOINING | {FREE: ONE_LEFT}, _JOINING | {FREE: TWO_LEFT})], np.uint8)


def _compose() -> np.ndarray:
    """[f, g] -> first f, then g."""
    f, g = np.arange(256)[:, None], np.arange(256)[None, :]
    return sum(((g >> (2 * ((f >> (2 * s)) & 3))) & 3) << (2 * s) for s in range(4)).astype(np.uint8)


COMPOSE = _compose()


def scan(step: np.ndarray, block: int = 256) -> np.ndarray:
    """The state after each step, from state FREE before the first."""
    n = len(step)
    rows = -(-n // block)
    identity = _function({s: s for s in range(4)})
    f = np.full(rows * block, identity, np.uint8)
    f[:n] = step
    f = np.ascontiguousarray(f.reshape(rows, block).T)
    flat = COMPOSE.ravel()
    for t in range(1, block):  # within all blocks at once
        f[t] = flat[(f[t - 1].astype(np.uint16) << 8) | f[t]]
    total, far = f[-1].copy(), 1
    while far < rows:  # over the blocks, doubling the reach
        total[far:] = flat[(total[:-far].astype(np.uint16) << 8) | total[far:]]
        far *= 2
    before = np.concatenate(([FREE], total[:-1] & 3)).astype(np.uint8)
    return ((f >> (2 * before)) & 3).T.ravel()[:n]


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every codepoint, by the property tables that the tokenizer library itself goes by."""
    global _classes
    if _classes is None:
        import tiktoken

        table = np.full(0x110000, REST, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", OTHER_SPACE)):
            e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            for low in range(0, 0x110000, 0x4000):
                some = "".join(map(chr, (i for i in range(low, low + 0x4000) if not 0xD800 <= i < 0xE000)))
                table[np.frombuffer(e.decode(e.encode_ordinary(some)).encode("utf-32-le"), np.uint32)] = kind
        table[0x20] = SPACE
        _classes = table
    return _classes


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start, given the codepoints of several texts and where texts start (ascending; empty texts repeat)."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first = first[:n]
    last = np.append(first[1:], True)
    symbol = kind.copy()
    at = np.nonzero(points == 0x27)[0]
    ends = np.append(starts[1:], n)
    end = ends[np.searchsorted(starts, at, "right") - 1] if len(at) else at
    for c in CONTRACTIONS:
        ok = at + len(c) < end
        for k, letter in enumerate(c, 1):
            ok &= points[np.minimum(at + k, n - 1)] == ord(letter)
        symbol[at[ok]] = CONTRACTS_1 if len(c) == 1 else CONTRACTS_2
    step = STEP[symbol]
    step[first] = (step[first] & 3) * 0b01010101  # a text starts FREE, whatever was before it
    after = scan(step)
    before = np.where(first, FREE, np.concatenate(([FREE], after[:-1])))
    earlier = np.where(first, FREE, np.concatenate(([FREE], before[:-1])))
    space = kind <= SPACE
    run = np.where(space, OTHER_SPACE, kind)
    back = np.concatenate((run[:1], run[:-1]))
    back_space = np.concatenate((space[:1], space[:-1]))
    ahead_word = np.append(~space[1:], False) & ~last
    word = (earlier == ONE_LEFT) | ((run != back) & (np.concatenate((kind[:1], kind[:-1])) != SPACE))
    word &= before < ONE_LEFT
    return np.nonzero(first | np.where(space, ~back_space | ahead_word, word))[0]


def pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts in order, and for each text how many are its own."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[: len(texts)].astype(np.int64)
    if not len(points):
        return [], np.zeros(len(texts), np.int64)
    at = boundaries(points, starts)
    size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    data, cut = joined.encode(), np.append(offset[at], offset[-1]).tolist()
    count = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:])], count


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger(dict):
    """piece -> its ids as 32-bit bytes; at most CACHE pieces are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), np.int32).tobytes()
        if len(self) < CACHE:  # what comes first is mostly what is common
            self[piece] = ids
        return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of least rank, the leftmost of equals, until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    get, none = ranks.get, 1 << 62
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair and (least := min(pair)) < none:
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links: n log n for very long pieces."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heappush(heap, (r, i, end[right[i]]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
            heappush(heap, (r, h, end[i]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


_mergers: dict[str, Merger] = {}


def _merger(key: str, ranks) -> Merger:
    """One for each worker process and vocabulary: its cache outlives a task."""
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(ranks.value)
    return _mergers[key]


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > CHUNK:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def _lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(values))


def _vocabulary(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where each id's bytes start in the bytes of all, and how many they are."""
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return np.cumsum(size) - size, size


def _placed(ids: np.ndarray, ends: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of ids, each placed by its end."""
    n = size[ids]
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - (ends - n), n)].tobytes()


def _encode(key: str, ranks, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(key, ranks)
        start, size = _vocabulary(ranks.value)
        flat = np.frombuffer(b"".join(sorted(ranks.value, key=ranks.value.get)), np.uint8)
        for b in batches:
            done = 0
            for texts in _chunks(x.as_py().decode("utf-8", "replace") for x in b.column(1)):
                found, count = pieces(texts)
                packed = list(map(merger.__getitem__, found))
                ids = np.frombuffer(b"".join(packed), np.int32)
                cut = np.concatenate(([0], np.cumsum(count)))
                total = np.concatenate(([0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)))[cut]
                del found, packed
                tokens = np.diff(total)
                end = np.concatenate(([0], np.cumsum(size[ids])))
                ends = (end[1:] - np.repeat(end[total[:-1]], tokens)).astype(np.int32)
                columns = [b.column(0).slice(done, len(texts)), _lists(ids, tokens), _lists(ends, tokens)]
                if decoded:
                    columns.append(pa.array([_placed(ids[a:z], ends[a:z], flat, start, size) for a, z in zip(total[:-1], total[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "ends", "decoded"][: len(columns)])
                done += len(texts)

    return run


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, ends array<int>[, decoded binary]): a row for each row of docs(doc_id, text, ...).

    ids are those of tiktoken's encode_ordinary with the ranks of the file `vocabulary` and the pattern of byte-level BPE;
    ends are the byte offsets in the text at which each id's bytes end. decoded: also decode the ids, in the same pass over
    the data. Null and empty text give empty arrays. Rows stay as they are, repeated or not; other columns are ignored;
    empty input gives an empty result. The ranks, some hundred thousand short strings at most, are broadcast; the file is
    read on the driver only. A worker holds a million codepoints at a time, or one text.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_encode(vocabulary, ranks, decoded), "doc_id long, ids array<int>, ends array<int>" + ", decoded binary" * decoded)


def _decode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(b"".join(sorted(ranks.value, key=ranks.value.get)), np.uint8)
        start, size = _vocabulary(ranks.value)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                lists = (some.column(some.schema.get_field_index(c)) for c in ("ids", "ends"))
                out = [_placed(i.values.to_numpy(), e.values.to_numpy(), flat, start, size) for i, e in zip(*lists)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.binary())], [*some.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded binary, the bytes of ids, each placed by its end in ends; other columns stay. ids without a token fail."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return encoded.mapInArrow(_decode(ranks), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
