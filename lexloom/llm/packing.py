"""Best-fit packing of documents into token sequences, by patterns fitted with non-negative least squares.

Lengths are counted in a histogram (at most ``capacity`` bins, whatever the corpus). Patterns of a few lengths are
enumerated over coarse bins, repeat counts are fitted to the histogram by non-negative least squares and rounded down,
and each repeat is filled with real lengths, the last of them as long as the others allow. What is left over is packed
by best fit, first into the space that the patterns leave. The plan works on (length, count) runs, so its size follows the number of bins, not of documents.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, raw, tune

CAPACITY, END_ID = 4096, 1
#: Coarse bins of the pattern fit, the most documents in a pattern, rounds of the fit.
BINS, PATTERN_DOCS, ROUNDS = 32, 3, 400
#: Shares of the fitted repeats that are tried; what a share leaves to best fit fills the space in its sequences.
SHARES = (1.0, 0.95, 0.9, 0.75, 0.5)


#: The vocabulary's own splitting rule on texts of ASCII and Latin-1 letters; other texts go to the tokenizer whole.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r 0-9a-z\xdf-\xf6\xf8-\xff]+")
OTHER = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")


class Encoder(dict):
    """Token ids of texts: each distinct piece that the splitting rule gives is encoded once and kept.

    Pieces never depend on what is around them, so a text's ids are those of its pieces. The memo is the worker's; when
    large it starts anew, so memory stays bounded.
    """

    LIMIT = 600_000
    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        to_bytes = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: Letters as the byte-level alphabet writes them.
        self.letters = {i: to_bytes(chr(i))[0][0] for i in [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat: list[int] = []
        self.start: list[int] = []
        self.size: list[int] = []
        self.arrays = None

    def __missing__(self, piece: str) -> int:
        if piece.isalpha():
            ids = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        n = self[piece] = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat += ids
        return n

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > self.LIMIT:
            self.reset()
        which: list[np.ndarray] = []
        whole: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            text = t.decode()
            if "<|" in text or not text.isascii() and OTHER.search(text):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                which.append(np.zeros(0, np.int64))
            else:
                pieces = PIECES.findall(text.lower())
                which.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
        if self.arrays is None or len(self.arrays[0]) < len(self.start):
            self.arrays = tuple(_grown(old, new, kind) for old, new, kind in zip(self.arrays or (None,) * 3, (self.start, self.size, self.flat), (np.int64, np.int64, np.uint32), strict=True))
        starts, sizes, flat = self.arrays
        every = np.concatenate([*which, np.zeros(0, np.int64)])
        size = sizes[every] if len(every) else every
        end = np.cumsum(size)
        ids = flat[np.repeat(starts[every] - (end - size), size) + np.arange(int(size.sum()))] if len(every) else np.zeros(0, np.uint32)
        cut = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(w) for w in which])]).astype(np.int64)].tolist()
        return [whole[i] if i in whole else ids[s:e] for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False))]


def _grown(old: np.ndarray | None, values: list[int], kind: type) -> np.ndarray:
    return np.array(values, kind) if old is None else np.concatenate([old, np.array(values[len(old) :], kind)])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by accelerated projected gradient steps; deterministic."""
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / u * (z - x), z, u
    return x


def _patterns(capacity: int, bins: int, docs: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to ``docs`` bins that fill a sequence to within a bin: the sum of upper bounds is the capacity."""
    return [c for n in range(2, docs + 1) for c in combinations_with_replacement(range(1, bins + 1), n) if sum(c) == bins]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS, docs: int = PATTERN_DOCS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)]: all pieces of the histogram, each once, none over the capacity.

    Of the shares in SHARES that with the fewest sequences is taken, the first that needs no more than total / capacity.
    """
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: tuple[int, list] | None = None
    for share in SHARES:
        plan = _plan(histogram, capacity, bins, docs, share)
        size = sum(n for _, n in plan)
        if best is None or size < best[0]:
            best = size, plan
        if size <= least:
            break
    return best[1]


def _plan(histogram: dict[int, int], capacity: int, bins: int, docs: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    left = {k: v for k, v in histogram.items() if v > 0}
    done: dict[tuple[int, ...], int] = defaultdict(int)
    if left.get(capacity):
        done[(capacity,)] += left.pop(capacity)
    width = capacity / bins
    bin_of = lambda k: min(bins, max(1, -(-k // max(1, int(width)))))  # noqa: E731  rounds a length up to its bin
    shapes = _patterns(capacity, bins, docs)
    target = np.zeros(bins + 1)
    for k, v in left.items():
        target[bin_of(k)] += v
    if shapes and target.sum():
        a = np.zeros((bins + 1, len(shapes)))
        for j, s in enumerate(shapes):
            for i in s:
                a[i, j] += 1
        weight = np.sqrt(np.arange(bins + 1) / bins)[:, None]  # long lengths are the harder ones to place later
        repeats = np.floor(share * nnls(a * weight, target * weight[:, 0])).astype(np.int64)
        alive = sorted(left)

        def longest(limit: int, use: dict[int, int]) -> int | None:
            at = bisect.bisect_right(alive, limit) - 1
            while at >= 0 and left[alive[at]] <= use.get(alive[at], 0):
                at -= 1
            return alive[at] if at >= 0 else None

        for j in sorted(range(len(shapes)), key=lambda j: (-max(shapes[j]), -repeats[j], shapes[j])):
            todo = int(repeats[j])
            while todo:
                # the longest lengths of the pattern's bins, and for the last place the longest that still fits
                use: dict[int, int] = defaultdict(int)
                room, lengths = capacity, []
                for nth, i in enumerate(reversed(shapes[j]), 1):
                    k = longest(room if nth == len(shapes[j]) else min(room, int(i * width)), use)
                    if k is None or (nth < len(shapes[j]) and bin_of(k) != i):
                        break
                    use[k] += 1
                    lengths.append(k)
                    room -= k
                if len(lengths) < len(shapes[j]):
                    break
                times = min(todo, *(left[k] // n for k, n in use.items()))
                done[tuple(sorted(lengths, reverse=True))] += times
                todo -= times
                for k, n in use.items():
                    left[k] -= n * times
                    if not left[k]:
                        alive.remove(k)
    # best fit: longest left-over lengths first, each into the fullest sequences that still take it
    space: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, n in done.items():
        space[capacity - sum(lengths)][lengths] = n
    rooms = sorted(space)
    for k in sorted((k for k in left if left[k]), reverse=True):
        todo = left[k]
        while todo:
            at = bisect.bisect_left(rooms, k)
            if at == len(rooms):
                fit = capacity // k
                for lengths, n in (((k,) * fit, todo // fit), ((k,) * (todo % fit), 1)):
                    if n and lengths:
                        room = capacity - k * len(lengths)
                        if room not in space or not space[room]:
                            bisect.insort(rooms, room) if room not in rooms else None
                        space[room][lengths] = space[room].get(lengths, 0) + n
                break
            room = rooms[at]
            lengths, n = next(iter(space[room].items()))
            fit = min(room // k, todo) if n == 1 else room // k
            fit = min(fit, todo)
            times = min(n, todo // fit)
            space[room][lengths] -= times
            if not space[room][lengths]:
                del space[room][lengths]
                if not space[room]:
                    rooms.pop(at)
            more, rest = lengths + (k,) * fit, room - k * fit
            if not space[rest]:
                bisect.insort(rooms, rest)
            space[rest][more] = space[rest].get(more, 0) + times
            todo -= times * fit
    return [(lengths, n) for room in sorted(space) for lengths, n in sorted(space[room].items())]


def tokenized_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(k, piece, start, length, crc, part, nth): nth counts the earlier pieces of this length in the task ``part``."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["k", "piece", "start", "length", "crc", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for b in batches:
            at, columns = [], [[] for _ in range(5)]
            for i, ids in enumerate(encoder.encode([t or b"" for t in raw(b.column(1))])):
                whole = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    own = whole[start : start + capacity]
                    at.append(i)
                    for c, v in zip(columns, (piece, start, len(own), zlib.crc32(own.tobytes()), int(seen[len(own)])), strict=True):
                        c.append(v)
                    seen[len(own)] += 1
            piece, start, length, crc, nth = columns
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, crc long, part int, nth long")


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of places, the first sequence of the run, the offset in a sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, repeats in plan:
        offset = 0
        for k in lengths:
            runs[k].append((taken[k], sequence, offset))
            taken[k] += repeats
            offset += k
        sequence += repeats
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``.

    A row's ids are those of its whole text by the tokenizer file, then ``end_id``. Only rows of more than ``capacity``
    ids are cut, into pieces of that size and a last one. Sequences are gapless and hold at most ``capacity`` ids.

    A null or empty text is the end id alone. Repeated rows and null keys are packed like any other; an empty table
    gives no rows. Other columns are not read. Sent to the driver: a histogram of at most ``capacity`` bins. Broadcast:
    the plan, whose size depends on the bins.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenized_pieces(docs, key, text, tokenizer, capacity, end_id), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = scratch.save(counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(earlier, F.lit(0)).alias("base")), "base")
    slots = spark.sparkContext.broadcast(_slots(plan_packing(histogram, capacity)))
    ranked = pieces.join(base.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).select("k", "piece", "start", "length", "crc", (F.col("base") + F.col("nth")).alias("rank"))
    kind = ranked.schema["k"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                mine = np.flatnonzero(length == k)
                first, seq, off = where[k]
                run = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = seq[run] + rank[mine] - first[run], off[run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("k", key)
