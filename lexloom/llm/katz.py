"""Katz backoff language model of a corpus, and the scores of all its texts, evaluated recursively per token.

For a context h of n - 1 words and h' without its first word, from training counts c:

    P(w | h) = d(c(h w)) c(h w) / c(h)    if h w was seen
             = alpha(h) P(w | h')         if only h was seen
             = P(w | h')                  if h was not

d are Good-Turing discounts of the order's counts up to CUT (counts above are reliable and stay); every n-gram seen in
training counts, those seen once too. alpha(h) is exact: the mass that the discounts leave of h, over what P(. | h')
leaves of the words not seen after h, so that each context sums to 1. Where the discounts leave nothing of h, that is
where all words after it were seen more than CUT times, half a count is set aside: the divisor is c(h) + RESERVE. At
order 1 P(w) = d(c(w)) c(w) / N, and the mass left is that of the one unknown word.

No word or n-gram is ever a row by itself. Texts are encoded in chunks. Order by order, a chunk sends each bucket one
packed row of the n-grams in it (as the number of the context, an n-gram one shorter, and the number of the word) with
their counts in training, and gets back one row of corpus counts and of numbers for the n-grams that were seen. Thus
n-grams are told apart exactly; only words are hashes, of 64 bits. An n-gram that is hot in the corpus is one key in
each chunk, and a context that is hot is dealt out to many buckets by its words, so buckets stay even. Chunks and buckets
have a fixed number of tokens, whatever the corpus.

The tables of the model are written under the shared folder, parted by order and kind: counts of n-grams by bucket, and
what the weight of each context that a text backs off from is made of; no other weights would be read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, raw, tune
from lexloom.llm.words import WordHash, space_words

#: Order of the model; Good-Turing applies up to this count; tokens of a chunk; of a bucket, at most on average.
ORDER, CUT, CHUNK, BUCKET, RESERVE = 3, 5, 1 << 20, 3 << 20, 0.5
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Hash of the end of a text; no word contains a space.
END = WordHash().of([b" end"])[0]
_LEVELS = np.arange(1, CUT + 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * _C1 ^ b.astype(np.uint64)) * _C2
    return h ^ (h >> np.uint64(31))


def _squeeze(a: np.ndarray) -> bytes:
    """An array by its byte planes, each compressed by itself if that helps; planes of zeros, as of the high bytes of
    small numbers, are left out. Starts with the length and a bit for each plane that is there."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    some = planes.any(axis=1)
    out = [struct.pack("<IB", len(a), np.packbits(some, bitorder="little")[0])]
    for plane in planes[some]:
        data = plane.tobytes()
        packed = zstandard.ZstdCompressor(level=1, write_content_size=False).compress(data)
        out += [struct.pack("<I", min(len(packed), len(data))), packed if len(packed) < len(data) else data]
    return b"".join(out)


def _expand(data: bytes | None, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    (n, some), at = struct.unpack_from("<IB", data), 5
    planes = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
    for i in range(len(planes)):
        if some >> i & 1:
            (size,) = struct.unpack_from("<I", data, at)
            part = data[at + 4 : at + 4 + size]
            planes[i] = np.frombuffer(part if size == n else zstandard.ZstdDecompressor().decompress(part, max_output_size=n), np.uint8)
            at += 4 + size
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys by their differences."""
    return _squeeze(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_keys(data: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(_expand(data, kind), dtype=kind)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _table(rows: list[tuple], schema: str, first: pa.DataType | None = None) -> pa.Table:
    """Rows by the columns of a schema in words; ``first`` is the type of its column k."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), first if n == "k" else types[t]) for c, (n, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


# ---- texts

ENCODED = "kind string, p long, n long, k array<{}>, train binary, sizes binary, times binary, words binary, vocabulary binary, tally binary"


def encode(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """Chunks of whole texts in two rows each: kind words has the distinct word hashes, the end's included, ascending,
    with their counts in training texts; kind text has the words of each text, numbered from the most frequent in the
    chunk on (of equals, from the least hash on), and by ``times`` how often each occurs; ends are implied.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part, made = WordHash(), TaskContext.get().partitionId(), 0
        keys: list = []
        hashes: list[np.ndarray] = []
        flags: list[bool] = []
        total = 0

        def close(kind: pa.DataType) -> list[pa.RecordBatch]:
            nonlocal keys, hashes, flags, total, made
            sizes, train = np.array([len(h) + 1 for h in hashes]), np.array(flags)
            tokens = np.concatenate([x for h in hashes for x in (h, END[None])])
            vocabulary, words, times = np.unique(tokens, return_inverse=True, return_counts=True)
            place = np.empty(len(vocabulary), np.uint32)
            place[_by_times(times)] = np.arange(len(vocabulary), dtype=np.uint32)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(sizes) - 1] = False
            tally = np.bincount(words, weights=np.repeat(train, sizes), minlength=len(vocabulary)).astype(np.uint32)
            name = part << 24 | made
            out = [
                ("text", name, total, keys, _bits(train), _squeeze(sizes.astype(np.uint32)), _squeeze(times.astype(np.uint32)), _squeeze(place[words[inner]]), None, None),
                ("words", name, 0, None, None, None, None, None, vocabulary.tobytes(), _squeeze(tally)),
            ]
            made += 1
            keys, hashes, flags, total = [], [], [], 0
            return _table(out, ENCODED.replace("array<{}>", "x"), pa.list_(kind)).to_batches()

        for b in batches:
            own = b.schema.field(0).type
            for k, t, f in zip(b.column(0).to_pylist(), raw(b.column(1)), b.column(2).to_pylist(), strict=True):
                keys.append(k)
                flags.append(f)
                hashes.append(memo.of(space_words(t)))
                total += len(hashes[-1]) + 1
                if total >= CHUNK:
                    yield from close(own)
        if keys:
            yield from close(own)

    return rows.mapInArrow(run, ENCODED.format(kind.simpleString()))


def _by_times(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times.astype(np.int64), kind="stable")


# ---- the model


def discounts(stats: list[int]) -> np.ndarray:
    """Katz's d_r for r = 0 to CUT + 1 (the last for all above) from [distinct, sum, n_1, ..., n_CUT+1].

    d_r = (r*/r - q) / (1 - q) with r* = (r + 1) n_(r+1) / n_r and q = (CUT + 1) n_(CUT+1) / n_1. Where counts of counts
    are too few to give 0 < d_r <= 1 it is 1.
    """
    n = [0, *stats[2:]]
    d = np.ones(CUT + 2)
    q = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        if n[r] and q < 1:
            x = ((r + 1) * n[r + 1] / (r * n[r]) - q) / (1 - q)
            d[r] = x if 0 < x <= 1 else 1.0
    return d


class Unigrams:
    """P(w) from a count: discounted and exactly normalised over the known words and one unknown."""

    def __init__(self, stats: list[int]):
        self.total, self.d = stats[1], discounts(stats)
        left = sum(r * n * (1 - self.d[r]) for r, n in enumerate(stats[2 : 2 + CUT], 1))
        #: With no mass left by discounts one count is set aside, as by adding one to the unknown.
        self.scale, self.unknown = (1.0, left / self.total) if left > 0 else (self.total / (self.total + 1), 1 / (self.total + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.scale * _discounted(self.d, counts) / max(self.total, 1), self.unknown)


def _discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, CUT + 1).astype(np.int64)] * counts


class Model:
    """What is known of the orders counted so far. stats: by order, as ``discounts`` takes them; texts: training texts."""

    def __init__(self, stats: list[list[int]], texts: int, buckets: int, split: int):
        self.stats, self.texts, self.buckets, self.split = stats, texts, buckets, split
        self.first = Unigrams(stats[0]) if stats else None
        self.d = [discounts(s) for s in stats]

    def covered(self, order: int, spread: np.ndarray, den: np.ndarray) -> np.ndarray:
        """Sums of P over n-grams of ``order`` in one context each: spread has how many were seen 1 to CUT times and the
        sum of the counts above, den twice the divisor."""
        sums = (self.d[order - 1][_LEVELS] * _LEVELS) @ spread[:CUT] + spread[CUT]
        return sums * self.first.scale / max(self.first.total, 1) if order == 1 else sums * 2 / den


REQUESTS = "bucket int, ord int, p long, contexts binary, asked binary, fan binary, words binary, counts binary, num binary"
COUNTED = "kind string, bucket int, ord int, p long, contexts binary, fan binary, words binary, counts binary, numbers binary, masks binary, weighed binary, levels binary, spread binary, stats array<long>"


class Chunk:
    """An encoded chunk; for each of its tokens what the orders counted so far say of the n-gram that ends there."""

    def __init__(self, row: dict):
        self.keys, n = row["k"], len(row["k"])
        self.train = _flags(row["train"], n)
        self.sizes = _expand(row["sizes"], np.uint32).astype(np.int64)
        ends = np.cumsum(self.sizes) - 1
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.sizes)
        self.first = np.zeros(len(self.doc), bool)
        self.first[ends - self.sizes + 1] = True
        times = _expand(row["times"], np.uint32)
        # the one word that no text holds as often as the chunk has it is the end
        self.word = np.full(len(self.doc), -1, np.int32)
        inner = np.ones(len(self.doc), bool)
        inner[ends] = False
        self.word[inner] = _by_times(times)[_expand(row["words"], np.uint32)]
        held = np.bincount(self.word[inner], minlength=len(times))
        self.word[ends] = int(np.flatnonzero(held != times)[0])
        self.n_words = len(times)

    def hear_words(self, answers: list[dict], model: Model) -> None:
        counts, numbers = np.zeros(self.n_words, np.int64), np.full(self.n_words, -1, np.int64)
        s = 0
        for r in answers:
            told = _expand(r["counts"], np.uint64)
            counts[s : s + len(told)] = told
            numbers[s + np.flatnonzero(told)] = _expand(r["numbers"], np.uint32).astype(np.int64) * model.buckets + r["bucket"]
            s += len(told)
        self.count, self.word_count = (counts[self.word],) * 2
        self.den = np.ones(len(self.doc), np.int64)  # not read at order 1
        self.log_p = np.log10(model.first.p(self.count))
        order = np.argsort(numbers, kind="stable")[np.count_nonzero(numbers < 0) :]
        place = np.full(self.n_words, -1, np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.word_at = numbers[order], place[self.word]  # seen words by their numbers, ascending
        self.grams, self.gram_at = self.words, self.word_at

    def arrange(self, model: Model) -> None:
        """The distinct n-grams of the next order, dealt out: entries (bucket, context) and under each its words.

        grams are the seen n-grams of the order below by their numbers, ascending, and gram_at is the place among them of
        that which ends at a token, or -1. A context's number is that of such an n-gram plus 1; 0 is the start of a text.
        """
        place = np.where(self.first, 0, np.roll(self.gram_at, 1) + 1)
        self.has_context = self.first | (place > 0)
        place = place[self.has_context]
        used = np.bincount(place, minlength=len(self.grams) + 1) > 0
        self.contexts = np.append(0, self.grams + 1)[used]
        self.context_at = (np.cumsum(used, dtype=np.int32) - 1)[place]
        self.context_count = np.where(self.first, model.texts, np.roll(self.count, 1))
        at = np.flatnonzero(self.has_context)
        example = np.zeros(len(self.contexts), np.int64)
        example[self.context_at] = at
        size = self.context_count[example]
        parts = np.where(size > model.split, np.minimum(1 + size // model.split, model.buckets), 1)
        self.context_den = self.den[example]
        known = self.word_at[at] >= 0
        self.asked_context = parts > 1
        self.asked_context[self.context_at[~known]] = True
        # distinct (context, word), by both
        self.pair_token = at[known].astype(np.int32)
        n = np.int64(max(len(self.words), 1))
        code, pair_at = np.unique(self.context_at[known].astype(np.int64) * n + self.word_at[self.pair_token], return_inverse=True)
        context = code // n
        word = self.words[code - context * n]
        # entries: a context's buckets, one unless it is hot
        base = np.cumsum(parts) - parts
        every = np.repeat(np.arange(len(self.contexts)), parts)
        home = (_mix(self.contexts[every], np.arange(len(every)) - base[every]) % np.uint64(model.buckets)).astype(np.int64)
        m = np.int64(max(len(self.contexts), 1))
        entries, entry_of = np.unique(home * m + every, return_inverse=True)
        entry = entry_of[base[context]]
        hot = np.flatnonzero(parts[context] > 1)
        turn = (_mix(word[hot], np.zeros(1)) % parts[context[hot]].astype(np.uint64)).astype(np.int64)
        entry[hot] = entry_of[base[context[hot]] + turn]
        self.fan = np.bincount(entry, minlength=len(entries)).astype(np.uint32)
        ends = np.cumsum(self.fan, dtype=np.int64)
        # where a pair stands in the order sent: pairs of a context that is not hot stand together already
        begin = np.cumsum(np.bincount(context, minlength=len(self.contexts)))
        begin = np.append(0, begin)[context]
        sent = (ends - self.fan)[entry] + np.arange(len(code)) - begin
        order = hot[np.argsort(entry[hot], kind="stable")]
        group = entry[order]
        start = np.searchsorted(group, group)
        sent[order] = (ends - self.fan)[group] + np.arange(len(order)) - start
        self.pair_at = sent.astype(np.int32)[pair_at]
        self.pair_word, self.entry_of = np.empty_like(word), np.empty_like(entry)
        self.pair_word[sent], self.entry_of[sent] = word, entry
        self.entry_context = entries % m
        buckets, starts = np.unique(entries // m, return_index=True)
        stops = np.append(starts[1:], len(entries))
        self.spans = [(b, s, e, int(ends[s - 1]) if s else 0, int(ends[e - 1])) for b, s, e in zip(buckets.tolist(), starts.tolist(), stops.tolist(), strict=True)]

    def ask(self, order: int) -> Iterator[tuple]:
        """Rows of REQUESTS without p. num: for pairs in training texts, the count of the n-gram without its first word."""
        counts = np.bincount(self.pair_at, weights=self.train[self.doc[self.pair_token]], minlength=len(self.pair_word)).astype(np.uint32)
        num = np.zeros(len(self.pair_word), np.uint64)
        num[self.pair_at] = self.count[self.pair_token]
        num[counts == 0] = 0
        for b, s, e, i, j in self.spans:
            c = self.entry_context[s:e]
            yield b, order, pack_keys(self.contexts[c]), _bits(self.asked_context[c]), _squeeze(self.fan[s:e]), _squeeze(self.pair_word[i:j]), _squeeze(counts[i:j]), _squeeze(num[i:j])

    def hear(self, answers: list[dict], order: int, model: Model) -> None:
        """Take in the counts of ``order`` and its probabilities: the recursion's step from the order below."""
        d = model.d[order - 1]
        counts, numbers = np.zeros(len(self.pair_word), np.int64), np.full(len(self.pair_word), -1, np.int64)
        masks = np.zeros(len(self.contexts), np.uint8)
        levels, spread = np.zeros((CUT, len(self.contexts))), np.zeros((CUT + 1, len(self.contexts)))
        for (b, s, e, i, j), r in zip(self.spans, answers, strict=True):
            c = self.entry_context[s:e]
            counts[i:j] = _expand(r["counts"], np.uint64)
            seen = i + np.flatnonzero(counts[i:j])
            if r["numbers"] is not None:
                numbers[seen] = np.cumsum(_expand(r["numbers"], np.int64)) | b << 32
            masks[c] |= _expand(r["masks"], np.uint8)
            told = c[_told(self.asked_context[c], self.entry_of[i:j] - s, counts[i:j])]
            levels[:, told] += _expand(r["levels"], np.uint64).reshape(CUT, -1)
            spread[:, told] += _expand(r["spread"], np.uint64).reshape(CUT + 1, -1)
        # a context of which the discounts leave nothing sets half a count aside
        leaving = np.uint8(sum(1 << int(r) for r in _LEVELS if d[r] < 1))
        spare = np.zeros(len(self.doc), bool)
        spare[self.has_context] = (masks & leaving == 0)[self.context_at]
        self.den = 2 * self.context_count + spare
        self.count = np.zeros(len(self.doc), np.int64)
        self.count[self.pair_token] = counts[self.pair_at]
        seen = counts > 0
        self.grams = numbers[seen]  # ascending: by bucket, and in a bucket by context and word
        self.gram_at = np.full(len(self.doc), -1, np.int32)
        self.gram_at[self.pair_token] = np.where(seen, np.cumsum(seen) - 1, -1).astype(np.int32)[self.pair_at]
        direct = self.count > 0
        back = np.zeros(len(self.doc))
        left = ((1 - d[_LEVELS]) * _LEVELS) @ levels
        left = np.where(masks & leaving == 0, RESERVE, left)
        at = np.flatnonzero(self.has_context & ~direct)
        c = self.context_at[~direct[self.has_context]]
        back[at] = np.log10(left[c] * 2 / self.den[at] / (1 - model.covered(order - 1, spread, self.context_den)[c]))
        self.log_p = back + self.log_p
        self.log_p[direct] = np.log10(_discounted(d, self.count[direct]) * 2 / self.den[direct])

    def learn(self, answers: list[dict], model: Model, orders: int) -> None:
        """Take in the answers of all orders up to ``orders``."""
        by: list[list[dict]] = [[] for _ in range(orders)]
        for r in answers:
            by[r["ord"] - 1].append(r)
        for order, rows in enumerate(by, 1):
            rows.sort(key=lambda r: r["bucket"])
            if order == 1:
                self.hear_words(rows, model)
            else:
                self.arrange(model)
                self.hear(rows, order, model)


def _told(asked: np.ndarray, entry: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of which entries a bucket tells the mass left: those asked for, and those with a pair that was never seen."""
    told = asked.copy()
    told[entry[counts == 0]] = True
    return told


def _count_words(bucket: int, rows: list[dict]) -> list[tuple]:
    keys = [unpack_keys(r["contexts"]) for r in rows]
    counts = [_expand(r["counts"], np.uint32) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
    seen = total > 0
    rank = np.empty(len(distinct), np.uint32)  # frequent words get small numbers
    rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(distinct), dtype=np.uint32)
    out = [("model", bucket, 1, -1, pack_keys(distinct[seen]), None, None, _squeeze(total[seen]), _squeeze(rank[seen]), None, None, None, None, _stats(total))]
    place = 0
    for r, k in zip(rows, keys, strict=True):
        mine = at[place : place + len(k)]
        place += len(k)
        out.append(("answer", bucket, 1, r["p"], None, None, None, _squeeze(total[mine]), _squeeze(rank[mine][seen[mine]]), None, None, None, None, None))
    return out


def _stats(total: np.ndarray) -> list[int]:
    return [int((total > 0).sum()), int(total.sum()), *(int((total == r).sum()) for r in range(1, CUT + 2))]


def _count(last: bool):
    """Corpus counts of one bucket's n-grams: the model's part (kind model) and an answer to each chunk (kind answer)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["p"])
        bucket, order = rows[0]["bucket"], rows[0]["ord"]
        if order == 1:
            return _table(_count_words(bucket, rows), COUNTED)
        read = lambda name, kind: [_expand(r[name], kind) for r in rows]
        mine = [unpack_keys(r["contexts"], np.int64) for r in rows]
        contexts, context_at = np.unique(np.concatenate(mine), return_inverse=True)
        fans = read("fan", np.uint32)
        ends = np.cumsum([len(c) for c in mine])
        context_at = np.split(context_at, ends[:-1])
        pair_context = [np.repeat(c, f) for c, f in zip(context_at, fans, strict=True)]
        words, counts, num = (read(*x) for x in (("words", np.int64), ("counts", np.uint32), ("num", np.uint64)))
        key = np.concatenate(pair_context).astype(np.uint64) << np.uint64(40) | np.concatenate(words).astype(np.uint64)
        distinct, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
        lower_num = np.zeros(len(distinct), np.uint64)
        np.maximum.at(lower_num, at, np.concatenate(num))
        seen = total > 0
        local = np.cumsum(seen)
        context = (distinct >> np.uint64(40)).astype(np.int64)
        n = np.zeros((CUT, len(contexts)), np.uint64)
        for r in _LEVELS:
            n[r - 1] = np.bincount(context[total == r], minlength=len(contexts))
        masks = ((n > 0) << _LEVELS[:, None]).sum(axis=0).astype(np.uint8)
        low, home = lower_num[seen], context[seen]
        spread = np.zeros((CUT + 1, len(contexts)), np.uint64)
        for r in _LEVELS:
            spread[r - 1] = np.bincount(home[low == r], minlength=len(contexts))
        spread[CUT] = np.bincount(home[low > CUT], weights=low[low > CUT], minlength=len(contexts))
        out, place, every_told = [], 0, np.zeros(len(contexts), bool)
        for r, c, f in zip(rows, context_at, fans, strict=True):
            size = int(f.sum())
            pairs = at[place : place + size]
            place += size
            got = total[pairs]
            told = c[_told(_flags(r["asked"], len(c)), np.repeat(np.arange(len(c)), f), got)]
            every_told[told] = True
            numbers = None if last else _squeeze(np.diff(local[pairs][got > 0].astype(np.int64), prepend=np.int64(0)))
            out.append(("answer", bucket, order, r["p"], None, None, None, _squeeze(got), numbers, _squeeze(masks[c]), None, _squeeze(n[:, told].ravel()), _squeeze(spread[:, told].ravel()), None))
        some = np.unique(home)
        fan = np.bincount(home, minlength=len(contexts))[some].astype(np.uint32)
        kept = (pack_keys(contexts[some]), _squeeze(fan), _squeeze(distinct[seen] & np.uint64((1 << 40) - 1)), _squeeze(total[seen]))
        weights = (pack_keys(contexts[every_told]), _squeeze(n[:, every_told].ravel()), _squeeze(spread[:, every_told].ravel()))
        out.append(("model", bucket, order, -1, *kept, None, None, *weights, _stats(total)))
        return _table(out, COUNTED)

    return run


def _ask_words(buckets: int):
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                hashes, tally = np.frombuffer(row["vocabulary"], np.uint64), _expand(row["tally"], np.uint32)
                cut = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
                spans = [(i, s, e) for i, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if e > s]
                yield from _table([(i, 1, row["p"], pack_keys(hashes[s:e]), None, None, None, _squeeze(tally[s:e]), None) for i, s, e in spans], REQUESTS).to_batches()

    return run


def _ask(model: Model, order: int):
    def run(encoded: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in encoded.to_pylist():
            c = Chunk(row)
            c.learn(answers.to_pylist(), model, order - 1)
            c.arrange(model)
            rows += [(b, o, row["p"], *rest) for b, o, *rest in c.ask(order)]
        return _table(rows, REQUESTS)

    return run


SCORES = "k {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(model: Model, order: int):
    def run(encoded: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in encoded.to_pylist():
            c, n = Chunk(row), len(row["k"])
            c.learn(answers.to_pylist(), model, order)
            base = np.log10((c.word_count + 1.0) / (model.stats[0][1] + model.stats[0][0] + 1.0))
            base, score = (np.bincount(c.doc, weights=x, minlength=n) for x in (base, c.log_p))
            known = np.bincount(c.doc, weights=c.word_count > 0, minlength=n).astype(np.int64)
            columns = [pa.array(row["k"], encoded.schema.field("k").type.value_type), pa.array(~c.train), pa.array(c.sizes), pa.array(known), pa.array(np.full(n, model.stats[0][1], np.int64)), pa.array(base), pa.array(score)]
            tables.append(pa.Table.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")]))
        return pa.concat_tables(tables)

    return run


def katz_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, by a model of the ``train`` rows.

    Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. n_known counts tokens that occur in
    training texts, train_tokens is N; base_score sums log10((c + 1) / (N + V + 1)); score sums the model's log10
    probabilities, the contexts of the first tokens reaching back before the start of the text.

    A null or empty text is one end token. A null ``train`` means held out. Without training rows every token is
    unknown: P is 1 for the one unknown type, so both scores are 0. Repeated rows and null keys are scored like any
    other; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    encoded = scratch.save(encode(docs, key, text, train), "chunks", by=("kind",))
    vocabulary = encoded.filter("kind = 'words'").select("p", "vocabulary", "tally")
    chunks = encoded.filter("kind = 'text'").select("p", "n", "k", "train", "sizes", "times", "words")
    kind = chunks.schema["k"].dataType.elementType.simpleString()
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET))
    texts = docs.filter(F.coalesce(train, F.lit(False))).count()
    stats: list[list[int]] = []
    answers = None
    for n in range(1, order + 1):
        model = Model(stats, texts, buckets, CHUNK)
        if n == 1:
            asked = vocabulary.mapInArrow(_ask_words(buckets), REQUESTS)
        else:
            asked = chunks.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_ask(model, n), REQUESTS)
        counted = scratch.save(asked.groupBy("bucket").applyInArrow(_count(n == order), COUNTED), f"order{n}", by=("kind",))
        if n == 1:
            scratch.drop("chunks/kind=words")
        sums = counted.filter("kind = 'model'").agg(*[F.sum(F.col("stats")[i]) for i in range(CUT + 3)]).first()
        stats = [*stats, [x or 0 for x in sums]]
        told = counted.filter("kind = 'answer'").select("p", "ord", "bucket", "counts", "numbers", "masks", "levels", "spread")
        answers = told if answers is None else answers.unionByName(told)
    model = Model(stats, texts, buckets, CHUNK)
    scored = chunks.groupBy("p").cogroup(answers.groupBy("p")).applyInArrow(_finish(model, order), SCORES.format(kind))
    return scored.withColumnRenamed("k", key)
