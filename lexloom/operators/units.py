"""Units of text, the pieces that chunks are packed of: how sections part into them, and which of them share a chunk.

Runs of blocks are numbered by windows; which units share a chunk is a fold over their sizes, and texts are sliced once
by the places it finds. All is columns but for the cleaning, the counts and the cuts of units, one pass over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import text as X

#: Types of units whose lines matter: they are kept when a text is cleaned, and blank lines set such units off.
KEEP_LINES = ("qa", "list", "table")
SECTION = ["doc_id", "section_no"]
_UNIT = "array<struct<kind:string,text:string>>"
_WHITE = np.zeros(0x3002, bool)  # by code point, those above as the last
_WHITE[[ord(c) for c in X.WHITE_CHARS]] = True
_LATIN_BYTES = bytes([*range(65, 91), *range(97, 123)])
_WHITE_BYTES, _WIDE_WHITE = bytes(ord(c) for c in X.WHITE_CHARS if c < "\x80"), [c for c in X.WHITE_CHARS if c >= "\x80"]
_CONTROL_BYTES = bytes([*range(9), 11, 12, *range(14, 32), 127])
_DROPPED = re.compile(f"[{X.CONTROL}{X.INVISIBLE}{X.GARBAGE}]")
#: A cleaned piece of a unit: characters, those that are not white space, those of either script.
PIECES = "array<struct<text:string,n:int,solid:int,indic:int,latin:int>>"
_RANGES = "array<struct<first:int,own:int,end:int>>"


def _unit(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), X.strip), lambda x: x != "")


def asking(lines: Column, marks: tuple[str, ...] = ("?", "？")) -> Column:
    """How many lines end in one of the marks."""
    return F.size(F.filter(lines, lambda x: _asks(x, marks)))


def _asks(line: Column, marks: tuple[str, ...] = ("?", "？")) -> Column:
    found = line.endswith(marks[0])
    for m in marks[1:]:
        found = found | line.endswith(m)
    return found


def question_units(lines: Column, barring: tuple[str, ...] = ("?", "？")) -> Column:
    """Units of lines: a question takes in the line below, unless that ends in a ``barring`` mark; others stand alone."""

    def step(s: Column, line: Column) -> Column:
        last = F.element_at(s["units"], -1)
        taken = s["open"] & ~_asks(line, barring)
        grown = F.concat(F.slice(s["units"], F.lit(1), F.size(s["units"]) - 1), F.array(_unit("qa", X.strip(F.concat(last["text"], F.lit("\n"), line)))))
        fresh = F.concat(s["units"], F.array(F.when(_asks(line), _unit("qa", X.strip(line))).otherwise(_unit("paragraph", line))))
        return F.struct(F.when(taken, grown).otherwise(fresh).cast(_UNIT).alias("units"), (~taken & _asks(line)).alias("open"))

    return F.aggregate(lines, F.struct(F.array().cast(_UNIT).alias("units"), F.lit(False).alias("open")), step, lambda s: s["units"])


def text_units(title: Column, text: Column) -> Column:
    """Units of a section without blocks: question units if two lines ask, else list items and sentences of paragraphs."""
    body = F.when(X.text_of(title) != "", X.strip(F.concat(title, F.lit("\n"), X.text_of(text)))).otherwise(X.text_of(text))

    def part(b: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(b, r"\n{2,}"), X.strip), lambda p: p != "")
        of = lambda p: F.when(p.rlike(X.LIST_ITEM_NARROW), F.array(_unit("list", p))).otherwise(F.transform(X.sentences(p), lambda s: _unit("paragraph", s)))
        return F.when(asking(lines_of(b), ("?",)) >= 2, question_units(lines_of(b), ("?",))).otherwise(F.flatten(F.transform(paragraphs, of)))

    return X.let(body, part)


def section_units(sections: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, section_no, of, unit_no, kind, text) of sections; ``of`` has a section's columns but its text and blocks.

    Tables and questions stand alone; runs of list items, and of other blocks, are joined by lines; headings are left
    out. Strictly a list holds on, over what follows it, until a question. Sections without blocks part by their texts.
    """
    part = lambda type, text, ready: F.struct(F.coalesce(type, F.lit("paragraph")).alias("type"), X.text_of(text).alias("text"), F.lit(ready).alias("ready"))
    texts = F.transform(text_units(F.col("section_title"), F.col("text")), lambda u: part(u["kind"], u["text"], True))
    parts = F.when(F.size("blocks") > 0, F.transform("blocks", lambda b: part(b["block_type"], b["text"], False))).otherwise(texts)
    of = F.struct(*[c for c in sections.columns if c not in (*SECTION, "text", "blocks")]).alias("of")
    rows = sections.select(*SECTION, of, F.posexplode(parts).alias("n", "b")).select(*SECTION, "of", "n", "b.*").filter("type <> 'heading'")
    order = Window.partitionBy(*SECTION).orderBy("n")
    alone, item = F.col("type").isin("table", "qa"), F.col("type") == "list"
    if strict:
        last = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
        holds = last("list") > last("qa")
        parts = item & ~holds
    else:
        holds = F.coalesce(F.lag("type").over(order) == "list", F.lit(False))
        parts = item != holds
        holds = item
    parted = F.col("ready") | alone | parts | F.coalesce(F.lag(alone).over(order), F.lit(True))
    kind = F.when(F.col("ready") | alone, F.col("type")).when(item | holds, "list").otherwise("paragraph")
    rows = rows.select(*SECTION, "of", "n", "text", kind.alias("kind"), parted.cast("int").alias("parted"))
    rows = rows.withColumn("unit_no", F.sum("parted").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("n", "text")))
    return rows.groupBy(*SECTION, "unit_no").agg(F.first("of").alias("of"), F.min_by("kind", "n").alias("kind"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def _cuts(text: str, most: int) -> list[tuple[str, int, int, int, int]]:
    """``split_long`` of one text, with the counts of each piece, by sums over its characters: a cut is searched where
    the sums allow it only."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = ~_WHITE[np.minimum(chars, len(_WHITE) - 1)]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]

    def sums(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many flags there are before each word, and up to its end."""
        upto = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=upto[1:])
        return upto[starts], upto[ends]

    indic, latin = sums((chars - 0x980) <= 0x7F), sums(((chars | 32) - 97) < 26)  # unsigned: what lies below wraps around
    length = np.append(0, np.cumsum(ends - starts + 1))  # of all words up to each, with a space after each
    words, out, i = text.split(), [], 0
    while i < len(words):
        low = int(np.searchsorted(length, length[i] + 1 + most * 5 // 2))
        high = min(int(np.searchsorted(length, length[i] + 2 + 4 * most)), len(words))
        end = np.arange(low, high + 1)[: max(high + 1 - low, 0)]
        end = end[end <= len(words)]
        n = length[end] - length[i] - 1
        by = np.where(indic[1][end - 1] - indic[0][i] >= latin[1][end - 1] - latin[0][i], 2.5, 4.0)
        full = np.flatnonzero(np.floor(n / by) >= most)
        cut = int(end[full[0]]) if len(full) else len(words)
        size = int(length[cut] - length[i] - 1)
        out.append((" ".join(words[i:cut]), size, size - (cut - i - 1), int(indic[1][cut - 1] - indic[0][i]), int(latin[1][cut - 1] - latin[0][i])))
        i = cut
    return out


def _pieces(text: str, most: int) -> list[str]:
    return [p[0] for p in _cuts(text, most)]


def _clean(text: str, lines: bool) -> str:
    """``text.clean_text`` of an NFC text."""
    if text.isascii():
        raw = text.encode()
        bare = raw.translate(None, _CONTROL_BYTES)
        text = text if len(bare) == len(raw) else bare.decode()
    else:
        text = _DROPPED.sub("", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-\n" in text or "\xad\n" in text:
        text = re.sub(r"(\w)[-\xad]\n(\w)", r"\1\2", text)
    if "\t" in text or "  " in text:
        blanks = lambda t: re.sub(r"[ \t]{2,}", " ", t)
    else:
        blanks = str
    if lines:
        return "\n".join(x for x in (blanks(y).strip(X.WHITE_CHARS) for y in text.split("\n")) if x).strip(X.WHITE_CHARS)
    if "\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<!\n)\n(?!\n)", " ", text))
        blanks = lambda t: re.sub(r"[ \t]{2,}", " ", t)
    return blanks(text).strip(X.WHITE_CHARS)


def _counts(text: str) -> tuple[int, int, int, int]:
    """(n, solid, indic, latin) of a text, as ``text.shape``."""
    raw = text.encode()
    white = len(raw) - len(raw.translate(None, _WHITE_BYTES))
    latin = len(raw) - len(raw.translate(None, _LATIN_BYTES))
    if len(raw) == len(text):
        return len(text), len(text) - white, 0, latin
    white += sum(text.count(c) for c in _WIDE_WHITE)
    return len(text), len(text) - white, raw.count(b"\xe0\xa6") + raw.count(b"\xe0\xa7"), latin  # U+0980 to U+09FF


def counted(text: Column) -> Column:
    """``text.shape`` of texts, null as empty, in a pass over Arrow batches."""

    @F.arrow_udf("struct<n:int,solid:int,indic:int,latin:int>")
    def count(texts: pa.Array) -> pa.Array:
        rows = [_counts(t.as_py() or "") for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(4)], ["n", "solid", "indic", "latin"])

    return count(text)


def _worth(text: str, lines: bool, least: float, most: int) -> list[tuple[str, int, int, int, int]]:
    """The pieces of a unit, none if it is not worth a vector. A cleaned text has no garbage, whose share is 0."""
    text = _clean(text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text), lines)
    if len(text) < 10:
        return []
    n, solid, indic, latin = _counts(_clean(text, False))
    i, a = (indic / solid, latin / solid) if solid else (0.0, 0.0)
    quality = 0.0 if n < 5 else max(0.0, min(1.0, 0.5 * max(i, a) + 0.3 + 0.2 * min(a + i, 1.0)))
    return _sized(text, most) if quality >= least else []


def _sized(text: str, most: int) -> list[tuple[str, int, int, int, int]]:
    n, solid, indic, latin = _counts(text)
    if max(1, int(n / (2.5 if indic >= latin else 4.0))) > most:
        return _cuts(text, most)
    return [(text, n, solid, indic, latin)]


def worth_pieces(text: Column, lines: Column, least: float, most: int) -> Column:
    """The cleaned pieces of at most ``most`` tokens, cut as by ``split_long``, of units that ``is_embeddable`` keeps.

    The same as ``clean_text``, ``is_embeddable``, ``split_long`` and ``shape``, in one pass over Arrow batches.
    """

    @F.arrow_udf(PIECES)
    def made(texts: pa.Array, lines: pa.Array) -> pa.Array:
        at, flat = [0], ([], [], [], [], [])
        for t, keep in zip(texts, lines):
            for piece in _worth(t.as_py() or "", keep.as_py(), least, most):
                for column, value in zip(flat, piece):
                    column.append(value)
            at.append(len(flat[0]))
        fields = [pa.array(c, pa.string() if k == 0 else pa.int32()) for k, c in enumerate(flat)]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["text", "n", "solid", "indic", "latin"]))

    return made(text, lines)


def split_long(text: Column, most: int) -> Column:
    """Pieces of a text of more than ``most`` tokens, each cut after the word with which it reaches that many.

    Where a piece ends depends on all before it, so this runs in numpy, on Arrow batches of long texts only.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _pieces(t, most))

    return F.coalesce(split(F.when(X.token_count(text) > most, text)), F.array(text))


def pack_ranges(sizes: Column, limit: int, target: int, overlap: int, most: int, strict: bool = True) -> Column:
    """Which units share a chunk, by their sizes: (first, own, end) places from 0, the end exclusive.

    A chunk is closed before the unit that would take it over ``target``; the next begins with its last units, first to
    own - 1, up to ``overlap``. Strictly that tail is at least one unit, however large, and its sum with the next unit is
    not checked; else a tail that would take the sum over ``most`` is dropped. A unit of ``limit`` or more stands alone.
    """
    place = lambda first, own, end: F.array(F.struct(first.cast("int").alias("first"), own.cast("int").alias("own"), end.cast("int").alias("end")))
    zero = F.lit(0)
    start = F.struct(zero.alias("first"), zero.alias("own"), zero.alias("at"), zero.alias("total"), F.array().cast(_RANGES).alias("out"))

    def tail(s: Column, size: Column) -> Column:
        """(n, sum) of the units carried over."""
        held = F.reverse(F.slice(sizes, s["first"] + 1, s["at"] - s["first"]))
        full = lambda t, x: t["full"] | (t["sum"] + x > overlap) & ((t["n"] > 0) | F.lit(not strict))
        take = lambda t, x: F.struct(F.when(full(t, x), t["n"]).otherwise(t["n"] + 1).alias("n"), F.when(full(t, x), t["sum"]).otherwise(t["sum"] + x).alias("sum"), full(t, x).alias("full"))
        found = F.aggregate(held, F.struct(zero.alias("n"), zero.alias("sum"), F.lit(False).alias("full")), take)
        if strict:
            return found
        none = F.struct(zero.alias("n"), zero.alias("sum"), F.lit(False).alias("full"))
        return X.let(found, lambda f: F.when(f["sum"] + size > most, none).otherwise(f))

    def state(first: Column, own: Column, at: Column, total: Column, out: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), own.cast("int").alias("own"), at.cast("int").alias("at"), total.cast("int").alias("total"), out.cast(_RANGES).alias("out"))

    def step(s: Column, size: Column) -> Column:
        some, after = s["first"] < s["at"], s["at"] + 1
        closed = F.when(some, F.concat(s["out"], place(s["first"], s["own"], s["at"]))).otherwise(s["out"])
        alone = state(after, after, after, zero, F.concat(closed, place(s["at"], s["at"], after)))
        fresh = X.let(tail(s, size), lambda t: state(s["at"] - t["n"], s["at"], after, t["sum"] + size, closed))
        return F.when(size >= limit, alone).when(some & (s["total"] + size > target), fresh).otherwise(state(s["first"], s["own"], after, s["total"] + size, s["out"]))

    last = lambda s: F.when(s["first"] < s["at"], F.concat(s["out"], place(s["first"], s["own"], s["at"]))).otherwise(s["out"])
    return F.aggregate(sizes, start, step, last)
