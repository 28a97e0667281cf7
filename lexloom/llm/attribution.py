"""Token counts by section: a whole document is encoded once, and its tokens go to sections by their spans.

Byte-level tokens tile a text's UTF-8 bytes, so lengths of tokens give their spans; an interval join (a binary search
over the sections' starts) places each. A token that crosses a boundary goes whole to one section, by a stated rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import raw, tune

#: start: where the token's first byte is; end: where its last byte is; majority: where most of its bytes are, the
#: earliest of equals.
RULES = ("start", "end", "majority")


#: White space runs so long that the splitting pattern would run out of stack on them.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class Spans:
    """Token ids and byte lengths of texts by a file of byte-level ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def ids(self, text: str) -> list[int]:
        """A long run of white space is one piece of the pattern but for its last character, which goes with what follows."""
        out: list[int] = []
        done = 0
        for m in LONG_SPACE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[done : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            done = end
        return out + self.encoding.encode_ordinary(text[done:])

    def lengths(self, text: str) -> np.ndarray:
        return self.sizes[np.array(self.ids(text), np.int64)]


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross a boundary, of each section; bounds: the sections' starts, then the text's end."""
    n = len(bounds) - 1
    end = np.cumsum(lengths)
    start = end - lengths
    first = np.searchsorted(bounds[:-1], start, "right") - 1
    last = np.searchsorted(bounds[:-1], end - 1, "right") - 1
    place = {"start": first, "end": last}.get(rule)
    if place is None:
        place = first.copy()
        for i in np.flatnonzero(first != last).tolist():
            s = np.arange(first[i], last[i] + 1)
            place[i] = s[np.argmax(np.minimum(bounds[s + 1], end[i]) - np.maximum(bounds[s], start[i]))]
    return np.bincount(place, minlength=n), np.bincount(place[first != last], minlength=n)


def section_tokens(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", fields: tuple[str, ...] = ("text",), by_line: bool = True, rule: str = "start") -> DataFrame:
    """(key, field, section, start, end, n_tokens, n_crossing) of each section of each row of ``docs``.

    A document is its fields in order, each but the last followed by a line feed that belongs to it; the whole is encoded
    once. Sections are fields, or with ``by_line`` the lines of fields, numbered from 0 in each field; a line feed belongs
    to the line that it ends, and a text that ends in one has an empty last line. Sections are half-open spans of
    characters of the document and tile it. n_crossing counts the tokens in n_tokens that also touch another section;
    ``rule`` says where they go (see RULES). The counts of a document sum to its tokens.

    A null field is an empty one, and an empty field is one empty section with no tokens. Repeated rows and null keys give
    their sections each time; an empty table gives no rows. Other columns are not read. No row meets another.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)])
    kind = rows.schema["k"].dataType.simpleString()
    names = ["k", "field", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = Spans(ranks, pattern)
        for b in batches:
            at, field, section, start, end, tokens, crossing = [], [], [], [], [], [], []
            for i, parts in enumerate(zip(*(raw(c) for c in b.columns[1:]), strict=True)):
                whole = b"\n".join(parts)
                data = np.frombuffer(whole, np.uint8)
                begins, offset = [], 0
                for f, part in enumerate(parts):
                    inner = np.flatnonzero(data[offset : offset + len(part)] == 10) + 1 + offset if by_line else np.zeros(0, np.int64)
                    mine = np.concatenate([[offset], inner])
                    begins.append(mine)
                    field += [fields[f]] * len(mine)
                    section += range(len(mine))
                    offset += len(part) + 1
                bounds = np.concatenate([*begins, [len(whole)]]).astype(np.int64)
                n, crossed = attribute(spans.lengths(whole.decode()), bounds, rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                at += [i] * len(n)
                start += chars[:-1].tolist()
                end += chars[1:].tolist()
                tokens += n.tolist()
                crossing += crossed.tolist()
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(section, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, end, tokens, crossing))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, f"k {kind}, field string, section int, start long, end long, n_tokens long, n_crossing long").withColumnRenamed("k", key)
