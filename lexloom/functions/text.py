"""Text functions on columns. All are built-in expressions but for Unicode composition, which runs on Arrow batches.

Null texts count as empty ones unless a docstring says otherwise. Classes follow Unicode, not ASCII: white space here
includes U+001C to U+001F, word characters are letters, numbers and the underscore but no combining marks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes that results depend on.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space, as all that is not other: single characters below U+0100 are a bitmap to the regex engine and looked up first.
WHITE = "[^" + "".join(f"\\x{c:02x}" for c in range(0x100) if chr(c) not in WHITE_CHARS) + r"\u0100-\u167f\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}]"
INDIC = r"[\u0980-\u09ff]"
LATIN = "[A-Za-z]"
GARBAGE = r"\u0141-\u0142\u02a2\u02e4\u034b-\u034e\u0350-\u0361"
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
INVISIBLE = r"\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufffe-\uffff"
WORD = r"[\p{L}\p{N}_]"
#: Finds the first character that may be in CONTROL, INVISIBLE or GARBAGE, or a carriage return. Single characters below
#: U+0100 are a bitmap to the regex engine, so that texts without such characters are passed over quickly.
SUSPECT = "[^" + "".join(f"\\x{c:02x}" for c in (9, 10, *range(0x20, 0x7F), *range(0x80, 0x100))) + r"\u0100-\u0140\u0143-\u02a1\u0362-\u1fff\u2070-\ufefe]"
PAGE_LABEL = "(?iu)^(?:পৃষ্ঠা|পৃ\\.|Page|P\\.?)(?U)[\\s\\x1c-\\x1f]*\\p{Nd}+[\\s\\x1c-\\x1f./-]*$"
PAGE_DIGITS = r"(?U)^[\p{Nd}./\s\x1c-\x1f-]{1,12}$"
LIST_ITEM = "(?U)^[\\s\\x1c-\\x1f]*(?:[-•*]|\\p{Nd}+[.)]|[(][a-zA-Z০-৯][)]|\\([ivx]+\\))[\\s\\x1c-\\x1f]+"
LIST_ITEM_NARROW = "(?U)^[\\s\\x1c-\\x1f]*(?:[-•*]|\\p{Nd}+[.)])[\\s\\x1c-\\x1f]+"
QUESTION_LINE = r"(?U)^[^\n]*\?[\s\x1c-\x1f]*$"
HEADING_LINE = "(?U)^[\\s\\x1c-\\x1f]*(?:\\p{Nd}+[.)][\\s\\x1c-\\x1f]+|[०-९]+[.)][\\s\\x1c-\\x1f]+)?[^\\s\\x1c-\\x1f][^\\n]{0,100}$"
SENTENCE_GAP = "(?U)(?<=[।.?!])[\\s\\x1c-\\x1f]+"
SENTENCE_END = "[।.?!:;]$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text_of(c: Column | str) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at both ends; null stays null."""
    return F.btrim(_c(c), F.lit(WHITE_CHARS))


def words(c: Column | str) -> Column:
    """Runs of characters that are not white space."""
    return F.filter(F.split(text_of(c), f"{WHITE}+"), lambda w: w != "")


def count_of(c: Column | str, characters: str) -> Column:
    """How many characters of a class ``[...]`` a text has: what is left without runs of others."""
    return F.length(F.regexp_replace(text_of(c), f"[^{characters[1:-1]}]+", ""))


def shape(c: Column | str) -> Column:
    """(n, solid, indic, latin): characters of a text, those that are not white space, and those of either script."""
    t = text_of(c)
    return F.struct(F.length(t).alias("n"), F.length(F.translate(t, WHITE_CHARS, "")).alias("solid"), count_of(t, INDIC).alias("indic"), count_of(t, LATIN).alias("latin"))


def share_of(m: Column, script: str) -> Column:
    """A script's share of the solid characters of a shape; 0 if there are none."""
    return F.when(m["solid"] == 0, F.lit(0.0)).otherwise(m[script] / m["solid"])


def indic_ratio(c: Column | str) -> Column:
    """Share of Bengali-Assamese characters among those that are not white space; 0 if there are none."""
    return F.when(text_of(c).rlike(INDIC), let(shape(c), lambda m: share_of(m, "indic"))).otherwise(F.lit(0.0))


def latin_ratio(c: Column | str) -> Column:
    """Share of unaccented Latin letters among characters that are not white space; 0 if there are none."""
    return let(shape(c), lambda m: share_of(m, "latin"))


def language_of(m: Column, default: Column | str = "as") -> Column:
    """The language of a text by its shape, as ``detect_language``."""
    other = F.lit(default) if isinstance(default, str) else default
    i, a = share_of(m, "indic") >= 0.15, share_of(m, "latin") >= 0.15
    return F.when(i & a, "mixed").when(i, "as").when(a, "en").otherwise(other)


def detect_language(c: Column | str, default: Column | str = "as") -> Column:
    """mixed, as or en by script shares of at least 0.15; else ``default`` (a language, or a column of them)."""
    return let(shape(c), lambda m: language_of(m, default))


def detect_query_language(c: Column | str) -> Column:
    """en if Latin letters outweigh Indic ones, else as (so for empty texts and digits)."""
    return F.when(count_of(c, LATIN) > count_of(c, INDIC), "en").otherwise("as")


def garbage_ratio(c: Column | str) -> Column:
    """Share of characters that OCR leaves as garbage, among all; 0 for an empty text."""
    n = F.length(text_of(c))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text_of(c), F.lit(f"[{GARBAGE}]")) / n)


def quality_of(m: Column, c: Column | str) -> Column:
    """The quality of a text by its shape and itself, as ``quality_score``."""
    i, a = share_of(m, "indic"), share_of(m, "latin")
    score = F.lit(0.5) * F.greatest(i, a) + F.lit(0.3) * (F.lit(1.0) - garbage_ratio(c) * 10) + F.lit(0.2) * F.least(a + i, F.lit(1.0))
    return F.when(F.length(strip(text_of(c))) < 5, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def quality_score(c: Column | str) -> Column:
    """0 to 1: half for the main script's share, 0.3 for freedom from garbage, 0.2 for both scripts' share; 0 if short."""
    return let(shape(c), lambda m: quality_of(m, c))


#: Arrow batches handed to Python hold at most so many rows and bytes, so that long texts stay small in memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, from now on: plans run later than they are made, so it cannot be undone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose(c: Column | str) -> Column:
    """NFC. ASCII texts, which it leaves alone, are not sent to Python."""
    return F.coalesce(_compose(F.when(text_of(c).rlike(r"[^\x00-\x7F]"), text_of(c))), text_of(c))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t).casefold())
        return unicodedata.normalize("NFC", re.sub("[\u0300-\u036f]", "", plain))

    return texts.map(lambda t: None if t is None else one(t))


def fold(c: Column | str) -> Column:
    """A text for search: compatibility characters composed, cases folded, accents dropped; vowel signs and other marks
    of Indic scripts stay. ASCII texts are but lower-cased and not sent to Python."""
    t = text_of(c)
    return F.coalesce(_folded(F.when(t.rlike(r"[^\x00-\x7F]"), t)), F.lower(t))


def _unwrap(c: Column, drop: str) -> Column:
    """Without the characters of class ``drop``, line ends as LF, words that a hyphen parts at a line end joined."""
    c = let(c, lambda x: F.when(x.rlike(SUSPECT), F.regexp_replace(F.regexp_replace(x, f"[{drop}]", ""), r"\r\n?", "\n")).otherwise(x))
    joined = lambda x: F.regexp_replace(x, rf"({WORD})[-\xad]\n({WORD})", "$1$2")
    return let(c, lambda x: F.when(x.contains("-\n") | x.contains("\xad\n"), joined(x)).otherwise(x))


def normalize(c: Column | str, composed: bool = False) -> Column:
    """NFC, then without control, invisible and garbage characters, line ends as LF, hyphenated line ends joined.

    With ``composed`` the text is taken to be NFC already and no Python runs.
    """
    return _unwrap(text_of(c) if composed else compose(c), CONTROL + INVISIBLE + GARBAGE)


def _lay_out(c: Column, lines: bool) -> Column:
    if lines:
        kept = F.filter(F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]{2,}", " "))), lambda x: x != "")
        return strip(F.array_join(kept, "\n"))
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def clean_text(c: Column | str, lines: bool = False, composed: bool = False) -> Column:
    """Normalised text with runs of blanks collapsed. With ``lines`` its lines are kept, but for blank ones; else single
    line ends become spaces and runs of them one blank line."""
    return _lay_out(normalize(c, composed), lines)


def clean_text_simple(c: Column | str, lines: bool | Column | None = None, composed: bool = False) -> Column:
    """The older cleaning: as ``clean_text`` but invisible and garbage characters stay. lines None: as the text looks."""
    base = _unwrap(text_of(c) if composed else compose(c), CONTROL)
    if isinstance(lines, bool):
        return _lay_out(base, lines)
    keep = looks_like_questions(base) if lines is None else lines
    return F.when(keep, _lay_out(base, True)).otherwise(_lay_out(base, False))


def looks_like_questions(c: Column | str) -> Column:
    """Whether at least two lines end in a question mark, ASCII or full-width."""
    return F.size(F.filter(F.transform(F.split(text_of(c), "\n"), strip), lambda x: x.endswith("?") | x.endswith("？"))) >= 2


def is_embeddable(c: Column | str, min_quality: float, composed: bool = False) -> Column:
    """Whether a text is worth a vector: at least 10 characters and, once cleaned, of the quality asked for."""
    return (F.length(strip(text_of(c))) >= 10) & (let(clean_text(c, composed=composed), quality_score) >= min_quality)


def normalize_line(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(text_of(c))), f"{WHITE}+", " ")


def is_page_number(c: Column | str) -> Column:
    """Whether a stripped line is a page number: a label and digits, or up to 12 digits, dots, slashes, dashes, blanks."""
    return _c(c).rlike(PAGE_LABEL) | _c(c).rlike(PAGE_DIGITS)


def is_list_item(c: Column | str) -> Column:
    return text_of(c).rlike(LIST_ITEM)


def is_question(c: Column | str) -> Column:
    return text_of(c).rlike(QUESTION_LINE)


def is_heading(c: Column | str, block_type: Column, heading_level: Column) -> Column:
    """Whether a block is a heading: marked so, or a short line of at most 15 words that does not end a sentence."""
    line = strip(text_of(c))
    short = (line != "") & (F.length(line) <= 120)
    looks = ~line.rlike(SENTENCE_END) & (F.size(words(line)) <= 15) & (line.rlike(HEADING_LINE) | heading_level.isNotNull())
    return short & (F.coalesce(block_type == "heading", F.lit(False)) | looks)


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(text_of(c), SENTENCE_GAP), strip), lambda x: x != "")


def tokens_of(m: Column) -> Column:
    """Tokens of a text by its shape, as ``token_count``; both scripts' shares have one denominator, so counts compare."""
    size = F.when(m["indic"] >= m["latin"], F.lit(2.5)).otherwise(F.lit(4.0))
    return F.when(m["n"] == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(m["n"] / size).cast("int")))


def token_count(c: Column | str) -> Column:
    """Tokens, by length: 2.5 characters each where Indic letters are at least as many as Latin ones, else 4; 0 if empty."""
    t = text_of(c)
    return let(F.struct(F.length(t).alias("n"), count_of(t, INDIC).alias("indic"), count_of(t, LATIN).alias("latin")), tokens_of)


def content_hash(c: Column | str) -> Column:
    return F.sha2(text_of(c).cast("binary"), 256)


def summary(c: Column | str) -> Column:
    """(len, sha1 of 12 digits, preview of 120 characters); for an empty text (0, null, '')."""
    t = text_of(c)
    return F.struct(F.length(t).alias("len"), F.when(t != "", F.substring(F.sha1(t.cast("binary")), 1, 12)).alias("sha1"), F.substring(t, 1, 120).alias("preview"))


def token_set(c: Column | str) -> Column:
    """Distinct lower-cased words, punctuation kept."""
    return F.array_distinct(words(F.lower(text_of(c))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    both = lambda x: F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"])))
    return let(F.struct(a.alias("a"), b.alias("b")), both)


def preview(c: Column | str, n: int = 180) -> Column:
    return F.substring(_c(c), 1, n)


def uuid_or_null(c: Column | str) -> Column:
    """The canonical form of a UUID, or null."""
    plain = F.regexp_replace(F.lower(strip(_c(c))), r"^urn:uuid:|[{}-]", "")
    parts = [F.substring(plain, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def document_id_list(c: Column | str) -> Column:
    """A JSON array of UUIDs as an array; null where the text is null, not an array, or any item is no UUID."""
    ids = F.transform(F.from_json(_c(c), "array<string>"), uuid_or_null)
    return F.when(~F.exists(ids, lambda x: x.isNull()), ids)


def default_if_unset(c: Column | str, other: Column) -> Column:
    """``other`` where a number is null or 0."""
    return F.coalesce(F.nullif(_c(c), F.lit(0)), other)
