"""Line and word expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters trimmed by a Unicode-aware strip, beyond those of (?U)\s.
BLANK = r"[\s\x1c-\x1f]"
# the characters of (?U)BLANK; also those that str.split() and str.strip() know
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_INITIAL = "▁"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides (plain ``trim`` only removes U+0020)."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def physical_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def words(line: Column) -> Column:
    """Whitespace-separated words of an already stripped, non-blank line."""
    return F.split(line, rf"(?U){BLANK}+")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def normal_key(line: Column) -> Column:
    """Comparison key of near-identical lines: lowercase, letters only."""
    return F.lower(letters(line))


def chunk_pieces(word: Column, size: int = 3) -> Column:
    """Cut a word into pieces of ``size`` characters; the first carries the word-initial marker."""
    # one pass over the marked word instead of an expression per piece
    pieces = F.regexp_extract_all(F.concat(F.lit(WORD_INITIAL), word), F.lit(rf"(?s)\A.{{1,{size + 1}}}|.{{1,{size}}}"), F.lit(0))
    return F.when(F.char_length(word) > 0, pieces).otherwise(F.array().cast("array<string>"))
