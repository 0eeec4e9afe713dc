"""Text column expressions: blank test, Unicode strip, word regex, byte mapping.

All are native Catalyst expressions (regex, array higher-order functions), so
they run inside whole-stage code generation; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the pipeline's text rules) -------------------
# Characters removed by Python's str.strip(): Java \s, vertical tab, the four
# information separators U+001C..U+001F, NEL U+0085 and Unicode separators \p{Z}.
STRIP_CLASS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
# Byte-level pre-tokenizer word pattern (GPT-2 style, no prefix space added).
WORD_PATTERN = (r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
                r"| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Special tokens and their ids, in id order.
SPECIAL_TOKENS = ["<pad>", "<bos>", "<unk>"]
PAD_ID, BOS_ID, UNK_ID = 0, 1, 2
# ---------------------------------------------------------------------------

NONBLANK_PATTERN = f"[^{STRIP_CLASS}]"


def is_not_blank(col: Column) -> Column:
    """True when ``str.strip() != ''``; NULL stays NULL (dropped by filter)."""
    return col.rlike(NONBLANK_PATTERN)


def unicode_strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{STRIP_CLASS}]+|[{STRIP_CLASS}]+$", "")


def pretokenize(col: Column) -> Column:
    """Split text into byte-level words; concatenating them gives the text back."""
    return F.regexp_extract_all(col, F.lit(WORD_PATTERN), 0)


def utf8_bytes(col: Column, first: int | None = None, last: int | None = None) -> Column:
    """String -> array<int> of its UTF-8 bytes, or of the ``first`` or ``last`` so many, cut before they become an array.

    The UTF-8 bytes are decoded as ISO-8859-1, which maps every byte to one
    character with the same code, so ``ascii`` of each character is the byte
    (linear, no per-byte number parsing).
    """
    data = F.encode(col, "UTF-8")
    if first is not None:
        data = F.substring(data, 1, first)
    if last is not None:
        data = F.substring(data, -last, last)
    latin = F.decode(data, "ISO-8859-1")
    return F.when(F.length(latin) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(latin, ""), lambda c: F.ascii(c)))


def printable_code_point(b: Column) -> Column:
    """Byte -> code point of its printable stand-in (byte-level alphabet rule).

    Printable bytes 33..126, 161..172, 174..255 stand for themselves; the other
    68 bytes (0..32, 127..160, 173) are numbered 256, 257, ... in byte order.
    """
    return (F.when(((b >= 33) & (b <= 126)) | ((b >= 161) & (b <= 172)) | (b >= 174), b)
            .when(b <= 32, b + 256)
            .when(b <= 160, b - 127 + 289)
            .otherwise(F.lit(323)))


def code_point_to_string(cp: Column) -> Column:
    """Code point (< 2048) -> one-character string, built from its UTF-8 bytes."""
    one = F.lpad(F.hex(cp), 2, "0")
    two = F.concat(F.hex(F.floor(cp / 64) + 192), F.hex(F.pmod(cp, F.lit(64)) + 128))
    return F.decode(F.unhex(F.when(cp < 128, one).otherwise(two)), "UTF-8")


def hex_to_text(h: Column) -> Column:
    """Hex string of UTF-8 bytes -> text (invalid sequences become U+FFFD)."""
    return F.decode(F.unhex(h), "UTF-8")
