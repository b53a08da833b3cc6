"""Column-expression helpers for text, all JVM-side (no Python UDF).

FIXED VALUES:
    Python ``str.isspace`` code points (what ``str.strip()``/``str.split()`` cut on):
        U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
        U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    GPT-2-style pre-token pattern without the look-ahead:
         ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character class of Python whitespace, written for both Java regex and RE2.
PY_WS_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PRETOKEN_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

# Python float() / int() literal grammar (after lower-casing), incl. digit underscores.
_DIGITS = r"[0-9](_?[0-9])*"
PY_FLOAT_RE = (
    rf"^[+-]?(({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?"
    r"|nan|inf|infinity)$"
)
PY_INT_RE = rf"^[+-]?{_DIGITS}$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: cut Unicode whitespace on both ends."""
    return F.regexp_replace(col_(c), rf"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")


def py_split(c) -> Column:
    """Python ``str.split()`` with no argument, on an already stripped string."""
    c = col_(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, f"{PY_WS_CLASS}+"))


def count_char(c, ch: str) -> Column:
    c = col_(c)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def pretokens(c) -> Column:
    """Lossless GPT-2-style split into surface tokens (``ARRAY<STRING>``)."""
    return F.regexp_extract_all(col_(c), F.lit(PRETOKEN_PATTERN), 0)


def keyed_uniform(*parts) -> Column:
    """Reproducible uniform in [0, 1): first 13 hex digits of md5(parts joined by ':') / 2^52."""
    h = F.md5(F.concat_ws(":", *[col_(p) if not isinstance(p, (int, float)) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def join_ints(c, sep: str = " ") -> Column:
    return F.array_join(F.transform(col_(c), lambda x: x.cast("string")), sep)
