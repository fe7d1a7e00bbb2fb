"""Column expressions over untyped text fields, and driver-side query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the blank test treats as white space (no U+00A0).
BLANK_CHARACTERS = frozenset(
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a"
    "\u2028\u2029\u205f\u3000"
)
# Trimming removes every character up to and including U+0020.
TRIMMED_CHARACTERS = "".join(map(chr, range(0x21)))

# Characters with a meaning of their own in a regular expression.
_REGEX_SPECIAL = frozenset("\\^$.|?*+()[]{}")


def is_blank(text: str | None) -> bool:
    return text is None or all(c in BLANK_CHARACTERS for c in text)


def trim_query(text: str) -> str:
    return text.strip(TRIMMED_CHARACTERS)


def _separator_pattern(separator: str) -> str:
    # A plain or backslash-escaped single character keeps the JVM's split off
    # the regex engine.
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in separator)


def split_fields(line: Column, separator: str) -> Column:
    """Fields of a raw line; trailing empty fields stay, an empty line has one field."""
    return F.split(line, _separator_pattern(separator), -1)


def line_field(line: Column, separator: str, index: int) -> Column:
    """One field of a raw line, or NULL; the line is split no further than needed."""
    return F.get(F.split(line, _separator_pattern(separator), index + 2), F.lit(index))


def raw_field(fields: Column, index: int) -> Column:
    """The field, or NULL where the row has no such column."""
    return F.get(fields, F.lit(index)) if index >= 0 else F.lit(None).cast("string")


def pad_fields(fields: Column, columns: int) -> Column:
    """Rows shorter than ``columns`` filled up with empty fields."""
    missing = F.greatest(F.lit(columns) - F.size(fields), F.lit(0))
    return F.concat(fields, F.array_repeat(F.lit(""), missing))


def folded(text: Column, order: str = "utf8") -> Column:
    """Case-folded sort text.

    ``order='utf16'`` compares UTF-16 code units instead of code points; the
    two differ only between U+E000..U+FFFF and supplementary characters.
    """
    if order not in ("utf8", "utf16"):
        raise ValueError(f"order must be 'utf8' or 'utf16', not {order!r}")
    low = F.lower(text)
    return low if order == "utf8" else F.encode(low, "UTF-16BE")


def join_fields(columns: list[Column], separator: str) -> Column:
    """Columns (never NULL) joined into one line; no columns give an empty line."""
    return F.concat_ws(separator, *columns) if columns else F.lit("")


def parse_line_number(text: Column) -> Column:
    """A user's line number as BIGINT; NULL for anything but an integer."""
    return F.trim(text, F.lit(TRIMMED_CHARACTERS)).try_cast("bigint")


def line_label(line_number: Column) -> Column:
    """Line number with thousands separators, ``1,234,567``."""
    return F.format_number(line_number, 0)
