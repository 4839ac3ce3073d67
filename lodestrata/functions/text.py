"""Text primitives with Python's Unicode rules, as engine expressions.

The engine's own ``trim`` only knows the space, and its regex classes are ASCII unless told otherwise; French texts are
full of no-break spaces, so the difference matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Every character that Unicode or Python takes as white space.
WHITE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end. Trimming a set of characters on the right goes over the whole text, so that
    is left out where the last character asks for none."""
    left = F.ltrim(_col(c), F.lit(WHITE))
    return F.when(F.lit(WHITE).contains(F.substr(left, F.lit(-1))), F.rtrim(left, F.lit(WHITE))).otherwise(left)


def odd_lines(c: Column | str) -> Column:
    """Whether a text has other line ends than plain newlines."""
    c, odd = _col(c), F.lit(False)
    for end in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":  # each a plain search for bytes, which a class of a regex is not
        odd |= c.contains(end)
    return odd


def lines(c: Column | str) -> Column:
    """The lines of a text at any Unicode line boundary. An end of line at the very end leaves an empty last item."""
    # plain newlines split without a regex
    return F.when(odd_lines(c), F.split(_col(c), _LINE_END)).otherwise(F.split(_col(c), "\n"))


def unix_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def heading(line: Column | str) -> Column:
    """The label of a heading of level one to three; empty for any other line."""
    return F.regexp_extract(_col(line), rf"(?U)^(#{{1,3}}){_SPACE}+(.*[^\s\x1c-\x1f]){_SPACE}*$", 2)


def is_fence(line: Column | str) -> Column:
    return _col(line).rlike(rf"(?U)^{_SPACE}*(```|~~~)")


def file_type(name: Column | str) -> Column:
    """The last suffix in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(_col(name), r"(?s)^.+\.([^.]+)$", 1))
