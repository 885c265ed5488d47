"""String columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    """* any run, ? one character, [..] a set ([!..] its complement); anchored at both ends."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


def glob(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(("(?is)" if ignore_case else "(?s)") + glob_to_regex(pattern))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)
