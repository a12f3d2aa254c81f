"""Untrusted text made safe to show, on the driver and as column expressions."""

from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_CAP = 200
NULL_MARK = "␀"
_LINE = "\n\r\x0b\x0c\u2028\u2029"
_SPACES = re.compile(r"[ \t]+")


def sanitize(text: str, cap: int = CELL_CAP) -> str:
    """One visible line: line breaks as a literal \\n, tabs and runs of spaces as one space, other controls dropped.

    Longer text ends in an ellipsis within the cap.
    """
    if cap <= 0:
        raise ValueError(f"cap must be positive, got {cap}")
    text = text.replace("\r\n", "\n")
    out = "".join("\\n" if c in _LINE else c if c == "\t" or not unicodedata.category(c).startswith("C") else "" for c in text)
    out = _SPACES.sub(" ", out).strip()
    return out if len(out) <= cap else out[: cap - 1] + "…"


def sanitized(text: Column) -> Column:
    """sanitize() without a cap, as an expression."""
    out = F.regexp_replace(text, "\r\n", "\n")
    out = F.regexp_replace(out, "[\n\r\x0b\x0c\u2028\u2029]", r"\\\\n")
    out = F.regexp_replace(out, "\t", " ")
    out = F.regexp_replace(out, r"\p{C}", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def cut(value: object, cap: int = CELL_CAP) -> str:
    """Plain text of a value, cut hard."""
    return str(value)[:cap]


def cell_text(value: object) -> str:
    """The text of a typed cell as SQL engines cast it; floats in their shortest round-trip form."""
    if value is None:
        return NULL_MARK
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("inf" if value > 0 else "-inf") if math.isinf(value) else repr(value)
    if isinstance(value, dt.datetime):
        value = value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
        text = value.isoformat(" ")
        return text.rstrip("0") if "." in text else text
    if isinstance(value, Decimal):
        return format(value, "f")
    return str(value)


def md_cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def cut_bytes(text: str, cap: int) -> str:
    """At most cap UTF-8 bytes, a marker of truncation included."""
    data = text.encode("utf-8")
    if len(data) <= cap:
        return text
    mark = "\n… (truncated)"
    return data[: max(0, cap - len(mark.encode("utf-8")))].decode("utf-8", "ignore") + mark
