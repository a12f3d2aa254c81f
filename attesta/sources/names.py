"""SQL-safe column names from untrusted headers."""

from __future__ import annotations

import re

#: Reserved words of the SQL dialect that datasets must stay usable in; fixed values.
RESERVED = frozenset(
    """all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create default
    deferrable desc describe distinct do else end except false fetch for foreign from group having in initially intersect
    into lambda lateral leading limit not null offset on only or order pivot pivot_longer pivot_wider placing primary
    qualify references returning select show some summarize symmetric table then to trailing true union unique unpivot
    using variadic when where window with""".split()
)


def safe_name(header: str, position: int) -> str:
    """Lower case, other characters as single underscores; empty ones by position, digits and reserved words amended."""
    name = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "_", header.lower()).strip("_"))
    if not name:
        return f"col_{position}"
    if name[0].isdigit():
        name = f"c_{name}"
    return f"{name}_" if name in RESERVED else name


def normalize(headers: list[str]) -> list[str]:
    """Unique safe names in order; a name that is taken gets the first free number from 2 on."""
    taken: set[str] = set()
    out = []
    for position, header in enumerate(headers):
        base = name = safe_name(header, position)
        number = 2
        while name in taken:
            name, number = f"{base}_{number}", number + 1
        taken.add(name)
        out.append(name)
    return out


def unique_output(names: list[str]) -> list[str]:
    """Output column names of a query made distinct, whatever their case: a, a_1, a_2."""
    taken: set[str] = set()
    out = []
    for base in names:
        name, number = base, 1
        while name.lower() in taken:
            name, number = f"{base}_{number}", number + 1
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
