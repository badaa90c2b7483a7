"""Range expressions of spreadsheets and of line-based tables."""

from __future__ import annotations

import re
from dataclasses import dataclass


class InvalidRange(ValueError):
    pass


@dataclass(frozen=True)
class RangeSpec:
    """Inclusive bounds from 0; an end of None is the table's last row or column."""

    kind: str
    r0: int = 0
    r1: int | None = None
    c0: int = 0
    c1: int | None = None


def column_index(letters: str) -> int:
    out = 0
    for ch in letters.upper():
        out = out * 26 + ord(ch) - 64
    return out - 1


def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, digit = divmod(index - 1, 26)
        out = chr(65 + digit) + out
    return out


def _end(text: str) -> tuple[int | None, int | None]:
    """Row and column of one end of a range, either of which may be absent."""
    hit = re.fullmatch(r"([A-Za-z]*)(\d*)", text.strip())
    if not hit or not text.strip():
        raise InvalidRange(text)
    if hit[2] and int(hit[2]) == 0:
        raise InvalidRange(f"{text}: rows count from 1")
    return (int(hit[2]) - 1 if hit[2] else None), (column_index(hit[1]) if hit[1] else None)


def parse(text: str) -> RangeSpec:
    """A1:C10, A:C, 1:10, A1, A, 1, * or nothing; ends of different kinds are an error."""
    bare = text.strip()
    if bare in ("", "*"):
        return RangeSpec("used")
    parts = bare.split(":")
    if len(parts) > 2:
        raise InvalidRange(text)
    (ra, ca), (rb, cb) = _end(parts[0]), _end(parts[-1])
    if (ra is None) != (rb is None) or (ca is None) != (cb is None):
        raise InvalidRange(text)
    if ra is None:
        return RangeSpec("columns", c0=ca, c1=cb)
    if ca is None:
        return RangeSpec("rows", r0=ra, r1=rb)
    return RangeSpec("cell" if len(parts) == 1 else "cells", ra, rb, ca, cb)


def parse_strict(text: str) -> RangeSpec:
    """Cell ranges and single cells only."""
    spec = parse(text)
    if spec.kind not in ("cell", "cells"):
        raise InvalidRange(f"{text}: a range of cells is asked for")
    return spec


def parse_rows(text: str) -> tuple[int, int | None]:
    """Rows of a line-based table: `a:b` or `n` from 1, all for `*` or nothing."""
    bare = text.strip()
    if bare in ("", "*"):
        return 0, None
    try:
        ends = [int(x) for x in bare.split(":")]
    except ValueError as e:
        raise InvalidRange(text) from e
    if len(ends) > 2 or min(ends) < 1:
        raise InvalidRange(text)
    return ends[0] - 1, ends[-1] - 1
