"""Fields of length-prefixed binary records, decoded inside Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if i >= len(b) or shift > 63:
            raise ValueError
        value |= (b[i] & 0x7F) << shift
        i += 1
        if not b[i - 1] & 0x80:
            return value, i
        shift += 7


def fields(b: bytes) -> dict[int, list[int | bytes]]:
    """Values by field number; raises ValueError on malformed input."""
    out: dict[int, list[int | bytes]] = {}
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                size, i = _varint(b, i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError
            value, i = b[i : i + size], i + size
            if i > len(b):
                raise ValueError
        out.setdefault(key >> 3, []).append(value)
    return out


def _first(f: dict, n: int, kind: type, default=None):
    for v in f.get(n, ()):
        if isinstance(v, kind):
            return v
    if default is None:
        raise ValueError
    return default


def _uri(b: bytes, depth: int = 8) -> str | None:
    if b.startswith(b"file:///"):
        return b.decode("utf-8", "replace")
    if not depth:
        return None
    try:
        inner = fields(b)
    except ValueError:
        return None
    return next((u for n in inner for v in inner[n] if isinstance(v, bytes) and (u := _uri(v, depth - 1))), None)


def _generation(blob: pd.Series) -> pd.DataFrame:
    """Start time and token counts of a generation record; null where malformed."""
    rows = []
    for b in blob:
        try:
            f = fields(bytes(b))
            t, u = fields(_first(f, 1, bytes)), fields(_first(f, 9, bytes))
            rows.append((_first(t, 1, int), _first(t, 2, int, 0), *(_first(u, n, int, 0) for n in (2, 3, 5))))
        except (ValueError, TypeError):
            rows.append((None,) * 5)
    return pd.DataFrame(rows, columns=["seconds", "nanos", "input", "output", "cached"], dtype="Int64")


def _workspace_uri(blob: pd.Series) -> pd.Series:
    """The first file:/// text in a record, to depth 8."""
    return blob.map(lambda b: _uri(bytes(b)) if b is not None else None)


def generation(blob: str) -> Column:
    return F.pandas_udf(_generation, "seconds long, nanos long, input long, output long, cached long")(blob)


def workspace_uri(blob: str) -> Column:
    return F.pandas_udf(_workspace_uri, "string")(blob)
