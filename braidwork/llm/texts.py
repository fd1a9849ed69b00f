"""Text columns as Python strings."""

from __future__ import annotations

import pyarrow as pa


def strings(column: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]
