"""Arrow arrays as Python values, for the functions that read whole documents."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


def values(array: pa.Array) -> list:
    """What ``to_pylist`` gives, column by column: it makes an object of every struct and list on the way, which costs most of its time."""
    if pa.types.is_list(array.type):
        flat, sizes = values(array.flatten()), pc.list_value_length(array).to_pylist()
        out, at = [], 0
        for n in sizes:
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(array.type):
        names = [f.name for f in array.type]
        rows = [dict(zip(names, r, strict=True)) for r in zip(*(values(c) for c in array.flatten()), strict=True)]
        return rows if array.null_count == 0 else [r if ok else None for r, ok in zip(rows, array.is_valid().to_pylist(), strict=True)]
    return array.to_pylist()
