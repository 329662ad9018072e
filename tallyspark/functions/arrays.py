"""Arrow texts by their bytes: what is kept of all of them at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and ends in them."""
    _, at, data = x.buffers()
    if not len(x) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(x) + 1, np.int64)
    at = np.frombuffer(at, np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _texts(x: pa.Array, data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The texts again, of `data` only what is kept; null where `x` is."""
    ends = np.concatenate([[0], np.cumsum(keep)])[at].astype(np.int32)
    out = pa.StringArray.from_buffers(len(x), pa.py_buffer(ends), pa.py_buffer(data[keep]))
    return pc.if_else(pc.is_valid(x), out, None) if x.null_count else out


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("ascii"))] = True
    return table


def only(x: pa.Array, chars: str) -> pa.Array:
    """The texts without anything but these ASCII characters."""
    data, at = _bytes(x)
    return _texts(x, data, at, _table(chars)[data])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAID = _table("abcdefghijklmnopqrstuvwxyz0123456789")


def said(x: pa.Array) -> pa.Array:
    """Lower case; anything but a to z and digits becomes one blank, none at either end."""
    data, at = _bytes(x)
    data = _LOWER[data]
    letter = _SAID[data]
    behind = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    behind[at[:-1][at[:-1] < at[1:]]] = False
    keep = letter | behind
    place, ends = np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])[at]
    last = place[ends[1:][ends[1:] > ends[:-1]] - 1]
    keep[last[~letter[last]]] = False
    return _texts(x, np.where(letter, data, np.uint8(32)), at, keep)
