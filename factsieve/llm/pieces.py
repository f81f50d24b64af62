"""Ids of the pieces of many texts: each distinct piece of a chunk is coded once, and recent pieces are remembered.

Texts, pieces and ids stay in flat arrays, so neither a piece nor a list of ids is a Python object.  Pieces are compared by their bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of the pieces remembered by a worker: their number, and the bytes of pieces and ids.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20

MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks, all but the apostrophe, which may begin a word
_MARK = np.isin(np.arange(0x110000), [ord(c) for c in MARKS])


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_then_marks(pieces: pa.Array, blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the pieces, their bounds, which are letters and then marks (none perhaps), and the byte behind their letters.

    With ``blank`` a blank may stand before the letters.
    """
    data, bounds = flat(pieces)
    data, low = data[bounds[0]:bounds[-1]], bounds - bounds[0]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, low)  # bounds in code points
    first = at[:-1] + ((points[at[:-1]] == 0x20) & (np.diff(at) > 1)) if blank else at[:-1]
    stop = np.maximum.reduceat(np.where(_MARK[points], -1, np.arange(len(points))), at[:-1]) + 1  # behind the last that is no mark
    letters = np.concatenate([[0], np.cumsum(_letters()[points])])
    simple = (stop > first) & (letters[np.maximum(stop, first)] - letters[first] == stop - first)
    return data, low, simple, np.append(lead, len(data))[stop]


def ragged(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of the pool one after the other."""
    ends = np.cumsum(lengths)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows bounds[i] to bounds[i + 1] of the values, as their bytes."""
    values = np.ascontiguousarray(values)
    places = np.ascontiguousarray(bounds, np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(places), pa.py_buffer(values)])


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a large binary column without nulls."""
    _, places, data = values.buffers()
    bounds = np.frombuffer(places, np.int64)[values.offset:values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


class Memo:
    """Ids of recent pieces; ``code`` gives the ids of new ones as one array and their numbers."""

    def __init__(self, code: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> None:
        self.code = code
        self._set(pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _set(self, pieces: pa.Array, pool: np.ndarray, lengths: np.ndarray) -> None:
        self.pieces, self.pool, self.lengths = pieces, pool, lengths
        self.starts = np.cumsum(lengths) - lengths

    def _forget(self) -> None:
        """Keeps the younger half when a bound is passed."""
        if len(self.pieces) > REMEMBERED or self.pieces.nbytes + self.pool.nbytes > REMEMBERED_BYTES:
            half = len(self.pieces) // 2
            kept = pa.concat_arrays([self.pieces.slice(half), pa.array([], pa.large_binary())])
            self._set(kept, self.pool[self.starts[half]:] if half < len(self.starts) else self.pool[:0], self.lengths[half:])

    def ids(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and where the ids of pieces bounds[i] to bounds[i + 1] begin and end."""
        coded = pieces.dictionary_encode()
        distinct, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self._forget()
        place = pc.fill_null(pc.index_in(distinct, value_set=self.pieces), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = distinct.take(pa.array(new))
            place = place.copy()
            place[new] = len(self.pieces) + np.arange(len(new))
            pool, lengths = self.code(fresh)
            self._set(pa.concat_arrays([self.pieces, fresh]), np.concatenate([self.pool, pool]), np.concatenate([self.lengths, lengths]))
        used = place[number]
        lengths = self.lengths[used]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ragged(self.pool, self.starts[used], lengths), ends[bounds]
