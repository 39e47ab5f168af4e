"""Ids of many strings of which few are distinct: each distinct one is made once a slice, and what occurs again is remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice holds, unless a single text is longer; strings that a worker remembers.
SLICE, REMEMBERED = 12 << 20, 400_000
Ids = tuple[np.ndarray, np.ndarray]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about limit bytes of one string column."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all items of spans, one span after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    out += np.repeat(starts - ends + lengths, lengths)
    return out


class Memo:
    """Ids of strings by make, which takes new strings and gives all their ids and how many each has.

    Strings that occur twice in a slice are remembered, up to REMEMBERED; then memory starts anew.
    """

    def __init__(self, make: Callable[[list[str]], Ids]) -> None:
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, strings: pa.Array) -> Ids:
        """All ids of the strings in order, and how many each has."""
        coded = strings.dictionary_encode()
        names, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        flat, lengths = self.make([names[i] for i in missing.tolist()]) if len(missing) else (self.ids[:0], self.lengths[:0])
        at[missing] = len(self.known) + np.arange(len(missing))
        ids, n = np.concatenate([self.ids, flat]), np.concatenate([self.lengths, lengths])
        first = np.cumsum(n) - n
        own = at[which]
        out = ids[spread(first[own], n[own])], n[own]
        again = np.flatnonzero(np.bincount(which, minlength=len(names))[missing] > 1)
        if len(self.known) + len(again) > REMEMBERED:
            self.forget()
            again = again[:REMEMBERED]
        size = len(self.known)
        self.known.update((names[i], size + k) for k, i in enumerate(missing[again].tolist()))
        starts = np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, flat[spread(starts[again], lengths[again])]])
        self.lengths = np.concatenate([self.lengths, lengths[again]])
        return out
