"""Growing store of encoded text segments and vectorised gathers over it."""

from __future__ import annotations

import numpy as np


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Flat indices of the concatenated ranges [starts[i], starts[i] + lens[i])."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def list_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], empty ranges give 0."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[offsets[1:]] - c[offsets[:-1]]


class SegmentStore:
    """Maps a segment to its ids; kept per worker process and emptied when it
    holds ``max_segments`` segments or ``max_chars`` characters, so beside what
    one call asks for its memory is bounded whatever the corpus."""

    def __init__(self, encode_many, max_segments: int = 500_000, max_chars: int = 8_000_000):
        self.encode_many, self.max_segments, self.max_chars = encode_many, max_segments, max_chars
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars = 0
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def lookup(self, segments: list[str]) -> np.ndarray:
        """Code of every segment, encoding those not seen yet."""
        codes = self.codes
        fresh = [s for s in dict.fromkeys(segments) if s not in codes]
        if codes and (len(codes) + len(fresh) > self.max_segments or self.chars + sum(map(len, fresh)) > self.max_chars):
            self._clear()
            codes = self.codes
            fresh = list(dict.fromkeys(segments))
        if fresh:
            self.chars += sum(map(len, fresh))
            flat, lens = self.encode_many(fresh)
            base = len(codes)
            codes.update(zip(fresh, range(base, base + len(fresh))))
            starts = len(self.flat) + np.concatenate(([0], np.cumsum(lens)[:-1]))
            self.starts = np.concatenate((self.starts, starts))
            self.lens = np.concatenate((self.lens, lens))
            self.flat = np.concatenate((self.flat, flat))
        return np.fromiter(map(codes.__getitem__, segments), np.int64, len(segments))

    def encode(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents given as segment lists: (flat ids, offsets)."""
        codes = self.lookup([s for d in docs for s in d])
        lens = self.lens[codes]
        flat = self.flat[spans(self.starts[codes], lens)]
        edges = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.int64)))
        return flat, np.concatenate(([0], np.cumsum(list_sums(lens, edges))))
