"""Token ids of whole texts by way of their distinct pieces: each piece between separators is encoded once."""

from collections.abc import Callable, Iterator

import numpy as np

from .common import slices
from .words import SEGMENT, hashed_runs

BLOCK = 16 << 20
#: Pieces that a worker remembers; about 50 bytes each. Beyond that it starts anew: frequent ones are soon learned again.
REMEMBERED = 800_000
_FIRST = np.uint64(0xA5A5A5A55A5A5A5B)


class PieceTable:
    """encode(pieces, first) gives the ids of new pieces and how many each has; first tells pieces that begin a text.

    Pieces are found and hashed in numpy; Python handles a piece only when it is new. Texts longer than a segment are read in
    segments that end at separators."""

    def __init__(self, encode: Callable[[list[bytes], list[bool]], tuple[np.ndarray, np.ndarray]], separators: bytes, folded: bool, mark_first: bool):
        self.encode, self.folded, self.mark_first = encode, folded, mark_first
        self.kinds = np.ones(256, np.int8)
        self.kinds[list(separators)] = 0
        self.cut, self.join = separators, separators[:1]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.n = np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.uint32)

    def _segments(self, text: bytes) -> Iterator[bytes]:
        start = 0
        while len(text) - start > 2 * SEGMENT:
            end = start + SEGMENT
            while end < len(text) and text[end] not in self.cut:
                end += 1
            yield text[start:end]
            start = end
        yield text[start:]

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], first: list[bool]) -> None:
        if self.n + len(pieces) > REMEMBERED and self.n:
            raise OverflowError  # a block's own pieces are always held
        ids, counts = self.encode(pieces, first)
        end = self.starts[self.n] + np.cumsum(counts)
        while self.n + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(ids) and end[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.starts[self.n] : self.starts[self.n] + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(pieces)] = end
        by = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[by])
        self.keys = np.insert(self.keys, at, hashes[by])
        self.slots = np.insert(self.slots, at, self.n + by)
        self.n += len(pieces)

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        segments = [(i, s, k == 0) for i, t in enumerate(texts) for k, s in enumerate(self._segments(t))]
        parts, fresh, names, first = [], [], [], []
        have: set[int] = set()
        for a, b in slices([len(s) for _, s, _ in segments], SEGMENT):
            own = [s for _, s, _ in segments[a:b]]
            joined = self.join.join(own) + self.join
            hashes, starts, ends, counts = hashed_runs(joined, own, self.kinds, self.folded)
            begins = np.cumsum([len(s) + 1 for s in own]) - [len(s) + 1 for s in own]
            opening = np.isin(starts, begins[[f for _, _, f in segments[a:b]]]) if self.mark_first else np.zeros(len(starts), bool)
            hashes = np.where(opening, hashes ^ _FIRST, hashes)
            distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
            for h, i in zip(distinct[new].tolist(), at[new].tolist()):
                if h not in have:
                    have.add(h)
                    fresh.append(h)
                    names.append(joined[starts[i] : ends[i]])
                    first.append(bool(opening[i]))
            parts.append((segments[a:b], distinct, back.astype(np.int32), counts))
        if fresh:
            self._learn(np.array(fresh, np.uint64), names, first)
        open_, held = 0, []
        for own, distinct, back, counts in parts:
            slot = self.slots[np.searchsorted(self.keys, distinct)][back] if len(distinct) else np.zeros(0, np.int64)
            begin, n = self.starts[slot], self.starts[slot + 1] - self.starts[slot]
            ends = np.cumsum(n)
            ids = self.flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1])] if len(n) else np.zeros(0, np.uint32)
            bounds = np.append(0, ends)[np.cumsum(counts)]
            for (i, _, _), x, y in zip(own, np.append(0, bounds[:-1]), bounds):
                if i != open_:
                    yield np.concatenate(held)
                    open_, held = i, []
                held.append(ids[x:y])
        yield np.concatenate(held)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for a, b in slices([len(t) for t in texts], BLOCK):
            try:
                done = list(self._block(texts[a:b]))
            except OverflowError:
                self._forget()
                done = list(self._block(texts[a:b]))
            yield from done
