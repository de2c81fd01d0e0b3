"""Vectorised hashes of words and word n-grams over whole texts, as numpy arrays of uint64."""

import numpy as np

from .common import mix, slices

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x5DEECE66D))
_SPACE = np.zeros(256, dtype=np.uint8)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
#: Without letter case: A-Z hash as a-z.
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
#: Kinds of bytes: 0 white space, 1 word, 2 ASCII punctuation.
_PLAIN = np.where(_SPACE == 1, 0, 1).astype(np.int8)
_PUNCT = _PLAIN.copy()
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, factor: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        steps = np.full(n, np.uint64(factor))
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def _segments(text: bytes):
    """Parts of a long text, cut at white space."""
    start = 0
    while len(text) - start > 2 * SEGMENT:
        end = start + SEGMENT
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def hashed_runs(joined: bytes, texts: list[bytes], kinds: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, each followed by one byte of kind 0 in joined: hashes, starts and ends of all tokens (runs of one kind other
    than 0), and the number of tokens of each text."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    kind = kinds[raw]
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    token = kind[change] != 0
    starts, ends = change[token], np.append(change[1:], len(raw))[token]
    up, down = _power("up", _BASE, len(raw)), _power("down", _INVERSE, len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if folded else _BYTE)[raw] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0)


def _hashes(texts: list[bytes], kinds: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, counts = hashed_runs(b"\n".join(texts) + b"\n", texts, kinds, folded)
    return hashes, counts


def token_hashes(texts: list[bytes], punct: bool = False, folded: bool = True):
    """For each text, in turn, the hashes of its tokens: words between white space, or with punct also runs of punctuation."""
    kinds = _PUNCT if punct else _PLAIN
    for a, b in slices([len(t) for t in texts], SEGMENT):
        if b == a + 1 and len(texts[a]) > 2 * SEGMENT:
            yield np.concatenate([_hashes([s], kinds, folded)[0] for s in _segments(texts[a])])
            continue
        hashes, counts = _hashes(texts[a:b], kinds, folded)
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, in order; of all words together if there are fewer, but some."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i : len(words) - k + 1 + i]
    return mix(out)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of the values of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
