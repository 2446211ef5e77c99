"""Word shingles as 64-bit integers."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

#: Entries that a worker's memo of words may hold before it is emptied.
MEMO = 150_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_memo = _Memo()


def forget() -> None:
    """Empty this worker's memo: workers outlive their tasks, and other operators need the memory."""
    global _memo
    _memo = _Memo()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them, another one for every seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of each text, one text after the other, and how many each has.

    Letters A-Z are lower-cased and words end at space and tab to carriage
    return.  Shingles are ``k`` words in a row; a text with fewer words has
    one shingle of them all, a text without words none.
    """
    global _memo
    if len(_memo) > MEMO:
        _memo = _Memo()
    words = [t.encode().lower().split() for t in texts]  # bytes.split() knows exactly these characters
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    codes = np.fromiter(map(_memo.__getitem__, chain.from_iterable(words)), np.uint64, n)
    starts = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        whole = max(n - k + 1, 0)
        grams = np.zeros(whole, np.uint64)
        for j in range(k):
            grams += codes[j : j + whole] * FACTORS[j % len(FACTORS)]
        inside = np.ones(whole, bool)
        for j in range(1, k):  # a window must not reach into the next text
            border = starts[1:] - j
            inside[border[(border >= 0) & (border < whole)]] = False
        grams = mix(grams[inside], k)
        short = np.flatnonzero((sizes > 0) & (sizes < k))
        if not len(short):
            return grams, np.maximum(sizes - k + 1, 0)
        counts = np.maximum(sizes - k + 1, 0)
        extra = np.array([int((codes[starts[d] : starts[d] + sizes[d]] * FACTORS[: sizes[d]]).sum(dtype=np.uint64)) for d in short], np.uint64)
        extra = mix(extra + sizes[short].astype(np.uint64), k + 1)
    return np.insert(grams, (np.cumsum(counts) - counts)[short], extra), np.where((sizes > 0) & (sizes < k), 1, counts)


def shingle_sets(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other, and how many each has."""
    grams, n = shingles(texts, k)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[(ends - n)[n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return grams[new], kept[ends] - kept[ends - n]
