"""Words, their symbols under recompression, and the anchors by which equal windows find each other."""

from __future__ import annotations

import numpy as np

from ._phrases import _grown, _inverse_powers, _powers
from ._shingles import mix

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(2**64 - 1)
#: Values of bytes in the two independent names of a word, and what their powers are of.
VALUES = tuple(mix(np.arange(256, dtype=np.uint64), seed) for seed in (11, 12))
BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def words_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of texts that lie one after the other begins and ends, and how many words each text has."""
    inside = ~SEPARATOR[data]
    full = sizes > 0
    open_ = inside.copy()
    open_[1:] &= ~inside[:-1]
    first = starts[full]
    open_[first] = inside[first]  # a word never goes on in the next text
    shut = inside.copy()
    shut[:-1] &= ~inside[1:]
    last = (starts + sizes)[full] - 1
    shut[last] = inside[last]
    begin, end = np.flatnonzero(open_), np.flatnonzero(shut) + 1
    return begin, end, np.searchsorted(begin, starts + sizes) - np.searchsorted(begin, starts)


def names_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit name of each word, the same wherever the word stands; ``which`` of two independent ones."""
    length = end - begin
    if not len(length):
        return np.zeros(0, np.uint64)
    offsets = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(offsets, length)
    powers = _grown(f"word{which}", BASES[which], int(length.max()))
    with np.errstate(over="ignore"):
        terms = VALUES[which][data[place + np.repeat(begin, length)]] * powers[place]
        return mix(np.add.reduceat(terms, offsets) + length.astype(np.uint64) * ODD, 21 + which)


class Sums:
    """Hashes of any stretches of a sequence of names."""

    def __init__(self, names: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(names) + 1, np.uint64)
            np.cumsum(names * _powers(len(names)), out=self.sums[1:])
        self.inverse = _inverse_powers(len(names) + 1)

    def of(self, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.inverse[a], seed)


def rounds_for(window: int) -> tuple[int, int]:
    """How many rounds of recompression leave boundaries that a third of a window on either side determines, and how many words do."""
    rounds, reach, longest = 0, 0, 1
    while 3 * (reach + 2 * longest) <= window:
        rounds, reach, longest = rounds + 1, reach + 2 * longest, 2 * longest
    return rounds, reach


def boundaries(names: np.ndarray, edge: np.ndarray, rounds: int) -> np.ndarray:
    """The first word of every symbol after some rounds; ``edge`` marks the words that begin a text.

    A round names runs of equal symbols, then pairs: of neighbours of which
    the left one's name has an even mark and the right one's an odd one, so
    that no two pairs overlap.  Names and marks are functions of the words
    named, hence the same in every task: equal texts get equal symbols but
    for their ends.  A symbol that has grown longer than the round's limit
    (1, 2, 4, ... words) rests.  So a boundary depends, in the first round,
    on a word on either side for runs and two for pairs, and later on as many
    more as the symbols beside it may have: 2, 6, 14, ... words.
    """
    first, name, limit = np.arange(len(names)), names, 1
    for k in range(rounds):
        for pairs in (False, True):
            if len(first) < 2:
                return first
            live = np.diff(first, append=len(names)) <= limit
            joined = live[1:] & live[:-1] & ~edge[first[1:]]
            if pairs:
                odd = (mix(name, 40 + k) & np.uint64(1)).astype(bool)
                joined &= odd[1:] & ~odd[:-1]
            else:
                joined &= name[1:] == name[:-1]
            keep = np.concatenate([[True], ~joined])
            at = np.flatnonzero(keep)
            many = np.diff(at, append=len(first))
            new = name[at]
            with np.errstate(over="ignore"):
                if pairs:
                    two = many > 1
                    new[two] = mix(new[two] * ODD + name[at[two] + 1], 60 + k)
                else:
                    new = np.where(many > 1, mix(new + many.astype(np.uint64) * ODD, 80 + k), new)
            first, name = first[at], new
        limit *= 2
    return first


def window_phrases(names: np.ndarray, other: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts of ``counts`` words each: consecutive windows that have one anchor.

    A window's anchor is, of the boundaries so far inside that the window
    determines them, the one whose surroundings (the words that determine
    it) hash least, the leftmost of equals; so equal windows have equal
    anchors at equal places.  Windows without a boundary inside, which long
    runs have, are phrases of their own.  Returns owner (index of the text),
    first (its first window, from the text's first word), n (its windows),
    key (hash of the anchor's surroundings) and ident (independent hash of
    the phrase's words and of where the anchor is).
    """
    none = np.zeros(0, np.int64)
    total = int(counts.sum())
    many = np.maximum(counts - window + 1, 0)
    if not many.any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rounds, reach = rounds_for(window)
    starts = np.cumsum(counts) - counts
    edge = np.zeros(total, bool)
    edge[starts[counts > 0]] = True
    text = np.repeat(np.arange(len(counts)), counts)
    sums, more = Sums(names), Sums(other)
    at = boundaries(names, edge, rounds)
    at = at[(at - starts[text[at]] >= reach) & (at + reach <= (starts + counts)[text[at]])]
    least = np.full(total, NONE)
    least[at] = sums.of(at - reach, at + reach, 31)
    width, place, size = window - 2 * reach + 1, np.zeros(total, np.uint8), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:]
        left = least[: len(right)]
        move = right < left
        place = np.where(move, place[step:] + np.uint8(step), place[: len(right)])
        least = np.where(move, right, left)
        size += step
    # windows that lie in one text
    owner = np.repeat(np.arange(len(counts)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    p = within + starts[owner]
    at = p + reach if reach else np.zeros(len(p), np.int64)  # windows of under six words determine no boundary
    key = least[at] if reach else np.full(len(p), NONE)
    bare = key == NONE
    anchor = np.where(bare, -1 - p, at + place[at])
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(begin, append=len(p))
    first, owner, anchor, key, bare = p[begin], owner[begin], anchor[begin], key[begin], bare[begin]
    key = np.where(bare, sums.of(first, first + window, 32), key)
    with np.errstate(over="ignore"):
        where = np.where(bare, 0, anchor - first).astype(np.uint64)
        ident = mix(more.of(first, first + n + window - 1, 33) ^ mix(where * ODD + n.astype(np.uint64), 34))
    return owner, within[begin], n, key, ident
