"""Prefix-free parsing of byte strings by rolling-hash triggers."""

from __future__ import annotations

import numpy as np

#: Bytes that a trigger hashes.
TRIGGER = 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of the ``length`` bytes from each position on, modulo 2**64."""
    with np.errstate(over="ignore"):
        power, part, size = ODD, data.astype(np.uint64) + np.uint64(1), 1
        found, done, shift = None, 0, length
        while True:
            if shift & 1:
                if found is None:
                    found, done = part, size
                else:  # the bytes already hashed come first
                    n = len(part) - done
                    scale = np.uint64(pow(int(ODD), size, 1 << 64))
                    found, done = found[:n] * scale + part[done:], done + size
            shift >>= 1
            if not shift:
                return found[: len(data) - length + 1]
            part = part[: len(part) - size] * power + part[size:]
            size *= 2
            power = np.uint64(pow(int(ODD), size, 1 << 64))


def phrases(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts that lie one after the other in ``data``.

    A window's trigger is the place in it whose rolling hash is least (the
    leftmost of equals).  Equal windows have equal triggers, so each window
    belongs to one trigger, whose windows are consecutive: they and what they
    reach over make its phrase.  Returns owner (index of the text), first
    (the first window of the phrase, from the text's start), n (its windows),
    key (hash of the trigger) and ident (hash of the whole phrase).
    """
    sizes = np.asarray(sizes, np.int64)
    starts = np.asarray(starts, np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < window or not (sizes >= window).any():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = _mix(rolling(data, TRIGGER))
    width = window - TRIGGER + 1
    least, place, size = hashes, np.zeros(len(hashes), np.uint8), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:]
        left = least[: len(right)]
        move = right < left
        place = np.where(move, place[step:] + np.uint8(step), place[: len(right)])
        least = np.where(move, right, left)
        size += step
    # windows that lie in one text
    many = np.maximum(sizes - window + 1, 0)
    ends = np.cumsum(many)
    owner = np.repeat(np.arange(len(sizes)), many)
    within = np.arange(int(ends[-1])) - np.repeat(ends - many, many)
    at = within + starts[owner]
    trigger = at + place[at]
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    n = np.diff([*begin.tolist(), len(at)])
    owner, first, key = owner[begin], within[begin], hashes[trigger[begin]]
    # the phrase reaches from its first window to the end of its last: a prefix hash of the trigger-sized pieces on both sides tells it
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data)), out=sums[1:])
        a = starts[owner] + first
        b = a + n + window - 1
        ident = (sums[b] - sums[a]) * _inverse_powers(len(data))[a]
        ident = _mix(ident ^ _mix(key + (trigger[begin] - a).astype(np.uint64) * ODD + n.astype(np.uint64)))
    return owner, first, n, key, ident


_table: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    held = _table.get(name)
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = np.cumprod(np.full(max(n, 1 << 18), base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
        _table[name] = held
    return held[:n]


BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> np.ndarray:
    return _grown("up", BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", pow(BASE, -1, 1 << 64), n)
