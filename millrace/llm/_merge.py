"""Merging byte strings by ranked pairs, with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np

NONE = np.int32(2**31 - 1)


class RankQueue:
    """Pending merge ranks with their positions.

    Each rank has a bucket of positions.  Three levels of 64-bit words mark
    which buckets hold any: a find-first-set at each level leads from the top
    word to the lowest pending rank, however many ranks there are.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Deal positions to the buckets of their ranks, in the order of positions."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        begin = 0
        for end in [*cuts.tolist(), len(ranks)]:
            self.push(int(ranks[begin]), positions[begin:end])
            begin = end

    def pop(self, first: np.ndarray | None = None) -> tuple[int, np.ndarray] | None:
        """The lowest pending rank and its positions from left to right, or None.

        Of ranks that are marked in ``first`` the first positions are enough:
        where the next batch of them lies wholly before the others, the others
        stay in the bucket.
        """
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        held = self.buckets[rank]
        if len(held) > 1 and first is not None and first[rank]:
            held.sort(key=lambda positions: positions[0])
            if held[0][-1] < held[1][0]:
                return rank, held.pop(0)
        del self.buckets[rank]
        self.low[b] &= word - 1
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


#: Positions of a bucket that are looked at together where the order within it matters.
CHUNK = 4096


class MergeTable:
    """Ranked pairs of tokens and the token that each pair makes.

    pairs: maps (left, right) to (rank, token).  Tokens that no pair makes are one symbol long.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        self.pair_ranks = values[order, 0]
        self.ranks = int(values[:, 0].max(initial=0)) + 1
        self.made = np.zeros(self.ranks, np.int32)
        self.made[values[:, 0]] = values[:, 1]
        # merges whose token can be part of a merge of lower rank: after them the order within a bucket matters
        left, right = (self.pair_keys >> 32).astype(np.int64), self.pair_keys & 0xFFFFFFFF
        tokens = int(max(values[:, 1].max(initial=0), left.max(initial=0), right.max(initial=0))) + 1
        lowest = np.full(tokens, NONE, np.int32)
        for part in (left, right):
            np.minimum.at(lowest, part, self.pair_ranks)
        self.early = lowest[self.made] < np.arange(self.ranks)
        self.lengths = np.ones(tokens, np.int64)
        while True:  # parts may have higher ranks than what they make
            sums = np.ones(tokens, np.int64)
            np.maximum.at(sums, self.made[self.pair_ranks], self.lengths[left] + self.lengths[right])
            if (sums == self.lengths).all():
                break
            self.lengths = sums
        # the pairs that each token is part of, as ranges of ``uses``
        parts, ranks = np.concatenate([left, right]), np.concatenate([self.pair_ranks, self.pair_ranks])
        by_part = np.argsort(parts, kind="stable")
        self.uses = ranks[by_part]
        self.first_use = np.searchsorted(parts[by_part], np.arange(tokens + 1))
        self._reach: dict[int, int] = {}

    def reach(self, rank: int) -> int:
        """The length of the longest token that merges of lower ranks can make of the token of ``rank``.

        While no lower rank is pending, every pair that a merge of ``rank``
        brings about holds its token, and so on: what follows from one merge
        is one growing token, which never gets longer than this.
        """
        if rank not in self._reach:
            seen = {int(self.made[rank])}
            todo = list(seen)
            while todo:
                token = todo.pop()
                used = self.uses[self.first_use[token] : self.first_use[token + 1]]
                new = set(self.made[used[used < rank]].tolist()) - seen
                seen |= new
                todo += new
            self._reach[rank] = int(self.lengths[list(seen)].max())
        return self._reach[rank]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge(self, token: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Merge strings of tokens, each on its own: lowest rank first, leftmost first among equals.

        token holds all strings one after the other, sizes their lengths (1 at
        least).  Returns each string's tokens as little-endian 32-bit integers.

        All strings lie in one linked list, with borders between them that no
        pair spans, and one queue serves them: the lowest rank overall is
        lowest in every string that holds it.  Entries whose pair has changed
        since they were queued are stale and skipped.  Where a merge can
        enable one of lower rank, only positions that lie farther apart than
        the tokens of both can grow are merged together, and only the first
        positions of a bucket are looked at, so that the time is in proportion
        to the length of a string.
        """
        if not len(sizes):
            return []
        n = int(sizes.sum())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[np.cumsum(sizes) - 1] = n  # n: no neighbour
        before[np.cumsum(sizes) - sizes] = n
        rank = np.full(n + 1, NONE, np.int32)
        alive = np.ones(n + 1, bool)
        with_next = np.flatnonzero(after < n)
        rank[with_next] = self.pair_rank(token[with_next], token[with_next + 1])
        queue = RankQueue(self.ranks)
        found = np.flatnonzero(rank[:n] != NONE)
        if len(found):
            queue.push_all(rank[found], found)
        while (next_ := queue.pop(self.early)) is not None:
            r, at = next_
            if len(at) > CHUNK and self.early[r]:
                queue.push(r, at[CHUNK:])
                at = at[:CHUNK]
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1 and self.early[r]:
                apart = np.ones(len(at), bool)
                apart[1:] = (np.diff(at) > 2 * self.reach(r)) | (owner[at[1:]] != owner[at[:-1]])
                if 4 * np.count_nonzero(apart) < len(at):
                    changed = self._one_by_one(r, at, token, rank, alive, after, before)
                    if len(changed):
                        queue.push_all(rank[changed], changed)
                    continue
                if not apart.all():
                    queue.push(r, at[~apart])
                    at = at[apart]
            elif len(at) > 1 and (touch := after[at[:-1]] == at[1:]).any():
                # runs such as x x x: of positions in a chain, every second one merges
                run = np.flatnonzero(np.concatenate([[True], ~touch]))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run.tolist(), len(at)]))) % 2 == 0]
            right = after[at]
            beyond = after[right]
            alive[right] = False
            token[at] = self.made[r]
            after[at] = beyond
            linked = beyond < n
            before[beyond[linked]] = at[linked]
            rank[at] = NONE
            left = before[at]
            near = left < n
            near[1:] &= left[1:] != at[:-1]  # a merge whose left neighbour has merged as well: that one is in the list already
            changed = np.concatenate([at[linked], left[near]])
            if len(changed):
                changed.sort()
                fresh = self.pair_rank(token[changed], token[after[changed]])
                rank[changed] = fresh
                live = fresh != NONE
                if live.any():
                    queue.push_all(fresh[live], changed[live])
        kept = np.flatnonzero(alive[:n])
        ids = token[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[kept], minlength=len(sizes)))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))

    def _one_by_one(self, r: int, at: np.ndarray, token, rank, alive, after, before) -> np.ndarray:
        """Merge positions of rank r that lie close together from left to right, each with all merges of lower ranks that follow from it.

        Returns the positions whose pairs are new and still wait, all of rank r or higher.
        """
        n, none = len(token), int(NONE)
        rank_of, made = self.rank_of, self.made
        heap, changed = at.tolist(), set()

        def pair(p: int) -> int:
            q = int(after[p])
            return none if q >= n else rank_of.get(int(token[p]) << 32 | int(token[q]), none)

        while heap:
            p = heapq.heappop(heap)
            if not alive[p] or rank[p] != r:
                continue
            at_rank = r
            while True:  # merge p with its right neighbour, then whatever lower rank that enables
                right = int(after[p])
                beyond = int(after[right])
                alive[right] = False
                token[p] = made[at_rank]
                after[p] = beyond
                if beyond < n:
                    before[beyond] = p
                left = int(before[p])
                own, other = pair(p), pair(left) if left < n else none
                rank[p] = own
                if left < n:
                    rank[left] = other
                if min(own, other) >= r:
                    break
                at_rank = min(own, other)
                if other <= own:  # the leftmost of equals
                    p = left
            for q in (left, p) if left < n else (p,):
                if rank[q] == r:
                    heapq.heappush(heap, q)
                elif rank[q] != none:
                    changed.add(q)
        live = np.array(sorted(changed), np.int64)
        return live[alive[live] & (rank[live] != NONE)]
