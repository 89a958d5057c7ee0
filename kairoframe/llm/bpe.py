"""Byte-pair encoding as a prefix recurrence.

A sequence of tokens is the encoding of its text exactly when each two neighbours are the encoding of their own
concatenation. So the encoding of a prefix ends in the one token that fits both the text and the token before it, and

    last(i) = the token t that ends at i with (last(i - len t), t) compatible;   count(i) = count(i - len t) + 1

gives every prefix's encoding and token count in one pass, without merging and without encoding anything twice. Whether
two tokens are compatible is read off the merges: undo them, highest rank first, along the seam, and look for a merge
across it that would have come earlier.

``Pairs.encode_words`` runs the recurrence over many short words at once in numpy; ``Pairs.prefixes`` runs it over one
string of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

from . import words as W

U64 = np.uint64
_B = U64(0x9E3779B97F4A7C15)
#: A symbol outside the vocabulary; it is a token of its own and fits next to anything.
OUTSIDE = -1
_SLOTS = 1 << 20
#: Longer words take the scalar recurrence.
LONG = 48


class Pairs:
    """Tokens in order of rank: base symbols first, then merged tokens, earliest merge first.

    ``symbols`` maps base symbols to their rank; ``tokens`` gives every token as a tuple of base symbol ranks;
    ``left`` and ``right`` the two tokens that it was merged from (itself, for a base symbol); ``merged`` the rank of
    the token that two neighbours merge to.
    """

    def __init__(self, tokens: Sequence[tuple[int, ...]], left: Sequence[int], right: Sequence[int], merged: dict[tuple[int, int], int]):
        self.left, self.right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.merged = merged
        self.by_symbols = {t: k for k, t in enumerate(tokens)}
        self.lengths = sorted({len(t) for t in tokens}, reverse=True)
        self.size = np.array([len(t) for t in tokens], np.int64)
        keys = np.array([(a << 32) | b for a, b in merged], U64)
        o = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[o], np.fromiter(merged.values(), np.int64, len(merged))[o]
        self.pair_set = W.HashSet(keys)
        self.lookup: dict[int, tuple[W.HashSet, np.ndarray]] = {}
        for n in self.lengths:
            own = [(k, t) for k, t in enumerate(tokens) if len(t) == n]
            h = np.zeros(len(own), U64)
            for j in range(n):
                h = h * _B + np.array([t[j] + 1 for _, t in own], U64)
            h = W.mix(h + U64(n))
            found = W.HashSet(h)
            rank = np.zeros(len(found.keys), np.int64)
            rank[np.searchsorted(found.keys, h)] = [k for k, _ in own]
            self.lookup[n] = (found, rank)
        self._seen = np.full(_SLOTS, 0xFFFFFFFFFFFFFFFF, U64)
        self._fits = np.zeros(_SLOTS, bool)
        self._memo: dict[tuple[int, int], bool] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_seen", "_fits", "_memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._seen = np.full(_SLOTS, 0xFFFFFFFFFFFFFFFF, U64)
        self._fits = np.zeros(_SLOTS, bool)
        self._memo = {}

    # -- compatibility --

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b are the encoding of their concatenation."""
        if a == OUTSIDE or b == OUTSIDE:
            return True
        known = self._memo.get((a, b))
        if known is None:
            if len(self._memo) > 1 << 16:
                self._memo.clear()
            known = self._memo[(a, b)] = bool(self._fits_many(np.array([a]), np.array([b]))[0])
        return known

    def _fits_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = len(a)
        ok, limit = np.zeros(n, bool), np.full(n, 1 << 40)
        at = np.arange(n)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            i, k = self.pair_set.find((a.astype(U64) << U64(32)) | b.astype(U64))
            earlier = np.zeros(len(at), bool)
            earlier[i] = self.pair_ranks[k] < limit[i]
            # undo the later merge of the two; where that token is a base symbol, the other
            first = a > b
            undo_a, undo_b = self.right[a], self.left[b]
            base_a, base_b = undo_a == a, undo_b == b
            done = base_a & base_b & ~earlier
            ok[at[done]] = True
            go_a = (first & ~base_a) | (~first & base_b)
            limit = np.where(go_a, a, b + 1)
            a, b = np.where(go_a, undo_a, a), np.where(go_a, b, undo_b)
            keep = ~earlier & ~done
            at, a, b, limit = at[keep], a[keep], b[keep], limit[keep]
        return ok

    def fits_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs, remembered in a table of fixed size."""
        out = (a == OUTSIDE) | (b == OUTSIDE)
        at = np.flatnonzero(~out)
        if not len(at):
            return out
        key = (a[at].astype(U64) << U64(32)) | b[at].astype(U64)
        slot = (W.mix(key) & U64(_SLOTS - 1)).astype(np.int64)
        hit = self._seen[slot] == key
        out[at[hit]] = self._fits[slot[hit]]
        miss = at[~hit]
        if len(miss):
            fresh, back = np.unique(key[~hit], return_inverse=True)
            good = self._fits_many((fresh >> U64(32)).astype(np.int64), (fresh & U64(0xFFFFFFFF)).astype(np.int64))
            out[miss] = good[back]
            s = (W.mix(fresh) & U64(_SLOTS - 1)).astype(np.int64)
            self._seen[s] = fresh  # of two that share a slot, numpy keeps the last in both tables
            self._fits[s] = good
        return out

    # -- the recurrence --

    def prefixes(self, symbols: Sequence[int]) -> tuple[list[int], list[int]]:
        """For each prefix of a string of symbols its last token and its token count; entry 0 is the empty prefix."""
        last, count = [OUTSIDE], [0]
        symbols = tuple(symbols)
        for i in range(1, len(symbols) + 1):
            if symbols[i - 1] == OUTSIDE:
                last.append(OUTSIDE)
                count.append(count[-1] + 1)
                continue
            for n in self.lengths:
                if n > i:
                    continue
                t = self.by_symbols.get(symbols[i - n : i])
                if t is not None and (i == n or self.fits(last[i - n], t)):
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError("no token ends here")
        return last, count

    def backtrack(self, last: Sequence[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= 1 if last[i] == OUTSIDE else int(self.size[last[i]])
        return out[::-1]

    def encode_words(self, flat: np.ndarray, sizes: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Token count of each word, and all their tokens in order if ``ids``; ``flat`` has the words' symbols."""
        counts = np.zeros(len(sizes), np.int64)
        begin = np.cumsum(sizes) - sizes
        short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
        short = short[np.argsort(-sizes[short], kind="stable")]
        found = []  # word, its tokens
        for a in range(0, len(short), 1 << 13):
            rows = short[a : a + (1 << 13)]
            tokens = self._encode_short(flat, begin[rows], sizes[rows], ids)
            counts[rows] = tokens[0]
            if ids:
                found.append((np.repeat(rows, tokens[0]), tokens[1]))
        for i in np.flatnonzero(sizes > LONG).tolist():
            last, count = self.prefixes(flat[begin[i] : begin[i] + sizes[i]].tolist())
            counts[i] = count[-1]
            if ids:
                found.append((np.full(count[-1], i), np.array(self.backtrack(last), np.int64)))
        if not ids:
            return counts, None
        if not found:
            return counts, np.zeros(0, np.int64)
        o = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
        return counts, np.concatenate([f[1] for f in found])[o]

    def _encode_short(self, flat: np.ndarray, begin: np.ndarray, n_of: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Counts and tokens of words in order of falling size."""
        m, top = len(n_of), int(n_of[0])
        has = np.searchsorted(-n_of, -np.arange(top + 1), side="right")  # words of at least i symbols come first
        sym = np.zeros((top, m), np.int64)
        h = np.zeros((top + 1, m), U64)
        for i in range(top):
            sym[i, : has[i + 1]] = flat[begin[: has[i + 1]] + i]
            h[i + 1] = h[i] * _B + (sym[i] + 1).astype(U64)
        last = np.full((top + 1, m), OUTSIDE, np.int64)
        count = np.zeros((top + 1, m), np.int32)
        power = {n: U64(pow(int(_B), n, 1 << 64)) for n in self.lengths}
        for i in range(1, top + 1):
            todo = np.arange(has[i])
            outside = sym[i - 1, : has[i]] == OUTSIDE
            if outside.any():
                x = todo[outside]
                count[i, x] = count[i - 1, x] + 1
                todo = todo[~outside]
            for n in self.lengths:
                if n > i or not len(todo):
                    continue
                found, rank = self.lookup[n]
                got, k = found.find(W.mix(h[i, todo] - h[i - n, todo] * power[n] + U64(n)))
                if not len(got):
                    continue
                x, t = todo[got], rank[k]
                if n < i:
                    good = self.fits_many(last[i - n, x], t)
                    got, x, t = got[good], x[good], t[good]
                last[i, x] = t
                count[i, x] = count[i - n, x] + 1
                rest = np.ones(len(todo), bool)
                rest[got] = False
                todo = todo[rest]
            if len(todo):
                raise ValueError("no token ends here")
        each = np.arange(m)
        total = count[n_of, each].astype(np.int64)
        if not ids:
            return total, None
        end = np.cumsum(total)
        out = np.zeros(int(end[-1]), np.int64)
        at, place, live = n_of.copy(), end - 1, each
        while len(live):
            t = last[at[live], live]
            out[place[live]] = t
            place[live] -= 1
            at[live] -= np.where(t == OUTSIDE, 1, self.size[t])
            live = live[at[live] > 0]
        return total, out


def from_merges(base: Iterable[str], merges: Iterable[Sequence[str]]) -> tuple[Pairs, dict[str, int], list[str]]:
    """Pairs of a vocabulary with a list of merges; also the base symbols' ranks and every token's text by rank."""
    texts = list(base)
    symbols = {s: i for i, s in enumerate(texts)}
    rank = dict(symbols)
    tokens: list[tuple[int, ...]] = [(i,) for i in range(len(texts))]
    left, right, merged = list(range(len(texts))), list(range(len(texts))), {}
    for a, b in merges:
        k = rank.setdefault(a + b, len(texts))
        if k == len(texts):
            texts.append(a + b)
            tokens.append(tokens[rank[a]] + tokens[rank[b]])
            left.append(rank[a])
            right.append(rank[b])
        merged.setdefault((rank[a], rank[b]), k)
    return Pairs(tokens, left, right, merged), symbols, texts
