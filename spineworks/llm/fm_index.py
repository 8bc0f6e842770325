"""FM-index over a block of delimited words: all words at one edit from a query whose end matches exactly.

A bounded helper for one task. Words are matched from their last letter to
their first. The caller reverses words to search from the front, so a pair of
blocks (words, reversed words) serves both directions of a search scheme.
"""

from __future__ import annotations

import numpy as np

#: Cells of the query matrix searched at once.
QUERY_CELLS = 1 << 19


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, word ends)."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), ends


def suffix_ranks(symbols: np.ndarray, words: int) -> np.ndarray:
    """Suffix array by prefix doubling; the i-th delimiter (symbol 0) sorts as the i-th smallest symbol."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + words - 1
    rank[symbols == 0] = np.arange(words)
    step = 1
    while True:
        key = rank * (n + words + 256)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if new.max() == n - 1:
            return order
        rank, step = new, step * 2


class Block:
    """Index of distinct words (given in code-point order)."""

    def __init__(self, words: list[str]):
        self.words = words
        codes, ends = _codes(words)
        self.alphabet = np.unique(codes)
        text = np.zeros(len(codes) + len(words), np.int32)
        at = np.ones(len(text), bool)
        at[ends + np.arange(len(words))] = False
        text[at] = np.searchsorted(self.alphabet, codes) + 1
        order = suffix_ranks(text, len(words))
        last = text[order - 1]  # the symbol before each suffix; that of the first word is the last delimiter
        sigma = len(self.alphabet) + 1
        # seen[i, c]: occurrences of symbol c before suffix rank i
        self.seen = np.zeros((len(text) + 1, sigma), np.int32)
        self.seen[np.arange(1, len(text) + 1), last] = 1
        np.cumsum(self.seen, axis=0, out=self.seen)
        counts = self.seen[-1]
        self.start = np.cumsum(counts) - counts

    def _matrix(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols from the last letter to the first, -1 where the block lacks the letter; lengths)."""
        codes, ends = _codes(queries)
        sizes = np.diff(ends, prepend=0)
        found = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[found] == codes, found + 1, -1)
        rows = np.repeat(np.arange(len(queries)), sizes)
        out = np.full((len(queries), int(sizes.max())), -1, np.int32)
        out[rows, ends[rows] - 1 - np.arange(len(codes))] = symbols
        return out, sizes

    def one_edit(self, queries: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) at one edit, the query's last ``exact[i]`` letters matching exactly."""
        exact = np.asarray(exact, np.int64)
        sizes = np.array([len(q) for q in queries])
        order = np.argsort(sizes, kind="stable")
        found = []
        while len(order):
            # a short longest word lets many queries into one matrix
            fit = np.arange(1, len(order) + 1) * sizes[order] <= QUERY_CELLS
            n = max(1, int(fit.sum()))
            part, order = order[:n], order[n:]
            q, w = self._search([queries[i] for i in part], exact[part])
            found.append((part[q], w))
        q, w = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(q * len(self.words) + w)
        return pairs // len(self.words), pairs % len(self.words)

    def _search(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols, sizes = self._matrix(queries)
        seen, start = self.seen, self.start
        # intervals without an error, then those with one: (query, low rank, high rank)
        q = np.arange(len(queries))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.words), np.int64)
        eq, elo, ehi = (np.zeros(0, np.int64) for _ in range(3))
        found_q, found_w, crowd = [], [], 1_000

        def step(q, lo, hi, t):
            c = symbols[q, t]
            low, high = start[c] + seen[lo, c], start[c] + seen[hi, c]
            ok = (c > 0) & (low < high)
            return q[ok], low[ok].astype(np.int64), high[ok].astype(np.int64)

        for t in range(symbols.shape[1] + 1):
            later = []
            b = np.flatnonzero((t >= exact[q]) & (t <= sizes[q]))
            if len(b):
                low, high = start + seen[lo[b]], start + seen[hi[b]]
                s, c = np.nonzero(low[:, 1:] < high[:, 1:])
                c += 1
                bq, more = q[b][s], t < sizes[q[b][s]]
                near = (bq, low[s, c].astype(np.int64), high[s, c].astype(np.int64))
                # one letter more in the word: the same letters of the query are still to come
                eq, elo, ehi = (np.concatenate(x) for x in zip((eq, elo, ehi), near))
                other = more & (c != symbols[bq, np.minimum(t, symbols.shape[1] - 1)])
                later.append(tuple(x[other] for x in near))  # another letter
                here = b[t < sizes[q[b]]]
                later.append((q[here], lo[here], hi[here]))  # one letter less
            done = sizes[eq] == t
            first, end = seen[elo[done], 0], seen[ehi[done], 0]
            whole = first < end
            found_q.append(eq[done][whole])
            found_w.append(first[whole].astype(np.int64))
            if t == symbols.shape[1]:
                break
            on = ~done
            later.append(step(eq[on], elo[on], ehi[on], t))
            eq, elo, ehi = (np.concatenate(x) for x in zip(*later))
            if len(eq) > crowd:  # edits at different places of a run of one letter give the same interval
                eq, elo, ehi = np.unique(np.stack([eq, elo, ehi]), axis=1)
                crowd = 2 * len(eq) + 1_000
            go = t < sizes[q]
            q, lo, hi = step(q[go], lo[go], hi[go], t)
        return np.concatenate(found_q), np.concatenate(found_w)
