"""Token ids of whole texts with a public tokenizer, each distinct piece encoded once for a long time.

Neither of the two vocabularies lets a token cross the pieces used here
(white-space separated words; for the byte-level vocabulary with the space
before them), so the ids of a text are those of its pieces, one after
another. Texts where that could fail (special-token strings, exotic white
space) go to the library whole.

Pieces are found, hashed and looked up by numpy over a slice of texts; only
pieces that the worker has not met go to the library, many in one call. Two
64-bit hashes tell pieces apart. Pieces of more than ``LONG`` bytes are
encoded each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .common import text_slices, word_spans

#: Encoded pieces kept by one Python worker (about 30 bytes each); the cache starts anew when full.
CACHE_PIECES = 1_500_000
#: Pieces encoded in one call, and bytes of the longest piece that is kept.
CALL_PIECES, LONG = 512, 64

_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)"
                        rb"|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: The parts of an ASCII piece that the word vocabulary encodes one by one.
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LEFT = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_encoders: dict[str, "Encoder"] = {}


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the pieces ``\\ ?\\S+|\\s+(?=\\s\\S)|\\s+`` of all rows; they cover every byte."""
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= space[1:] != space[:-1]
    begin = np.flatnonzero(new)  # runs of white space and of other bytes in turn
    end = np.append(begin[1:], n)
    blank = space[begin]
    mark = np.zeros(n, bool)
    mark[begin] = True
    run = np.flatnonzero(blank & ~edge[end])  # white space before a word
    last = end[run] - 1
    joins = data[last] == 0x20
    mark[end[run]] &= ~joins  # the word takes the space before it
    mark[last] = True
    begin = np.flatnonzero(mark)
    return begin, np.append(begin[1:], n)


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece."""
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    one, two = size.astype(np.uint64), ~size.astype(np.uint64)
    for at in range(0, int(size.max(initial=0)), 8):
        on = np.flatnonzero(size > at) if at else slice(None)
        x = words[begin[on] + at] & _LEFT[np.minimum(size[on] - at, 8)]
        a, b = (one[on] ^ x) * np.uint64(0x9E3779B97F4A7C15), (two[on] ^ x) * np.uint64(0xC2B2AE3D27D4EB4F)
        one[on], two[on] = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(29))
    return one * np.uint64(0xD6E8FEB86659FD93), two


class _Cache:
    """Ids by piece hash, in a few sorted runs of growing size."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def __len__(self) -> int:
        return sum(len(r[0]) for r in self.runs)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool or -1, number of ids)."""
        place, count = np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64)
        for k1, k2, p, c in self.runs:
            at = np.minimum(np.searchsorted(k1, one), len(k1) - 1)
            hit = (k1[at] == one) & (k2[at] == two)
            place[hit], count[hit] = p[at[hit]], c[at[hit]]
        return place, count

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint16)])
        self.pool[self.used:self.used + len(ids)] = ids
        order = np.argsort(one)
        place = (self.used + np.cumsum(count) - count).astype(np.int32)
        new = [x[order] for x in (one, two, place, count.astype(np.uint8))]  # a kept piece has 64 ids at most
        self.used += len(ids)
        while self.runs and len(self.runs[-1][0]) < 2 * len(new[0]):
            new = [np.concatenate(x) for x in zip(self.runs.pop(), new)]
            order = np.argsort(new[0], kind="stable")
            new = [x[order] for x in new]
        self.runs.append(tuple(new))


class Encoder:
    """uint16 token ids of texts given as bytes; one instance for each vocabulary and worker."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        self.cache_pieces = cache_pieces
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        if size > 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        # the byte-level vocabulary keeps white space, the word vocabulary drops it and lower-cases
        self.spaces = bool(self.library.encode(" ", add_special_tokens=False).ids)
        self.mark = "<|endoftext|>"
        self.mark_id = self.library.token_to_id(self.mark)
        tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        # bytes of a token, or whether it ends a part
        self.step = np.array([len(t) if self.spaces else t.endswith("</w>") for t in tokens], np.int64)
        self.cache = _Cache()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of each piece's ids) by call, with a special token between pieces."""
        calls = [pieces[i:i + CALL_PIECES] for i in range(0, len(pieces), CALL_PIECES)]
        for ids in self._ids([self.mark.join([p.decode("utf-8", "replace") for p in c]) for c in calls]):
            border = ids == self.mark_id
            yield ids[~border], np.diff(np.flatnonzero(border), prepend=-1, append=len(ids)) - 1

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the pieces, ids of all pieces in that order, number of each)."""
        if self.spaces:
            easy = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == 0x20 and not _SPACE[p[1]]]
        else:
            easy = [i for i, p in enumerate(pieces) if p.isascii()]
        rest = sorted(set(range(len(pieces))).difference(easy)) if len(easy) < len(pieces) else []
        order, flat, counts = [], [], []
        calls = [easy[i:i + CALL_PIECES] for i in range(0, len(easy), CALL_PIECES)]
        joined = [(b"" if self.spaces else b" ").join([pieces[i] for i in c]).decode("utf-8", "replace") for c in calls]
        for call, ids in zip(calls, self._ids(joined) if calls else ()):
            # a piece ends where its bytes, or its parts, are complete
            steps = [len(pieces[i]) if self.spaces else len(_PARTS.findall(pieces[i])) for i in call]
            ends, reached = np.cumsum(steps), np.cumsum(self.step[ids])
            cut = np.searchsorted(reached, ends) + 1
            if len(ids) and reached[-1] == ends[-1] and np.array_equal(reached[cut - 1], ends):
                order += call
                flat.append(ids)
                counts.append(np.diff(cut, prepend=0))
            else:
                rest += call
        for ids, n in self._marked([pieces[i] for i in rest]):
            flat.append(ids)
            counts.append(n)
        none = [np.zeros(0, np.int64)]
        return np.array(order + rest, np.int64), np.concatenate(flat or none), np.concatenate(counts or none)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row) of texts without special cases."""
        if self.spaces:
            begin, end = spaced_pieces(data, offsets)
        else:
            begin, end, _ = word_spans(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        raw, size = data.tobytes(), end - begin
        if len(self.cache) > self.cache_pieces:
            self.cache = _Cache()
        long = np.flatnonzero(size > LONG)
        short = np.flatnonzero(size <= LONG)
        one, two = _hashes(data, begin[short], size[short])
        _, first, same = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two[first][same], two):  # two pieces with one hash: tell them apart by both
            _, first, same = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
        place, count = self.cache.find(one[first], two[first])
        new = np.flatnonzero(place < 0)
        if len(new):
            at = short[first[new]]
            order, ids, n = self._learn([raw[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist())])
            new = new[order]
            place[new], count[new] = self.cache.used + np.cumsum(n) - n, n
            self.cache.add(one[first[new]], two[first[new]], ids, n)
        places, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        places[short], counts[short] = place[same], count[same]
        pool = self.cache.pool[:self.cache.used]
        if len(long):
            order, ids, n = self._learn([raw[i:j] for i, j in zip(begin[long].tolist(), end[long].tolist())])
            long = long[order]
            places[long], counts[long] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(places - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(begin, offsets)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian uint16 ids of each text."""
        if not self.spaces:
            texts = [t.lower() for t in texts]  # bytes: A-Z only, the library lower-cases the rest
        everything = b"\n".join(texts)
        if b"<|" in everything or self.spaces and _ODD_LEAD[np.frombuffer(everything, np.uint8)].any():
            whole = [b"<|" in t or self.spaces and _ODD_SPACE.search(t) is not None for t in texts]
        else:
            whole = [False] * len(texts)
        plain = [t for t, w in zip(texts, whole) if not w]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain], dtype=np.int64)]).astype(np.int64)
        ids, counts = self._pieces(np.frombuffer(b"".join(plain), np.uint8), offsets)
        raw, ends = ids.astype("<u2").tobytes(), np.concatenate([[0], 2 * np.cumsum(counts)]).tolist()
        found = iter([raw[i:j] for i, j in zip(ends, ends[1:])])
        return [self._ids([t.decode("utf-8", "replace")])[0].astype("<u2").tobytes() if w else next(found)
                for t, w in zip(texts, whole)]


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, cache_pieces)
    _encoders[path].cache_pieces = cache_pieces
    return _encoders[path]


def row_texts(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, o = data.tobytes(), offsets.tolist()
    return [raw[i:j] for i, j in zip(o, o[1:])]


def encoded_rows(batches, path: str, end_id: int, cache_pieces: int = CACHE_PIECES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids column, [uint16 ids with the end id]) for each slice of batches (doc_id, text)."""
    enc, end = encoder(path, cache_pieces), np.array([end_id], "<u2").tobytes()
    for batch in batches:
        for rows, data, offsets in text_slices(batch, "text"):
            yield rows.column(0), [ids + end for ids in enc.encode(row_texts(data, offsets))]
