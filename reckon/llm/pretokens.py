"""Vectorised splitting of texts into the pieces that BPE merges stay within, and a cache of encoded pieces.

The fast path works on UTF-8 bytes and covers Latin letters, digits, white
space and ASCII signs; a text with any other character or a special token's
mark takes the caller's general path, so results do not depend on the path
taken. Pieces are told apart by their bytes, never by a hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import text_bytes

LETTER, DIGIT, BLANK, SIGN = 1, 2, 3, 4
#: Pieces in each of the two generations that a Python worker keeps (about 20 MB each; workers outlive their tasks, and keep them).
CACHE = 100_000
#: Bytes of text whose pieces are told apart at once.
SLICE = 1 << 20


def _kinds() -> np.ndarray:
    """The kind of each byte; 0xC3 to 0xC9 lead the Latin letters from U+00C0 on, and 0 is beyond the fast path."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = SIGN
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[0x30:0x3A] = DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = LETTER
    out[0x80:0xC0] = out[0xC3:0xCA] = LETTER
    return out


KINDS = _kinds()


def plain(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which texts the fast path covers."""
    odd = kind == 0
    ahead = raw[1:]
    times = (ahead == 0x97) | (ahead == 0xB7)  # after 0xC3 the signs for times and divided by
    odd[:-1] |= ((raw[:-1] == 0xC3) & times) | ((raw[:-1] == ord("<")) & (ahead == ord("|")))
    at = np.flatnonzero(odd)
    clear = np.diff(offsets) > 0
    clear[np.searchsorted(offsets, at, "right") - 1] = False
    return clear


def _clitics(raw: np.ndarray, quote: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the lone apostrophes at ``quote``, those that take 's 't 'm 'd or 're 've 'll along, and how many letters."""
    padded = np.concatenate([raw, np.zeros(3, raw.dtype)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    ends = np.concatenate([edge, np.ones(3, bool)])
    long = ((np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & ~ends[quote + 2]
    take = short | long
    return quote[take], np.where(short, 1, 2)[take]


def pieces(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and the index of each text's first piece, for texts of the fast path.

    ``spaced``: white space is kept, a blank joins the piece after it, and runs
    of digits stay whole. Otherwise white space is dropped and digits stand alone.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    lone = np.zeros(n, bool)
    lone[:-1] = run[:-1] & (raw[:-1] == 39) & (kind[1:] == LETTER) & ~edge[1:n]
    start = run
    if spaced:
        last = np.zeros(n, bool)  # white space right before something else in the same text
        last[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
        joined = np.zeros(n, bool)
        joined[1:] = last[:-1] & (raw[:-1] == 32)
        start |= last
        start &= ~joined
        lone &= ~joined
    else:
        start |= kind == DIGIT
        start &= ~blank
    quote, letters = _clitics(raw, np.flatnonzero(lone), edge)
    if len(quote):
        start[quote + 1] = False
        after = quote + 1 + letters
        after = after[after < n]
        after = after[(kind[after] == LETTER) & ~edge[after]]
        start[after] = True
    starts = np.flatnonzero(start)
    if spaced:
        ends = np.concatenate([starts[1:], [n]])
    else:
        stop = edge[1:].copy()
        stop[:-1] |= start[1:] | blank[1:]
        ends = np.flatnonzero(stop & ~blank) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class PieceCache:
    """Ids of pieces by the pieces' bytes, in two generations: a piece met again outlives one met once.

    ``encode`` gives the ids of new pieces end to end, as unsigned 32-bit integers, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], room: int = CACHE):
        self.encode, self.room = encode, room
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _known(self, keys: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        missing = []
        for at, value in enumerate(found):
            if value is None:
                value = old.get(keys[at])
                if value is None:
                    missing.append(at)
                else:
                    found[at] = young[keys[at]] = value
        if missing:
            ids, many = self.encode([keys[at] for at in missing])
            flat, begin = ids.astype("<u4").tobytes(), 0
            for at, end in zip(missing, (4 * np.cumsum(many)).tolist()):
                found[at] = young[keys[at]] = flat[begin:end]
                begin = end
        if len(young) > self.room:
            self.young, self.old = {}, young
        return found

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each piece has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = ends - starts
        if (starts[1:] != ends[:-1]).any() or starts[0] or ends[-1] != len(raw):
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[starts] = 1
            inside[ends] -= 1
            raw = raw[np.add.accumulate(inside[:-1], dtype=np.int8).astype(bool)]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = held.dictionary_encode()
        values = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        row = coded.indices.to_numpy()
        many = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<u4")
        begin = np.cumsum(many) - many
        size = many[row]
        total = np.cumsum(size)
        return flat[np.repeat(begin[row] - total + size, size) + np.arange(total[-1])], size


def encoded(texts: pa.Array | list, cache: PieceCache, general: Callable[[str], list[int]], spaced: bool, lower: bool) -> list[np.ndarray]:
    """Ids of each text: pieces from the cache where the fast path covers it, else by ``general``."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    out: list = [None] * len(texts)
    shown = pa.array([x and x.lower() for x in texts.to_pylist()], pa.string()) if lower else texts
    raw, offsets = text_bytes(shown)
    kind = KINDS[raw]
    fast = plain(raw, offsets, kind)
    rows = np.flatnonzero(fast)
    if len(rows):
        if len(rows) < len(texts):
            keep = np.repeat(fast, np.diff(offsets))
            raw, kind, offsets = raw[keep], kind[keep], np.concatenate([[0], np.cumsum(np.diff(offsets)[rows])])
        starts, ends, first = pieces(raw, offsets, kind, spaced)
        ids, size = cache.ids(raw, starts, ends)
        total = np.concatenate([[0], np.cumsum(size)])
        for r, a, b in zip(rows.tolist(), total[first[:-1]].tolist(), total[first[1:]].tolist()):
            out[r] = ids[a:b]
    for r in np.flatnonzero(~fast).tolist():
        text = texts[r].as_py()
        out[r] = np.array(general(text) if text else [], np.uint32)
    return out
