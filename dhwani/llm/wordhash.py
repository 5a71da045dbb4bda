"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D`` (bytes above 0x7F are never blanks, so this is
the same on code points); A-Z count as a-z. A word's hash is a polynomial over random 64-bit byte
values, taken from one prefix sum for a whole chunk, then mixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at a time.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: dict[str, np.ndarray] = {}
#: Odd multipliers of the five places of a shingle.
_PLACE = (np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) << U(1)) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        for key, base in (("p", BASE), ("i", _BASE_INV)):
            a = np.full(max(n, 1 << 16), base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def byte_hashes(data: np.ndarray, member: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of every run of bytes in ``member``, then hashes of their first bytes.

    The last byte must not be a member.
    """
    edge = np.flatnonzero(np.diff(member[data].view(np.int8), prepend=0))
    start, end = edge[0::2], edge[1::2]
    p, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    first = [mix((total[np.minimum(end, start + k)] - total[start]) * inv[start] + U(k)) for k in prefixes]
    return h, start, end, *first


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Text indices and texts in runs of about ``PIECE`` bytes; a longer text is cut at blanks, its words stay whole."""
    which, run, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text) or not start:
            cut = _BLANKS.search(text, start + PIECE) if len(text) - start > PIECE else None
            stop = cut.start() if cut else len(text)
            which.append(i)
            run.append(text[start:stop] if start or cut else text)
            size += stop - start
            start = max(stop, 1)
            if size >= PIECE:
                yield which, run
                which, run, size = [], [], 0
    if run:
        yield which, run


def words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray | list[np.ndarray], np.ndarray]:
    """(hash of every word in order, its length in bytes, number of words of every text).

    With ``prefixes``, the hashes of the words' first so many bytes take the lengths' place. Hashing takes
    many times the bytes it looks at, so it goes piece by piece.
    """
    hashes, sizes, firsts, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [[np.empty(0, np.uint64)] for _ in prefixes], np.zeros(len(texts), np.int64)
    for which, run in _pieces(texts):
        data = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
        h, start, end, *first = byte_hashes(data, ~_BLANK, prefixes)
        stop = np.cumsum(np.fromiter((len(t) + 1 for t in run), np.int64, len(run)))
        np.add.at(n, which, np.diff(np.searchsorted(start, stop), prepend=0))
        hashes.append(h)
        sizes.append(end - start)
        for held, x in zip(firsts, first, strict=True):
            held.append(x)
    return np.concatenate(hashes), [np.concatenate(x) for x in firsts] if prefixes else np.concatenate(sizes), n


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending within it: (text index, hash).

    A text of fewer than ``width`` words has its whole sequence as one shingle, one without words none.
    """
    h, _, n = words(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    parts = []
    if len(h) >= width:
        ok = owner[: len(h) - width + 1] == owner[width - 1 :]
        s = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            s += h[k : len(h) - width + 1 + k] * _PLACE[k]
        parts.append((owner[: len(s)][ok], mix(s[ok])))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = (np.cumsum(n) - n)[short]
        s = n[short].astype(np.uint64) * _PLACE[63]
        for k in range(width - 1):
            have = n[short] > k
            s[have] += h[first[have] + k] * _PLACE[k]
        parts.append((short, mix(s)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    d = np.concatenate([a for a, _ in parts])
    s = np.concatenate([b for _, b in parts])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[new], s[new]
