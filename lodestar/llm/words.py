"""Words of many texts at once, as hashes in arrays: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text in one block, about.
BLOCK = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        one = np.ones(1, np.uint64)
        _powers[size] = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, _INVERSE))
    return _powers[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about BLOCK bytes that end where a word can't go on: a long text needs no long tables."""
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data) and not (ends := np.flatnonzero(~_WORD[data[to - 1 : to - 1 + BLOCK]])).size:
            to = min(len(data), to + BLOCK)
        to = min(len(data), to + int(ends[0])) if to < len(data) else to
        yield at, to
        at = to


def _hashes(data: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a part."""
    word = _WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.r_[0, edge]
    if word[-1]:
        edge = np.r_[edge, len(data)]
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(data) + 1)
    sums = np.cumsum(np.where(word, data, 0).astype(np.uint64) * power[: len(data)])
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    return mixed((sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64)), starts + offset


def _lines(data: np.ndarray) -> np.ndarray:
    """The numbers of each byte's paragraph and line."""
    ends = data == 0
    breaks = np.flatnonzero((data == 10) | ends)
    ink = np.cumsum(~np.isin(data, (9, 10, 11, 12, 13, 32)))
    blank = breaks[1:][ink[breaks[1:]] - ends[breaks[1:]] == ink[breaks[:-1]]]
    ends[blank] = True
    return np.stack([np.cumsum(ends), np.cumsum((data == 10) | (data == 0))])


def blocks(texts: list[str | None], paragraphs: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(hash, text number, paragraph and line numbers or empty, first text, end) for the words of a few texts at a time.

    Words are runs of letters and digits of the lower-cased text; every byte beyond ASCII counts as a letter.
    Paragraphs end at blank lines: single newlines only wrap them.
    """
    at = 0
    while at < len(texts):
        parts: list[bytes] = []
        size, to = 0, at
        while to < len(texts) and (to == at or size < BLOCK):
            parts.append((texts[to] or "").lower().encode("utf-8", "replace"))
            size += len(parts[-1])
            to += 1
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        found = [_hashes(data[x:y], x) for x, y in _cuts(data)]
        hashes, starts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, side="right") + at
        yield hashes, of, _lines(data)[:, starts] if paragraphs else np.zeros((2, 0), np.int64), at, to
        at = to


def grams(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of n words each, and where they start; none crosses texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * BASE + hashes[j : j + m]
    at = np.flatnonzero(of[:m] == of[n - 1 :])
    return mixed(h[at]), at
