"""Word and shingle hashes of many texts at once, in NumPy.

A word's value is a polynomial of its bytes modulo 2**64, taken from running sums over the whole buffer and
brought to position zero by the inverse power, then mixed together with the length. It depends on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 20
SHINGLE = 5

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True

#: Odd multipliers of the places in a shingle, from a fixed rule.
PLACES = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64) | 1) for k in range(SHINGLE)]

_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            table = np.full(n + 1, base, U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=U)
    return _powers


def pieces(buffer: bytes, limit: int = PIECE, separators: np.ndarray = IS_SEPARATOR) -> Iterator[bytes]:
    """Cut a buffer at word separators into pieces of about `limit` bytes (a longer word stays whole)."""
    start, size = 0, len(buffer)
    while size - start > limit:
        cut = start + limit
        while cut < size:
            near = np.flatnonzero(separators[np.frombuffer(buffer, np.uint8, min(limit, size - cut), cut)])
            if len(near):
                cut += int(near[0])
                break
            cut = min(size, cut + limit)
        yield buffer[start:cut]
        start = cut
    yield buffer[start:]


def _piece_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(buffer, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SEPARATOR[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(U) * U(0xA24BAED4963EE407)), starts


def text_words(buffers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts in order, and each text's first word (plus the end)."""
    hashes, firsts, done = [], [0], 0
    group: list[bytes] = []

    def flush():
        nonlocal done
        if group:
            values, starts = _piece_words(b" ".join(group))
            offsets = np.cumsum([len(b) + 1 for b in group])
            firsts.extend((done + np.searchsorted(starts, offsets)).tolist())
            hashes.append(values)
            done += len(values)
            group.clear()

    size = 0
    for b in buffers:
        if len(b) > PIECE:
            flush()
            size = 0
            for piece in pieces(b):
                values = _piece_words(piece)[0]
                hashes.append(values)
                done += len(values)
            firsts.append(done)
            continue
        group.append(b)
        size += len(b)
        if size > PIECE:
            flush()
            size = 0
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, U), np.array(firsts, np.int64)


def windows(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of the `width` words from every word on (the last width - 1 entries are missing)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = words[:n] * PLACES[0]
        for k in range(1, width):
            total = total + words[k : k + n] * PLACES[k]
    return mix(total, 1)


def shingle_sets(buffers: list[bytes], distinct: bool = True) -> list[np.ndarray]:
    """Per text its five-word shingles as sorted distinct hashes; a shorter text is one shingle, no word none.

    With `distinct` false they come in order of the text, repeats included.
    """
    words, firsts = text_words([b.lower() for b in buffers])
    every = windows(words)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]) if distinct else every[a : b - SHINGLE + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                total = U(0)
                for k in range(b - a):
                    total = total + words[a + k] * PLACES[k]
            out.append(mix(np.array([total], U), 2 + b - a))
        else:
            out.append(np.zeros(0, U))
    return out
