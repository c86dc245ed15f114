"""Vectorised hashing of words over whole batches of texts.

A batch of texts is laid out as one byte buffer.  Words are maximal runs of
bytes of one class, and each gets a 64-bit hash from one cumulative sum over
the buffer (a polynomial in an odd base, so a prefix can be divided out again
modulo 2**64).  No Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
#: Bytes that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 18

#: Fixed by the contract: words are separated by space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The uint64 hash of each buf[start:end]; equal bytes get equal hashes."""
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], member.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, count, buffer, starts): texts in groups of about `most` bytes, each followed by a newline."""
    first, parts, total, at = 0, [], 0, 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass") + b"\n"
        if parts and total + len(raw) > most:
            yield first, len(parts), *_joined(parts)
            first, parts, total = at, [], 0
        parts.append(raw)
        total += len(raw)
        at += 1
    if parts:
        yield first, len(parts), *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def words(texts: Iterable[str | None], lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes, bounds): bounds[i]:bounds[i+1] are the words of text first+i, in order."""
    for first, _, buf, at in chunks(texts):
        starts, ends = runs(~SPACE[buf])
        hashes = hash_runs(LOWER[buf] if lower else buf, starts, ends)
        yield first, hashes, np.searchsorted(starts, at)


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles (the whole sequence if shorter, none without words)."""
    for _, hashes, bounds in words(texts):
        grams = np.zeros(len(hashes), np.uint64)
        if len(hashes) >= width:
            rolled = np.zeros(len(hashes) - width + 1, np.uint64)
            for k in range(width):
                rolled = rolled * np.uint64(_BASE) + hashes[k : len(hashes) - width + 1 + k]
            grams[: len(rolled)] = mix64(rolled)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s >= width:
                own = np.sort(grams[s : e - width + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif e > s:
                whole = e - s
                for h in hashes[s:e].tolist():
                    whole = (whole * _BASE + h) & _MASK
                yield mix64(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
