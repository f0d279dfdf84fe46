"""Hashed word shingles of whole texts, in numpy.

Words are runs of bytes other than space and \\t-\\r, with A-Z lower-cased. A text's set holds
its distinct shingles of k words, or its whole sequence as one if it has fewer; a text
without words has the empty set. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20
LONGEST = 4096
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = re.compile(rb"[ \t-\r]")


def grown(base: np.uint64):
    """A table of at least n powers of base, from the first on; kept while it is long enough and of moderate size."""
    kept = [np.empty(0, dtype=np.uint64)]

    def table(n: int) -> np.ndarray:
        if len(kept[0]) >= n:
            return kept[0]
        found = np.multiply.accumulate(np.full(max(n, 1 << 16), base, dtype=np.uint64))
        if n <= 4 * CHUNK:
            kept[0] = found
        return found

    return table


powers, inverses = grown(BASE), grown(INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the bytes, and where it starts."""
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(WHITE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # a word's polynomial is a difference of running sums, brought to the word's start by the inverse power
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses(len(data))[starts]
    for i in np.flatnonzero(ends - starts > LONGEST):
        word = LOWER[data[starts[i] : ends[i]]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def cut_words(raw: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end between words."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        gap = BLANK.search(raw, end)
        end = len(raw) if gap is None else gap.start()
        yield raw[at:end]
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order. Long texts are taken in chunks that end between words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = [hash_words(np.frombuffer(x, dtype=np.uint8))[0] for x in (cut_words(raw) if len(raw) > CHUNK else (raw,))]
    return found[0] if len(found) == 1 else np.concatenate(found)


def many_words(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; short texts are hashed together."""
    group, size = [], 0

    def together() -> Iterator[np.ndarray]:
        hashes, starts = hash_words(np.frombuffer(b" ".join(group), dtype=np.uint8))
        ends = np.cumsum([len(x) + 1 for x in group])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for raw in texts:
        raw = raw or b""
        if group and size + len(raw) > CHUNK // 4:
            yield from together()
            group, size = [], 0
        if len(raw) > CHUNK // 4:
            found = [hash_words(np.frombuffer(x, dtype=np.uint8))[0] for x in cut_words(raw)]
            yield np.concatenate(found)
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        yield from together()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words (one for the whole, if there are fewer)."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(word_hashes(text), k))
