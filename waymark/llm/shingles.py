"""Word shingles of whole texts as 64-bit numbers, a batch of documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

# A-Z to a-z on UTF-8 bytes; bytes.split() then splits at blank and U+0009 to U+000D alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Known words of a worker; beyond it the worker starts anew.
KEPT_WORDS = 200_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit numbers; other seeds give other orders."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_numbers(text: str | None) -> np.ndarray:
    """A number for each word of the text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if len(WORDS) > KEPT_WORDS:
        WORDS.clear()
    for word in set(words).difference(WORDS):
        WORDS[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, shingles): the size of each text's set, and the sets one after another, each ascending.

    A text with fewer words than a shingle has one shingle, its whole sequence; a text
    without words has none.
    """
    numbers = [word_numbers(t) for t in texts]
    counts = np.array([len(x) for x in numbers], np.int64)
    words = np.concatenate([*numbers, np.zeros(width, np.uint64)])
    begin = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    length = np.repeat(np.minimum(counts, width), n)
    hashed = mixed(length.astype(np.uint64))
    for k in range(width):
        hashed = np.where(k < length, mixed(hashed * ODD[k % len(ODD)] + words[place + k]), hashed)
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    return np.bincount(doc[first], minlength=len(texts)).astype(np.int64), hashed[first]
