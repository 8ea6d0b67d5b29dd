"""Word shingles as 64-bit hashes, and the PartEnum signatures of a shingle set.

Numpy kernels that run inside Spark tasks. Words are those of the near-duplicate contract: A-Z lower-cased, everything
between ASCII white space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Entries after which a table of word hashes is started anew; it only saves work, results do not depend on it.
MEMO_WORDS = 200_000
#: Tags fit in 8 bits and sizes in 31: the last tag's band ends far beyond any text.
MOST_TAGS = 96


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Bytes that are between ASCII white space, with A-Z lower-cased; [] for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words in text order; the whole sequence as one where it is shorter."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, np.uint64(width))
    for k in range(width):
        total = total * GOLDEN + hashes[k : k + count]
    return mix(total)


def shingle_set(text: str | None, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = words_of(text)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(windows(hashes, width))


def band_of(size: int, percent: int) -> int:
    """Number of the size band: band b ends at ``band_end(b)``. A set can only reach the required similarity with sets
    of its own band and of the two next to it."""
    band, end = 0, 1
    while end < size:
        band, end = band + 1, next_end(end, percent)
    return band


def next_end(end: int, percent: int) -> int:
    return max(end + 1, (end * 100) // percent)


def band_end(band: int, percent: int) -> int:
    end = 1
    for _ in range(band):
        end = next_end(end, percent)
    return end


def distance_bound(end: int, percent: int) -> int:
    """Largest symmetric difference of two sets of at most ``end`` elements whose Jaccard similarity is percent / 100."""
    return (2 * end * (100 - percent)) // (100 + percent)


#: Bands that end at most here have two levels of partitions; in larger ones a range holds enough elements by itself.
TWO_LEVELS = 256


@dataclass(frozen=True)
class Layout:
    """How a band's sets are signed: ``first`` partitions of ``second`` ranges each, ``total`` signatures in all."""

    first: int
    second: int
    total: int


def layout_of(end: int, percent: int) -> Layout:
    """Partitions for sets of at most ``end`` elements that differ in at most :func:`distance_bound` ones.

    With two levels, there are so many first-level partitions that one of them has at most one difference. It is cut in
    three ranges, and every two of the three are one signature: whichever range the difference is in, the other two agree.
    With one level, there are more partitions than differences, and each is a signature.
    """
    bound = distance_bound(end, percent)
    if end <= TWO_LEVELS:
        return Layout(bound // 2 + 1, 3, 3 * (bound // 2 + 1))
    return Layout(bound + 1 + bound // 8, 1, bound + 1 + bound // 8)


def least_agreeing(layout: Layout, differences: int) -> int:
    """Signatures that agree at least, empty ones included, where so many elements differ. A difference costs two of a
    partition's three signatures at first, the next one in the same partition the third; or one signature, with one
    level."""
    n = layout.first
    if layout.second == 1:
        return n - differences
    return 3 * n - 2 * differences if differences <= n else 2 * n - differences


def signatures(elements: np.ndarray, tag: int, percent: int) -> np.ndarray:
    """The set's signatures under one size tag, as rows of (signature, info).

    info holds the size of the set, the tag, and the number of signatures that span empty ranges only, which are left
    out.

    ``elements`` is sorted, so cutting the 64-bit domain in equal ranges makes every range a run. If all signatures in
    which two similar sets agree are empty, both have so few others that they are told by their number alone; such sets
    give each of their elements as a signature as well, of which similar ones share most. No pair is lost either way.
    """
    end = band_end(tag, percent)
    layout = layout_of(end, percent)
    ranges = layout.first * layout.second
    place = ((elements >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    sums = np.add.reduceat(mix(elements), starts)
    salt = np.uint64((tag * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
    filled = place[starts]
    if layout.second == 1:
        own = mix(sums * GOLDEN + filled + salt)
    else:
        held = np.zeros(ranges, np.uint64)
        held[filled.astype(np.int64)] = mix(sums + salt)  # 0 is what an empty range has
        held = held.reshape(-1, 3)
        pairs = np.stack((held[:, 0] * GOLDEN + held[:, 1], held[:, 0] * GOLDEN + held[:, 2], held[:, 1] * GOLDEN + held[:, 2]), axis=1)
        some = np.stack((held[:, 0] | held[:, 1], held[:, 0] | held[:, 2], held[:, 1] | held[:, 2]), axis=1) != 0
        own = mix(pairs + np.arange(layout.total, dtype=np.uint64).reshape(-1, 3) + salt)[some]
    info = (len(elements) << 32) | (tag << 24) | (layout.total - len(own))
    if len(own) <= layout.total - least_agreeing(layout, distance_bound(end, percent)):
        own = np.concatenate((own, mix(mix(elements + salt) + GOLDEN)))
    return _with_info(own, info)


def _with_info(own: np.ndarray, info: int) -> np.ndarray:
    # 48 bits: a chance agreement of two of them is one more candidate at worst, which the counts and the comparison
    # of the sets turn down.
    return np.column_stack(((own >> np.uint64(16)).view(np.int64), np.full(len(own), info, np.int64)))


def all_signatures(elements: np.ndarray, percent: int) -> list[np.ndarray]:
    """Signatures of a set under its own band's tag and the next one; two sets of neighbouring bands share a tag."""
    band = band_of(len(elements), percent)
    return [signatures(elements, band + k, percent) for k in (0, 1)]


def pack_signatures(parts: list[np.ndarray]) -> bytes:
    """Per tag: info and number as 8 bytes each, then 6 bytes a signature."""
    return b"".join(
        np.array([part[0, 1], len(part)], np.int64).tobytes()
        + np.ascontiguousarray(part[:, 0]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        for part in parts
    )


def unpack_signatures(packed: bytes) -> np.ndarray:
    """Rows of (signature, info)."""
    parts, at = [], 0
    while at < len(packed):
        info, count = np.frombuffer(packed, np.int64, 2, at)
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :6] = np.frombuffer(packed, np.uint8, count * 6, at + 16).reshape(-1, 6)
        parts.append(np.column_stack((wide.view(np.int64).ravel(), np.full(count, info))))
        at += 16 + int(count) * 6
    return np.concatenate(parts)
