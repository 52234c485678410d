"""Words and word shingles of many texts at once, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text.

    A-Z is lower-cased; words end at the six ASCII white space characters.  A null text
    has no words.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = words.index("") if "" in words else -1
    keep = codes != empty
    row = np.repeat(np.arange(len(counts)), counts)
    return hashes[codes[keep]] if len(words) else np.empty(0, np.uint64), np.bincount(row[keep], minlength=len(counts)).astype(np.int64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, one after the other, and their numbers.

    A text with fewer words than ``width`` has its whole sequence as its one shingle, a
    text without words none.
    """
    words, counts = word_hashes(texts)
    n = len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(n), made)
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + starts[row]
    length = np.minimum(counts, width)[row]
    value = mix(length.astype(np.uint64) + np.uint64(1))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        value = np.where(length > k, mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]), value)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.bincount(row[fresh], minlength=n).astype(np.int64)
