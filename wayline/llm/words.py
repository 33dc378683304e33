"""Word splitting and 64-bit hashing shared by the text operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never uses those bytes inside a
multi-byte character, so splitting the encoded text is exact, and ``bytes.split()`` splits at just these bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that one worker remembers the hash of before it starts afresh; bounds the worker's memory only.
CACHE_WORDS = 400_000

_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xBF58476D1CE4E5B9)
_MIX_C = np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As :func:`words_of`, with A-Z (and nothing else) lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """A uint64 hash of each word, the same in every process."""
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_B
    x = (x ^ (x >> np.uint64(27))) * _MIX_C
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A uint64 hash of each run of k consecutive word hashes, in order; empty when there are fewer than k."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _MIX_A
        out += hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow array of texts, one text after the other, and the number of words of each.
    The same hashes as :func:`hash_words` gives; each distinct word of the batch is hashed once."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = pc.dictionary_encode(lists.flatten())
    distinct = words.dictionary.cast(pa.binary()).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    index = words.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if b"" in distinct:  # what stands before a leading and after a trailing space
        real = index != distinct.index(b"")
        index, of = index[real], of[real]
    return known[index], np.bincount(of, minlength=len(texts))
