"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length l belongs to the reciprocal class j when capacity / (j + 1) < l <= capacity / j; a bin of class j takes
exactly j pieces, so that a worker fills the bins of every class on its own, without knowing the others' pieces. As
documents may be cut, each is first cut into whole sequences and into pieces of 1/2, 1/4, 1/8 and 1/16 of the capacity,
whose bins come out full; only what is left, below 1/16, goes to the inner classes, where a slot is at most an eighth
larger than its piece. Bins that a worker could not fill are joined, cut at the capacity, and their tail at powers of two.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bpe import PairTable, merge_all
from wayline.llm.ragged import RaggedCache
from wayline.llm.shared import prepare, released

CAPACITY = 4096
END_ID = 2
#: Words, and white-space-free chunks of text, whose ids a worker remembers within a task.
CACHE_WORDS = 200_000
#: Texts that are looked up at once.
SLICE = 1000
#: Characters of a chunk above which the library encodes it.
LONGEST = 100
#: Up to here letters lower-case one by one and no two characters compose.
LAST_LATIN = "\u024f"
#: The word pattern of the tokenizer file (a fixed value), and the line feed that separates chunks here.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = [tuple(c.split()) for c in _OUT.split(", ")]
_KINDS = {"long": pa.int64(), "binary": pa.binary()}
_tokenizers: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """Ids of whole texts by a BPE file of the ``tokenizers`` library, remembered by word.

    Right only for tokenizers that lower-case, drop white space and split into letters, single digits and other signs,
    as the one of ``word_bpe_49k.json`` does: then a text's ids are those of its white-space-free chunks, one after the
    other. A chunk of Latin letters is split here and its words merged with the file's own merges, many at a time; any
    other chunk, one that may hold a special token and one with a very long word go through the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self._merges = ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64)
        self._pairs = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2], max(vocab.values()) + 1)
        alphabet = byte_alphabet()
        self._inside = np.array([vocab[c] for c in alphabet])
        self._last = np.array([vocab[c + end] for c in alphabet])
        self._words = RaggedCache(self._merge, CACHE_WORDS)
        self._chunks = RaggedCache(self._split, CACHE_WORDS)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self._inside[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self._last[data[last]]
        return merge_all(self._pairs, symbols, sizes)

    def _split(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(chunks)
        odd = "<|" in joined or max(joined, default="") > LAST_LATIN or max(map(len, chunks)) > LONGEST
        plain = [c for c in chunks if not self._is_odd(c)] if odd else chunks
        found = WORDS.findall("\n".join(plain).lower()) if plain else []
        self._words.begin()
        rows = self._words.rows([w for w in found if w != "\n"])
        size = self._words.sizes(rows)
        of = np.cumsum(np.fromiter((w == "\n" for w in found), dtype=np.int64, count=len(found)))
        of = of[np.fromiter((w != "\n" for w in found), dtype=bool, count=len(found))]
        sizes = np.bincount(of, weights=size, minlength=len(plain)).astype(np.int64)
        flat = self._words.gather(rows)
        if not odd:
            return flat, sizes
        parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if plain else [])
        ids = iter(self._odd_ids([c for c in chunks if self._is_odd(c)]))
        made = [next(ids) if self._is_odd(c) else next(parts) for c in chunks]
        return np.concatenate(made), np.fromiter(map(len, made), dtype=np.int64, count=len(made))

    def _odd_ids(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(self._tokenizer.encode(c, add_special_tokens=False).ids, np.int64) for c in chunks]

    def _is_odd(self, chunk: str) -> bool:
        return "<|" in chunk or len(chunk) > LONGEST or max(chunk, default="") > LAST_LATIN

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, as little-endian unsigned 32-bit integers, and the number of
        ids of each. A null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = pc.dictionary_encode(lists.flatten())
        self._chunks.begin()
        rows = self._chunks.rows(chunks.dictionary.to_pylist())[chunks.indices.to_numpy(zero_copy_only=False)]
        size = np.concatenate([[0], np.cumsum(self._chunks.sizes(rows))])
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return self._chunks.gather(rows).astype("<u4"), np.diff(size[np.concatenate([[0], ends])])

    def forget(self) -> None:
        """Empties the memory of words: a worker lives on after a task, for tasks of other kinds."""
        self._words.reset()
        self._chunks.reset()


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next one from U+0100."""
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def tokenizer_of(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def inner_classes(capacity: int) -> list[int]:
    """Documents per bin of the classes below capacity / 16: about eight to each doubling, up to the capacity."""
    out, j = [], 16
    while j < capacity:
        out.append(j)
        j += max(1, j // 8)
    return [*out, capacity]


def cuts(length: int, capacity: int) -> list[int]:
    """The lengths of the pieces of a document, in order; they add up to ``length``."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    for part in (2, 4, 8, 16):
        size = capacity // part
        if size and rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


class HarmonicPacker:
    """Fills the bins of one worker. ``add`` and ``finish`` give rows in the order of the output's columns."""

    def __init__(self, capacity: int, first_sequence: int) -> None:
        if capacity < 16 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two, 16 or more")
        self.capacity, self.sequence = capacity, first_sequence
        self._inner = np.array(inner_classes(capacity))
        self._open: dict[int, list[tuple]] = {}

    def class_of(self, length: int) -> int:
        """The number of pieces of this length that a bin takes."""
        j = self.capacity // length
        return j if j < 16 or length * j == self.capacity and j & (j - 1) == 0 else int(self._inner[np.searchsorted(self._inner, j, "right") - 1])

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        for length in cuts(len(ids), self.capacity):
            j, piece = self.class_of(length), (doc_id, start, ids[start : start + length].copy(), len(ids))  # a slice would hold the whole document
            start += length
            held = self._open.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                out += self._sequence(self._open.pop(j))
        return out

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, whole in pieces:
            out.append((doc_id, start, len(ids), ids.tobytes(), whole, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        return out

    def finish(self) -> list[tuple]:
        """The bins that did not fill: their pieces one after the other, cut at the capacity, the tail at powers of two."""
        queue = [p for j in sorted(self._open) for p in self._open[j]][::-1]
        left, out = sum(len(p[2]) for p in queue), []
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            taken = []
            while room:
                doc_id, start, ids, whole = queue.pop()
                taken.append((doc_id, start, ids[:room], whole))
                if len(ids) > room:
                    queue.append((doc_id, start + room, ids[room:], whole))
                room -= len(taken[-1][2])
            out += self._sequence(taken)
        self._open = {}
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, ids_crc32.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers, and ``ids_crc32`` is their checksum; a
    sequence's pieces one after the other in order of ``offset`` are its training tokens.

    A document is its text's ids and then ``end_id``; a null text counts as empty, so every row gives at least one
    piece. Rows with a null id are packed under a null id; repeated rows are packed as often as they are there. A
    sequence shorter than the capacity is to be padded to it, unless its length is a power of two. ``sequence_id`` is
    unique over all workers. An empty table gives no pieces; other columns are ignored. Each worker reads its rows as a
    stream and holds at most one open bin of each class.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 40)
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            out: list[tuple] = []
            ids, sizes = tokenizer.encode(part.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, np.array(end_id, dtype="<u4"))
            at = 0
            for doc_id, size in zip(part.column(0).to_pylist(), (sizes + 1).tolist(), strict=True):
                out += packer.add(doc_id, ids[at : at + size])
                at += size
            if out:
                yield _rows(out)
        if out := packer.finish():
            yield _rows(out)
        tokenizer.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), _OUT).withColumn("ids_crc32", F.crc32("ids"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=[name for name, _ in _FIELDS])
