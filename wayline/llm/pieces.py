"""SentencePiece encoding that keeps offsets, and decoding.

The normaliser reads the model's compiled character map, a double-array trie of byte strings and their replacements: at
each position the longest entry is replaced, else one character is copied, and every normalised byte remembers the
source byte that it came from. Spaces become the model's space sign, and one is put in front as the model says. The
normalised text is cut where no piece of the vocabulary can cross, at spaces and at line ends; what lies between is
merged once and remembered. A piece's normalised bytes then project to its span of source bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bpe import PairTable, merge_all
from wayline.llm.ragged import RaggedCache
from wayline.llm.shared import prepare, released

#: The space sign and the replacement character (fixed values of the format).
SPACE, UNKNOWN_CHARACTER = "▁".encode(), "�".encode()
CACHE_CHUNKS = 200_000
#: Symbols of a chunk above which the library merges it.
LONGEST = 100
_encoders: dict[str, PieceEncoder] = {}


class CharacterMap:
    """The compiled map of a model: the size of the trie in bytes, the trie's units, the replacements, each ended by 0."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self._strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest entry that ``data`` has at ``at``, and the entry's length."""
        units, found = self._units, None
        if not units:
            return None
        node = units[0]
        place = self._offset(node)
        for n, byte in enumerate(data[at:] if at else data, 1):
            place ^= byte
            if place >= len(units):
                break
            node = units[place]
            if node & 0x800000FF != byte:  # the label, with the bit that marks a value
                break
            place ^= self._offset(node)
            if node >> 8 & 1:
                found = (units[place] & 0x7FFFFFFF, n)
        if found is None:
            return None
        start, n = found
        return self._strings[start : self._strings.index(0, start)], n

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def character_at(data: bytes, at: int) -> bytes:
    """The UTF-8 character at this byte; of bytes that are none, one byte."""
    lead = data[at]
    n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
    try:
        data[at : at + n].decode()
    except UnicodeDecodeError:
        return data[at : at + 1]
    return data[at : at + n]


class PieceEncoder:
    """Encodes and decodes with the pieces of a BPE model file of the sentencepiece library."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and leading spaces is needed")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self._plain = not spec.precompiled_charsmap
        self._prefix, self._squeeze, self._escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # The same model without a normaliser of its own, for chunks that are too long to merge here.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self._merger = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self._vocabulary(model.pieces)
        self._chunks = RaggedCache(self._merge, CACHE_CHUNKS)

    def _vocabulary(self, pieces) -> None:
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        #: Bytes of each piece: one for a byte piece, else those of its text.
        self.piece_bytes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in pieces])
        self._byte = np.array([i for _, i in sorted((int(p.piece[3:5], 16), i) for i, p in enumerate(pieces) if p.type == 6)])
        # Symbols are piece ids; a character that is no piece is no symbol of any pair and becomes its bytes.
        order = {piece: r for r, piece in enumerate(sorted(normal, key=lambda x: -pieces[normal[x]].score))}
        pairs = [(normal[p[:k]], normal[p[k:]], order[p], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self._pairs = PairTable(*(np.array(c) for c in zip(*pairs, strict=True)), len(pieces))
        self._single = {p: i for p, i in normal.items() if len(p) == 1}
        longer = [p for p in normal if len(p) > 1]
        if any("▁" in p.lstrip("▁") for p in longer):
            raise ValueError("pieces must have space signs at their beginning only")
        self._line_alone = not any("\n" in p for p in longer)

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and the end, the source byte that it comes from. Both bytes of a
        replacement come from the start of what was replaced."""
        source = text.encode("utf-8", "replace")
        if self._plain and not self._squeeze:
            return self._unmapped(source)
        out, where = bytearray(), []
        begin, last = 0, len(source)
        pieces: list[tuple[bytes, int, int]] = []
        while begin < last:
            if (entry := self.map.longest(source, begin)) is not None:
                pieces.append((entry[0], begin, entry[1]))
            else:
                c = character_at(source, begin)
                pieces.append((c if c[0] < 0x80 or len(c) > 1 else UNKNOWN_CHARACTER, begin, len(c)))
            begin += pieces[-1][2]
        if self._squeeze:
            while pieces and pieces[0][0] in (b" ", b""):
                last_end = pieces[0][1] + pieces[0][2]
                pieces.pop(0)
            start = pieces[0][1] if pieces else (last_end if source else 0)
        else:
            start = 0
        space = SPACE if self._escape else b" "
        if self._prefix and pieces:
            out += space
            where += [start] * len(space)
        spaced = self._squeeze
        for made, at, _ in pieces:
            if self._squeeze and spaced:
                made = made.lstrip(b" ")
            if made:
                new = made.replace(b" ", space)
                out += new
                where += [at] * len(new)
                spaced = made.endswith(b" ")
        end = len(source)
        if self._squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = where[len(out)]
                del where[len(out) :]
        return bytes(out), np.array([*where, end], dtype=np.int64)

    def _unmapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """What ``normalize`` gives where no entry can be found, as the map is empty: all characters at once."""
        if not source:
            return b"", np.zeros(1, dtype=np.int32)
        space, raw = SPACE if self._escape else b" ", np.frombuffer(source, dtype=np.uint8)
        first = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw), dtype=np.int32), np.int32(0)))
        where = np.repeat(first, np.where(raw == 0x20, len(space), 1))
        lead = space if self._prefix else b""
        return lead + source.replace(b" ", space), np.concatenate([np.zeros(len(lead), np.int32), where, np.array([len(source)], np.int32)])

    def _merge(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised chunks."""
        texts = [c.decode() for c in chunks]
        short = [t for t in texts if len(t) <= LONGEST]
        unknown = [c for c in set("".join(short)) if c not in self._single]
        symbol = self._single | {c: -1 - i for i, c in enumerate(unknown)}
        flat = np.fromiter((symbol[c] for t in short for c in t), dtype=np.int64, count=sum(map(len, short)))
        sizes = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
        if unknown and (odd := flat < 0).any():
            # An unknown character merges with nothing, so that the words beside it can be merged on their own.
            word = np.repeat(np.arange(len(short)), sizes)
            parts = np.cumsum(np.concatenate([[0], (odd[1:] | odd[:-1] | (word[1:] != word[:-1])).astype(np.int64)])) if len(flat) else np.empty(0, np.int64)
            part_size = np.bincount(parts)
            part_word = word[np.cumsum(part_size) - part_size]
            part_odd = odd[np.cumsum(part_size) - part_size]
            ids, id_sizes = merge_all(self._pairs, np.where(odd, 0, flat), part_size)
            split = np.split(ids, np.cumsum(id_sizes)[:-1])
            raw = iter([unknown[-1 - s].encode() for s in flat[odd].tolist()])
            made = [self._byte[list(next(raw))] if o else s for o, s in zip(part_odd.tolist(), split, strict=True)]
            lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            flat, sizes = np.concatenate(made), np.bincount(part_word, weights=lengths, minlength=len(short)).astype(np.int64)
        elif len(flat):
            flat, sizes = merge_all(self._pairs, flat, sizes)
        if len(short) == len(texts):
            return flat, sizes
        parts_of = iter(np.split(flat, np.cumsum(sizes)[:-1]) if short else [])
        all_made = [next(parts_of) if len(t) <= LONGEST else np.array(self._merger.encode(t), dtype=np.int64) for t in texts]
        return np.concatenate(all_made), np.fromiter(map(len, all_made), dtype=np.int64, count=len(all_made))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each from the begin id to the end id, one text after the other, and their numbers."""
        return self._encode([self.normalize(t or "")[0] for t in texts])

    def encode_aligned(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and the first source byte and the byte after the last of each id but the begin and end ids."""
        made = [self.normalize(t or "") for t in texts]
        flat, sizes = self._encode([data for data, _ in made])
        if not len(sizes):
            return flat, sizes, np.empty(0, np.int64), np.empty(0, np.int64)
        where = np.concatenate([w for _, w in made])
        edge = np.zeros(len(flat), dtype=bool)
        edge[np.cumsum(sizes) - 1] = edge[np.cumsum(sizes) - sizes] = True
        size = self.piece_bytes[flat[~edge]]
        end = np.cumsum(size) + np.repeat(np.arange(len(sizes)), sizes - 2)  # each text has one place more than bytes
        return flat, sizes, where[end - size], where[end]

    def _encode(self, normalized: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self._chunks.begin()
        chunks = [self._chunks_of(data) for data in normalized]
        rows = self._chunks.rows([c for own in chunks for c in own])
        size = np.concatenate([[0], np.cumsum(self._chunks.sizes(rows))])
        ends = np.cumsum(np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
        ids = self._chunks.gather(rows)
        per = np.diff(size[np.concatenate([[0], ends])])
        stop = np.cumsum(per)
        ids = np.insert(ids, np.stack([stop - per, stop], axis=1).ravel(), np.tile([self.begin, self.end], len(per)))
        return ids.astype("<u4"), per + 2

    def _chunks_of(self, data: bytes) -> list[bytes]:
        return (_LINES if self._line_alone else _WORDS).findall(data)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first source byte, byte after the last) of every piece between the begin and end ids."""
        ids = self.encode([text])[0][1:-1].astype(np.int64)
        _, where = self.normalize(text or "")
        end = np.cumsum(self.piece_bytes[ids])
        return list(zip(ids.tolist(), where[end - self.piece_bytes[ids]].tolist(), where[end].tolist(), strict=True))

    def forget(self) -> None:
        """Empties the memory of chunks: a worker lives on after a task, for tasks of other kinds."""
        self._chunks.reset()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: Chunks of normalised text: space signs and what follows up to the next; with lines, line ends on their own.
_WORDS = re.compile(rb"(?:\xe2\x96\x81)*(?:(?!\xe2\x96\x81)[\x00-\xff])+|(?:\xe2\x96\x81)+")
_LINES = re.compile(rb"(?:\xe2\x96\x81)*(?:[^\xe2\n]|\xe2(?!\x96\x81))+|(?:\xe2\x96\x81)+|\n+")


def encoder_of(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _encode(path: str, keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                flat, sizes, begin, end = encoder.encode_aligned(texts) if keep else (*encoder.encode(texts), None, None)
                own = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
                decoded = [encoder.decode(ids.tolist()) for ids in own]
                columns = [part.column(0), pa.array(sizes), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    inner = np.concatenate([x[1:-1] for x in own]) if own else np.empty(0)
                    spans = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (inner, begin, end)], fields=[pa.field(n, pa.int32()) for n in ("id", "begin", "end")])
                    digests = [hashlib.sha256(x.tobytes()) for x in np.split(np.stack([begin, end], axis=1).astype("<u4"), np.cumsum(sizes - 2)[:-1])] if own else []
                    columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes - 2)]), pa.int32()), spans), pa.array(decoded, pa.string()), pa.array([d.hexdigest() for d in digests], pa.string())]
                    names += ["pieces", "decoded", "spans_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ``pieces``,
    an array of (id, begin, end) with each piece's source bytes, ``decoded``, the text that the ids decode to, and
    ``spans_sha256``, the digest of all (begin, end) as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives the begin and end ids only. A very long text is encoded whole; it is cut only
    where no piece can cross. Null ids and repeated rows are encoded like others; an empty table gives an empty result;
    other columns are ignored.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", pieces array<struct<id:int,begin:int,end:int>>, decoded string, spans_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(_encode(model_path, keep)), schema)
