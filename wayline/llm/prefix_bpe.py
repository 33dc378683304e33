"""Byte-pair encoding by dynamic programming over the prefixes of a word, and decoding.

Every prefix of a word, taken by itself, ends with one certain token. A suffix automaton of the whole vocabulary reads
the word once and knows, after each symbol, all tokens that end there, the longest first. A token is the last of the
prefix when it and the last token of what stands before it are compatible, that is, when merging the symbols of the two
gives back these two; of all tokens that end at a place exactly one is. The lengths of the stored tokens are the back-pointers:
followed from the end of the word, they give its ids. All words of a block take each step together, as arrays.

Two tokens are compatible when no merge across their border comes first. On the left stand, in the order in which they
come to be, the tokens that end the left one, on the right those that begin the right one; a pair of these that merges
before either is taken up into the next is the merge that spoils the border.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.bpe import PairTable, merge_all
from wayline.llm.packing import ChunkTokenizer, byte_alphabet
from wayline.llm.shared import prepare, released

#: Symbols: a byte inside a word, and 256 more for the byte that ends it.
SYMBOLS = 512
_NEVER = np.int64(1 << 40)
#: Symbols above which a word takes its steps by itself: arrays of one word only cost time.
LONG = 512
#: Cells of a block of words, and the places of the memory of pairs that were judged.
CELLS, JUDGED = 1 << 18, 1 << 18
#: Texts, and bytes of ids, that a task gives back at once.
SLICE, OUT_BYTES = 500, 4 << 20
_tokenizers: dict[str, PrefixTokenizer] = {}


class SuffixAutomaton:
    """All substrings of a set of tokens, given as sequences of symbols.

    ``advance`` moves from the longest suffix of what was read that the automaton knows to that of one symbol more. A
    token is the longest string of its state; ``first`` has the longest token that ends in a state, and ``shorter`` the
    next one of a state with a token.
    """

    def __init__(self, tokens: list[tuple[int, ...]]) -> None:
        moves: list[dict[int, int]] = [{}]
        link, length, owner = [-1], [0], {}

        def add(last: int, symbol: int) -> int:
            known = moves[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                return known
            state = -1
            if known is None:
                state = len(moves)
                moves.append({})
                length.append(length[last] + 1)
                link.append(0)
                while last >= 0 and symbol not in moves[last]:
                    moves[last][symbol] = state
                    last = link[last]
                if last < 0:
                    return state
                known = moves[last][symbol]
                if length[known] == length[last] + 1:
                    link[state] = known
                    return state
            half = len(moves)  # the shorter strings of ``known`` now end in more places than the longer ones
            moves.append(dict(moves[known]))
            length.append(length[last] + 1)
            link.append(link[known])
            while last >= 0 and moves[last].get(symbol) == known:
                moves[last][symbol] = half
                last = link[last]
            link[known] = half
            if state < 0:
                return half
            link[state] = half
            return state

        # Shorter prefixes first, each once: the tokens as a tree.
        level: dict[tuple[int, ...], int] = {(): 0}
        by_size: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            by_size.setdefault(len(token), []).append(i)
        for depth in range(1, max(by_size, default=0) + 1):
            below: dict[tuple[int, ...], int] = {}
            for size, some in by_size.items():
                if size < depth:
                    continue
                for i in some:
                    prefix = tokens[i][:depth]
                    if prefix not in below:
                        below[prefix] = add(level[prefix[:-1]], prefix[-1])
                    if size == depth:
                        owner[below[prefix]] = i
            level = below
        self._build(moves, link, length, owner)

    def _build(self, moves: list[dict[int, int]], link: list[int], length: list[int], owner: dict[int, int]) -> None:
        keys = np.fromiter((state * SYMBOLS + symbol for state, own in enumerate(moves) for symbol in own), np.int64)
        to = np.fromiter((state for own in moves for state in own.values()), np.int32, len(keys))
        order = np.argsort(keys)
        self._keys, self._to = keys[order], to[order]
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.token = np.full(len(link), -1, np.int32)
        self.token[list(owner)] = list(owner.values())
        self.shorter = np.full(len(link), -1, np.int32)
        for state in np.argsort(self.length, kind="stable")[1:].tolist():
            above = link[state]
            self.shorter[state] = above if self.token[above] >= 0 else self.shorter[above]

    def advance(self, state: np.ndarray, matched: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, matched = state.copy(), matched.copy()
        left = np.arange(len(state))
        while len(left):
            key = state[left].astype(np.int64) * SYMBOLS + symbol[left]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = self._keys[at] == key
            state[left[found]] = self._to[at[found]]
            matched[left[found]] += 1
            left = left[~found]
            lost = state[left] == 0  # no token holds the symbol
            matched[left[lost]] = 0
            left = left[~lost]
            state[left] = self.link[state[left]]
            matched[left] = self.length[state[left]]
        return state, matched

    @cached_property
    def moves(self) -> dict[int, int]:
        """The transitions once more, for single look-ups."""
        return dict(zip(self._keys.tolist(), self._to.tolist(), strict=True))

    def first(self, state: np.ndarray, matched: np.ndarray) -> np.ndarray:
        whole = (self.token[state] >= 0) & (matched == self.length[state])
        return np.where(whole, state, self.shorter[state])


class Compatibility:
    """Whether two tokens stay as they are when their symbols are merged as one word."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, tokens: int, pairs: PairTable) -> None:
        self._pairs, self._tokens = pairs, tokens
        self._rank_of = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        # The rank at which a token is made of its parts; they are made before it.
        rank = np.full(tokens, -1, np.int64)
        rank[merged] = np.arange(len(merged))
        if (rank[left] >= rank[merged]).any() or (rank[right] >= rank[merged]).any() or len(np.unique(merged)) < len(merged):
            raise ValueError("a token must be merged in one way, and after its parts")
        first, last = np.full(tokens, -1), np.full(tokens, -1)
        first[merged], last[merged] = left, right
        self._ends, self._end_at = self._spine(last, rank)
        self._begins, self._begin_at = self._spine(first, rank)
        self._key, self._answer = np.full(JUDGED, -1, np.int64), np.zeros(JUDGED, bool)

    @staticmethod
    def _spine(part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (token, rank at which it is taken up into the next one) from a token's outermost symbol up to itself, and
        where the rows of each token begin."""
        rows, starts = [], []
        for token in range(len(part)):
            starts.append(len(rows))
            chain = [token]
            while part[chain[-1]] >= 0:
                chain.append(int(part[chain[-1]]))
            chain.reverse()
            rows += [(t, rank[up]) for t, up in zip(chain, chain[1:], strict=False)] + [(token, _NEVER)]
        return np.array(rows, np.int64), np.array(starts)

    def one(self, left: int, right: int) -> bool:
        """The same for a single pair."""
        i, j, never = int(self._end_at[left]), int(self._begin_at[right]), int(_NEVER)
        while True:
            (a, up_a), (b, up_b) = self._ends[i].tolist(), self._begins[j].tolist()
            merge = self._rank_of.get((a, b), never)
            if merge < up_a and merge <= up_b:
                return False
            if up_a == up_b == never:
                return True
            i, j = (i + 1, j) if up_a <= up_b else (i, j + 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self._tokens + right
        place = (key * 0x9E3779B1 >> 7) & (JUDGED - 1)
        out, new = self._answer[place], np.flatnonzero(self._key[place] != key)
        if len(new):
            out[new] = self._judge(left[new], right[new])
            self._key[place[new]] = key[new]
            # Of several keys of one place the last stays, with its own answer.
            self._answer[place[new]] = out[new]
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        i, j = self._end_at[left], self._begin_at[right]
        good, open_ = np.ones(len(left), bool), np.arange(len(left))
        while len(open_):
            (a, up_a), (b, up_b) = self._ends[i[open_]].T, self._begins[j[open_]].T
            merge = self._pairs.rank(a, b)
            # Of equal merges the one further left comes first.
            spoiled = (merge < up_a) & (merge <= up_b) & (merge < _NEVER)
            good[open_[spoiled]] = False
            more = ~spoiled & ((up_a < _NEVER) | (up_b < _NEVER))
            step = up_a <= up_b
            i[open_[more & step]] += 1
            j[open_[more & ~step]] += 1
            open_ = open_[more]
        return good


class PrefixTokenizer(ChunkTokenizer):
    """Ids of whole texts by a BPE file, every word by dynamic programming.

    Texts are cut into white-space-free chunks as in :class:`ChunkTokenizer`. Chunks outside of the Latin letters are
    normalised and split into words by the library; its model encodes none.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        names = self._tokenizer.get_vocab(with_added_tokens=True)
        self.strings = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.strings[i] = name
        left, right, merged = self._merges.T
        count = len(self.strings)
        symbols: list[tuple[int, ...]] = [()] * count
        for at, (inside, last) in enumerate(zip(self._inside.tolist(), self._last.tolist(), strict=True)):
            symbols[inside], symbols[last] = (at,), (256 + at,)
        for a, b, c in self._merges.tolist():
            symbols[c] = symbols[a] + symbols[b]
        ids = [i for i, s in enumerate(symbols) if s]
        flat = np.concatenate([self._inside, self._last])[np.concatenate([symbols[i] for i in ids])]
        _, sizes = merge_all(self._pairs, flat, np.array([len(symbols[i]) for i in ids]))
        ids = [i for i, n in zip(ids, sizes.tolist(), strict=True) if n == 1]  # no merge ends in any other
        self._automaton = SuffixAutomaton([symbols[i] for i in ids])
        self._ids = np.array(ids)
        self._compatible = Compatibility(left, right, merged, count, self._pairs)
        self._byte = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
        added = self._tokenizer.get_added_tokens_decoder()
        self._special = {t.content: i for i, t in added.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))) + ")") if added else None

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        symbols[np.cumsum(sizes) - 1] += 256
        return self.encode_words(symbols, sizes)

    def encode_words(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of one symbol or more, given one after the other, and the number of ids of each."""
        start = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        counts = np.empty(len(sizes), np.int64)
        parts, lo = [], 0
        while lo < len(order):
            # As many words as have their cells in a block; the widest comes last.
            hi = min(len(order), lo + (1 if sizes[order[lo]] > LONG else max(1, CELLS // int(sizes[order[lo]]))))
            while hi > lo + 1 and ((hi - lo) * int(sizes[order[hi - 1]]) > 2 * CELLS or sizes[order[hi - 1]] > LONG):
                hi = lo + (hi - lo + 1) // 2
            words = order[lo:hi]
            ids, n = self._block(symbols, start[words], sizes[words])
            counts[words] = n
            parts.append((words, ids))
            lo = hi
        out_start, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int64)
        for words, ids in parts:
            row, column = np.nonzero(ids >= 0)
            # Back-pointers run from the end: a word's first column is its last id.
            out[out_start[words][row] + counts[words][row] - 1 - column] = ids[row, column]
        return out, counts

    def _block(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words sorted by size: their ids from the last to the first, -1 behind, and the number of ids of each."""
        auto, n, width = self._automaton, len(size), int(size[-1])
        if n == 1 and width > LONG:
            ids = self._long(symbols[start[0] : start[0] + width].tolist())
            return np.array([ids]), np.array([len(ids)])
        last = np.zeros((n, width + 1), np.int32)  # the state of the last token of each prefix
        state, matched = np.zeros(n, np.int32), np.zeros(n, np.int32)
        begins = np.searchsorted(size, np.arange(1, width + 1))
        for k in range(1, width + 1):
            here = int(begins[k - 1])  # the words that are as long
            state[here:], matched[here:] = auto.advance(state[here:], matched[here:], symbols[start[here:] + k - 1])
            node = auto.first(state[here:], matched[here:])
            rows = np.arange(here, n)
            while len(rows):
                if (node < 0).any():
                    raise ValueError("no token of the vocabulary ends a prefix")
                before = k - auto.length[node]
                good = before == 0
                ask = np.flatnonzero(~good)
                good[ask] = self._compatible(self._ids[auto.token[last[rows[ask], before[ask]]]], self._ids[auto.token[node[ask]]])
                last[rows[good], k] = node[good]
                rows, node = rows[~good], auto.shorter[node[~good]]
        columns, at, rows = [], size.copy(), np.arange(n)
        counts = np.zeros(n, np.int64)
        while len(rows):
            node = last[rows, at[rows]]
            column = np.full(n, -1, np.int32)
            column[rows] = self._ids[auto.token[node]]
            columns.append(column)
            counts[rows] += 1
            at[rows] -= auto.length[node]
            rows = rows[at[rows] > 0]
        return np.stack(columns, axis=1), counts

    def _long(self, symbols: list[int]) -> list[int]:
        """The ids of one word, from the last to the first."""
        auto, judged = self._automaton, {}
        moves, link, length, shorter = auto.moves, auto.link.tolist(), auto.length.tolist(), auto.shorter.tolist()
        token = [int(self._ids[t]) if t >= 0 else -1 for t in auto.token.tolist()]
        last, state, matched = [0], 0, 0
        for k, symbol in enumerate(symbols, 1):
            while (to := moves.get(state * SYMBOLS + symbol)) is None and state:
                state = link[state]
                matched = length[state]
            state, matched = (0, 0) if to is None else (to, matched + 1)
            node = state if token[state] >= 0 and matched == length[state] else shorter[state]
            while node >= 0 and length[node] < k:
                pair = token[last[k - length[node]]], token[node]
                if pair not in judged:
                    judged[pair] = self._compatible.one(*pair)
                if judged[pair]:
                    break
                node = shorter[node]
            if node < 0:
                raise ValueError("no token of the vocabulary ends a prefix")
            last.append(node)
        ids, at = [], len(symbols)
        while at:
            ids.append(token[last[at]])
            at -= length[last[at]]
        return ids

    def _odd_ids(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of chunks that the library has to normalise and split, and that may hold special tokens."""
        words, plan = [], []
        for chunk in chunks:
            own: list[int] = []  # an id, or below zero the place of a word
            for part in self._cut.split(chunk) if self._cut else [chunk]:
                if part in self._special:
                    own.append(self._special[part])
                elif part:
                    for word, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(self._tokenizer.normalizer.normalize_str(part)):
                        words.append(b"".join(map(self._byte.__getitem__, word)).decode())
                        own.append(-len(words))
            plan.append(own)
        rows = self._words.rows(words)
        ids = np.split(self._words.gather(rows), np.cumsum(self._words.sizes(rows))[:-1]) if words else []
        return [np.concatenate([[i] if i >= 0 else ids[-1 - i] for i in own] or [[]]).astype(np.int64) for own in plan]


def prefix_tokenizer(path: str) -> PrefixTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = PrefixTokenizer(path)
    return _tokenizers[path]


def encode_bpe(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    The ids are those of the ``tokenizers`` library without special tokens around the text; special tokens inside a text
    are found as the library finds them. ``decoded`` is the tokens' strings joined as the file's decoder says; only files
    without one, whose strings are joined by spaces, are taken. A null text counts as empty, an empty or blank one has no
    ids; a null id stays null and repeated rows give equal rows. An empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = prefix_tokenizer(tokenizer_path)
        strings = pa.array(tokenizer.strings, pa.large_string())
        for part in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids, sizes = tokenizer.encode(part.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + OUT_BYTES // 4, "right")) - 1)
                own, at = ids[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), strings.take(pa.array(own))), pa.scalar(" ", pa.large_string()))
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int64()), raw, texts.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
                lo = hi
        tokenizer.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, ids binary, decoded string")
