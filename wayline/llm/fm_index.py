"""An FM-index over integer symbols, held in bits: a wavelet matrix of the Burrows-Wheeler transform that is searched
backwards, a wavelet matrix of the documents in the order of the suffixes, marks of the suffixes that share their first
symbols, and a sample of the suffixes' places. The suffix array itself is gone once the index is built."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Every so many-th place of the text is kept with its row.
SAMPLE = 32


class BitVector:
    """Bits packed into words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) // 64 + 2) * 8, dtype=np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self._words = packed.view(np.uint64)
        self._before = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.n, self.ones = len(bits), int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each position."""
        word = at >> 6
        return self._before[word].astype(np.int64) + np.bitwise_count(self._words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE == _ONE

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one, from 0; the length for the one after the last."""
        inside = k < self.ones
        low = np.where(inside, (np.searchsorted(self._before, np.where(inside, k, 0), "right") - 1) << 6, 0).astype(np.int64)
        width = 32
        while width:  # halving inside the word
            low = np.where(inside & (self.rank(low + width) <= k), low + width, low)
            width //= 2
        return np.where(inside, low, self.n)


class WaveletMatrix:
    """Ranks of symbols in a sequence, and the smallest symbol of a range: a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels = max(1, int(largest).bit_length())
        self._bits: list[BitVector] = []
        self._zeros: list[int] = []
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1 == 1
            self._bits.append(BitVector(bit))
            self._zeros.append(len(bit) - self._bits[-1].ones)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(largest + 1)
        self._first = self._descend(every, np.zeros(len(every), dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self._bits, self._zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position."""
        return self._descend(symbol, at) - self._first[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self._bits, self._zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            out = out * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return out

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol of each range, none of them empty."""
        out = np.zeros(len(low), dtype=np.int64)
        for bits, zeros in zip(self._bits, self._zeros, strict=True):
            a, b = bits.rank(low), bits.rank(high)
            one = high - b == low - a  # no symbol of the range has a zero here
            low, high, out = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b), out * 2 + one
        return out


class FMIndex:
    """Searches patterns in a collection of sequences and tells the smallest document that has one.

    ``sequences`` are given one after the other, each of them followed by one 0; other symbols are positive.
    ``documents`` has the document of each symbol. Rows are the suffixes in order; ``order`` is the length up to which
    matches are kept, and all rows that share their first ``order`` symbols are a block.
    """

    def __init__(self, sequences: np.ndarray, order: int, documents: np.ndarray | None = None) -> None:
        n = self.n = len(sequences)
        self.order = order
        rank, depth, kept, step = np.append(sequences, 0).astype(np.int64), 1, None, 0
        while True:
            if depth <= order < 2 * depth:
                kept, step = rank[:n], order - depth
            if depth > order and int(rank[:n].max(initial=0)) == n - 1:
                break
            later = np.zeros(n, dtype=np.int64)
            later[: max(0, n - depth)] = rank[depth:n] + 1
            rank = np.unique(rank[:n] * (n + 2 + int(sequences.max(initial=0))) + later, return_inverse=True)[1]
            depth *= 2
        suffix = np.argsort(rank[:n], kind="stable")
        bwt, largest = sequences[suffix - 1].astype(np.int64), int(sequences.max(initial=0))
        self._wavelet = WaveletMatrix(bwt, largest)
        counts = np.bincount(bwt, minlength=largest + 1)
        self._less = np.cumsum(counts) - counts
        head, tail = kept[suffix], kept[np.minimum(suffix + step, n - 1)]
        new = np.ones(n, dtype=bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        self._blocks = BitVector(new)
        sampled = suffix % SAMPLE == 0
        self._sampled, self._places, self._whole = BitVector(sampled), suffix[sampled].astype(np.int32), int(np.flatnonzero(suffix == 0)[0]) if n else 0
        documents = np.zeros(n, dtype=np.int64) if documents is None else documents
        self._names = np.unique(documents)
        self._documents = WaveletMatrix(np.searchsorted(self._names, documents)[suffix], max(len(self._names) - 1, 0))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the backward search: the rows of symbol + pattern from those of each pattern."""
        both = self._less[np.concatenate([symbol, symbol])] + self._wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]

    def interval(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each run of ``size`` symbols of ``flat`` from ``at`` on; an empty interval if it does not occur."""
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.n, dtype=np.int64)
        for k in range(int(size.max(initial=0))):
            go = (k < size) & (high > low)
            known = flat[np.where(go, at + size - 1 - k, 0)]
            a, b = self.extend(np.where(known < len(self._less), known, 0), low, high)
            low, high = np.where(go, a, low), np.where(go, np.where(known < len(self._less), b, a), high)
        return low, high

    def block(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each row is in."""
        k = self._blocks.rank(low + 1) - 1
        return self._blocks.select(k), self._blocks.select(k + 1)

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of the rows of each interval, none of them empty."""
        return self._names[self._documents.least(low, high)]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of these rows' suffixes: steps back through the text until a place that was kept."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        while (todo := np.flatnonzero(out < 0)).size:
            here = rows[todo]
            done = self._sampled.get(here)
            out[todo[done]] = self._places[self._sampled.rank(here[done])] + steps[todo[done]]
            here, todo = here[~done], todo[~done]
            symbol = self._wavelet.get(here)
            back = self._less[symbol] + self._wavelet.rank(symbol, here)
            rows[todo] = np.where((symbol == 0) & (here < self._whole), back + 1, back)  # the last 0 comes first, and before no text
            steps[todo] += 1
        return out

    def matches(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of sequences that are streamed from right to left: for each of their symbols, sequence by
        sequence and from left to right, the length of the longest run from it on that the index has, up to ``order``, and
        the rows of the runs of full length (the first rows, then those after the last; 0 for shorter ones).

        A step to the left makes a match one longer; one of full length is then widened to its block. Where a step finds
        nothing, the match is cut from the right until it occurs.
        """
        by_size = np.argsort(-size, kind="stable")
        start, size = start[by_size], size[by_size]
        low, high, length = np.zeros(len(size), dtype=np.int64), np.full(len(size), self.n, dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        first = np.empty(len(size), dtype=np.int64)
        first[by_size] = size
        first = (np.cumsum(first) - first)[by_size]
        out_length = np.zeros(int(size.sum()), dtype=np.int32)
        out_low, out_high = (np.zeros(int(size.sum()), dtype=np.int64) for _ in range(2))
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -step, "left"))  # the sequences longer than step
            at = start[:n] + size[:n] - 1 - step
            symbol = flat[at]
            known = symbol < len(self._less)
            a, b = self.extend(np.where(known, symbol, 0), low[:n], high[:n])
            hit = known & (b > a)
            now = length[:n] + 1
            if not hit.all():
                lost = np.flatnonzero(~hit)
                now[lost], a[lost], b[lost] = self._shortened(flat, at[lost], length[lost])
            full = np.flatnonzero(now >= self.order)
            a[full], b[full] = self.block(a[full])
            now[full] = self.order
            low[:n], high[:n], length[:n] = a, b, now
            where = first[:n] + size[:n] - 1 - step
            out_length[where], out_low[where[full]], out_high[where[full]] = now, a[full], b[full]
        return out_length, out_low, out_high

    def _shortened(self, flat: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match of at most ``most`` symbols from each place on, and its rows, by halving its length."""
        low, high = np.zeros(len(at), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = self.interval(flat, at, middle)
            low, high = np.where(b > a, middle, low), np.where(b > a, high, middle - 1)
        return low, *self.interval(flat, at, low)
