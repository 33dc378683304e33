"""Removes passages that an earlier document has, by matching statistics on one compressed FM-index for each shard.

A window is ``window`` consecutive words. Two equal windows have the same minimiser, the smallest hash of ``anchor``
consecutive words inside them; consecutive windows of a document with one minimiser form a segment. Segments are dealt
to shards by their minimiser, so that equal windows always meet in one shard and no document has to be searched in more
than the shards of its own segments. What only one place of the corpus has is left out beforehand: a minimiser that
occurs once can't be in a repeated window.

A shard indexes its different segments once, in bits, and streams them through the backward search. That gives their
matching statistics; the intervals of those that reach the window's length name, through the documents' own wavelet
matrix, the smallest document that has the window. A segment's windows come back to all documents that have it, and words
in a window that also starts in a smaller document are removed.

A minimiser with very many different segments has its windows taken one by one; as equal windows have equal hashes, they
can be dealt to any number of shards. Copies of a segment are joined before anything is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.fm_index import FMIndex
from wayline.llm.ragged import spread
from wayline.llm.shared import HEAVY, materialize, prepare, released, salted_join, shuffle_partitions
from wayline.llm.words import hashed_words, mix, rolling, words_of

WINDOW = 50
#: Words of a minimiser.
ANCHOR = 8
#: Different segments of one minimiser above which its windows are dealt one by one.
HOT_SEGMENTS = 500
#: Tasks that the rows of one heavy key are dealt to.
SALTS = 16
#: Segments of a shard: about 300,000 words.
SHARD_SEGMENTS = 4_000


def segments(words: np.ndarray, counts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, minimiser, hash) of all segments of documents whose word hashes come one after the
    other: ``windows`` windows from word ``start`` on share their leftmost smallest anchor hash."""
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    if len(words) < window:
        return none
    grams = rolling(words, anchor)
    span = window - anchor + 1
    low, at = grams.copy(), np.arange(len(grams))
    width = 1
    while width < span:  # the smallest of ``width`` grams, then of as many more as still fit
        step = min(width, span - width)
        right, right_at = low[step:], at[step:]
        left, left_at = low[: len(right)], at[: len(right)]
        take = right < left
        low, at = np.where(take, right, left), np.where(take, right_at, left_at)
        width += step
    document = np.repeat(np.arange(len(counts)), counts)
    inside = document[: len(at)] == document[window - 1 : window - 1 + len(at)]
    first = np.flatnonzero(inside)
    if not len(first):
        return none
    change = np.concatenate([[True], (at[first[1:]] != at[first[:-1]]) | (document[first[1:]] != document[first[:-1]])])
    begin = first[change]
    windows = np.diff(np.append(np.flatnonzero(change), len(first)))
    powers = np.cumprod(np.full(2 * window + 2, 0x9E3779B97F4A7C15, dtype=np.uint64))
    sizes = windows + window - 1
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    mixed = mix(words)[spread(begin, sizes)] * powers[place]
    whole = mix(np.add.reduceat(mixed, ends - sizes) + sizes.astype(np.uint64))
    starts = np.cumsum(counts) - counts
    return document[begin], begin - starts[document[begin]], windows, mix(low[begin]).view(np.int64), whole.view(np.int64)


_PLACE = "mini long, seg long, doc_id long, part int, start int, windows int"


def _scan(window: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                document, start, windows, mini, seg = segments(*hashed_words(part.column(1)), window, anchor)
                if len(mini):
                    ids, texts = (part.column(c).to_numpy(zero_copy_only=False)[document] for c in (0, 2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini), pa.array(seg), pa.array(ids), pa.array(texts, pa.int32()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())],
                        names=["mini", "seg", "doc_id", "part", "start", "windows"],
                    )

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``state`` to rows sorted by minimiser: 0 if it occurs once in this task; else 1 for the first row, which
    tells the other tasks, and 2 for the others."""
    for batch, first, alone in _runs(batches):
        state = np.where(first, np.where(alone, 0, 1), 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, pa.int32())], names=[*batch.schema.names, "state"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in state 0 and 1 from all tasks, sorted by minimiser, those in state 0 whose minimiser is not alone."""
    for batch, _, alone in _runs(batches, by="state"):
        state = batch.column(batch.schema.names.index("state")).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(~alone & (state == 0)))


def _runs(batches: Iterator[pa.RecordBatch], by: str = "") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches, and for each row whether it is the first of its minimiser and whether it is the only one. With ``by``
    a row in state 1 stands for several. Holds the last row until the next one is known."""
    held: pa.RecordBatch | None = None
    previous: int | None = None  # the minimiser before the held row

    def marked(batch: pa.RecordBatch, after: int | None) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        first = np.concatenate([[previous is None or key[0] != previous], key[1:] != key[:-1]])
        last = np.concatenate([key[1:] != key[:-1], [after is None or key[-1] != after]])
        return batch, first, first & last

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        held = batch.slice(batch.num_rows - 1)
        if batch.num_rows > 1:
            done = batch.slice(0, batch.num_rows - 1)
            yield marked(done, held.column(0)[0].as_py())
            previous = done.column(0)[done.num_rows - 1].as_py()
    if held is not None:
        yield marked(held, None)


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of the segments of each document; of a hot minimiser's segments, of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for s in wanted:
                    start, n = s["start"], s["windows"]
                    if not s["hot"]:
                        out.append((s["mini"], s["mini"], s["seg"], 0, doc_id, b" ".join(words[start : start + n + window - 1])))
                        continue
                    for i in range(n):
                        own = b" ".join(words[start + i : start + i + window])
                        out.append((int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True), s["mini"], s["seg"], i, doc_id, own))
                if len(out) > 20_000:
                    yield _cut_rows(out)
                    out = []
            if out:
                yield _cut_rows(out)

    return run


_CUT = "deal long, mini long, seg long, first int, min_doc long, words binary"


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _CUT.split(", ")])


def earliest(words: list[bytes], documents: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For segments given as their words joined by spaces, and the smallest document of each: the smallest document of
    every window, one segment after the other, and the number of windows of each segment."""
    lists = pc.split_pattern(pa.array(words, pa.binary()).cast(pa.string()), " ")
    encoded = pc.dictionary_encode(lists.flatten())
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    end = np.cumsum(size)
    start = end - size + np.arange(len(size))  # every segment before has its separator
    flat = np.zeros(len(symbols) + len(size), dtype=np.int64)
    flat[spread(start, size)] = symbols
    index = FMIndex(flat, window, np.repeat(documents, size + 1))
    length, low, high = index.matches(flat, start, size)
    full = length >= window
    return index.smallest(low[full], high[full]), np.add.reduceat(full, end - size).astype(np.int64) if len(size) else np.empty(0, np.int64)


_FOUND = "mini long, seg long, runs array<struct<first:int,last:int,min_doc:long>>"


def _search(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from wayline.llm.near_dedup import _groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _groups(batches, 1):
            smallest, windows = earliest(shard.column("words").to_pylist(), shard.column("min_doc").to_numpy(), window)
            segment = np.repeat(np.arange(len(windows)), windows)
            new = np.concatenate([[True], (smallest[1:] != smallest[:-1]) | (segment[1:] != segment[:-1])])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(segment)))
            own = segment[at]
            first = at - (np.cumsum(windows) - windows)[own] + shard.column("first").to_numpy()[own]
            runs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(first + length - 1, pa.int32()), pa.array(smallest[at])], names=["first", "last", "min_doc"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(windows)))])
            yield pa.RecordBatch.from_arrays([shard.column("mini").combine_chunks(), shard.column("seg").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)], names=["mini", "seg", "runs"])

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept_text, digest = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = words_of(text)
            kept = words
            if spans:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    edge[min(s["a"], len(words))] += 1
                    edge[min(s["b"], len(words))] -= 1
                kept = [w for w, covered in zip(words, np.cumsum(edge).tolist(), strict=False) if not covered]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(joined.decode("utf-8", "replace") if spans else text)
            digest.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), pa.array(kept_text, pa.string()), *batch.columns[3:]],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *batch.schema.names[3:]],
        )


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, part, spans) of ``docs`` (doc_id, text, part): the word ranges [a, b) to remove, for those that have any.
    ``part`` tells the texts of one id apart."""
    parts = shuffle_partitions(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL")
    marked = materialize(
        known.mapInArrow(released(_scan(window, anchor)), _PLACE).sortWithinPartitions("mini", "doc_id", "part", "start").mapInArrow(released(_mark), _PLACE + ", state int"),
        "places",
    )
    others = marked.where("state < 2").repartition(parts, "mini").sortWithinPartitions("mini").mapInArrow(released(_shared), _PLACE)
    shared = materialize(marked.where("state > 0").drop("state").unionByName(others), "shared")
    distinct = materialize(shared.groupBy("mini", "seg").agg(F.min(F.struct("doc_id", "part", "start", "windows")).alias("at"), F.count("*").alias("copies")), "segments")
    # Minimisers with more segments than the limit are dealt to all tasks, so that none of them is one task's alone.
    hot = materialize(distinct.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > hot_segments).select("mini", F.lit(True).alias("hot")), "hot")
    if hot.take(1):
        flagged = distinct.withColumn("salt", F.pmod("seg", F.lit(SALTS))).join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["mini", "salt"], "left")
    else:
        flagged = distinct.withColumn("hot", F.lit(False))
    wanted = (
        flagged.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.part").alias("part"))
        .agg(F.collect_list(F.struct("mini", "seg", "at.start", "at.windows", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    )
    cut = docs.join(wanted.hint("merge"), ["doc_id", "part"]).select("doc_id", "text", "wanted").mapInArrow(released(_cut(window)), _CUT)
    shards = max(parts, -(-distinct.count() // SHARD_SEGMENTS))
    found = (
        cut.select(F.pmod("deal", F.lit(shards)).cast("int").alias("shard"), "mini", "seg", "first", "min_doc", "words")
        .repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(released(_search(window)), _FOUND)
    )
    heavy = distinct.where(F.col("copies") > max(shared.count() // HEAVY, 1))
    hits = salted_join(shared, found, ["mini", "seg"], "inner", heavy, SALTS)
    hits = hits.select("doc_id", "part", "start", F.filter("runs", lambda r: r["min_doc"] < F.col("doc_id")).alias("runs"))
    spans = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("a"), (F.col("start") + r["last"] + window).alias("b")))
    return hits.where(F.size("runs") > 0).groupBy("doc_id", "part").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, the digest of the words that stay
    joined by one space, and kept_text, these words or, where all of them stay, the text itself; with ``carry`` also a
    struct ``row`` of all columns of ``docs``.

    A word is removed when a window that covers it has the same words as one that starts in a document with a smaller
    id; windows are judged on the input. A null text has no words. A row without an id is neither searched nor matched
    and stays whole. Of rows with the same id each is judged by its own text, and none of them removes words of another. Texts shorter than a window stay as
    they are, an empty table gives an empty result, and other columns are ignored.
    """
    if not 0 < anchor <= window:
        raise ValueError("the anchor must fit into the window")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(text_col).alias("part"), *[F.struct(*docs.columns).alias("row")] * carry)
    spans = materialize(repeated_spans(rows.select("doc_id", "text", "part"), window, anchor, hot_segments), "spans")
    kinds = (("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds), *rows.schema.fields[3:]])
    return rows.join(spans.hint("merge"), ["doc_id", "part"], "left").select("doc_id", "text", "spans", *["row"] * carry).mapInArrow(released(_strip), schema)
