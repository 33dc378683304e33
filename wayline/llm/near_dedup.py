"""Near-duplicate components by MinHash and a multi-index Hamming join.

A document is the set of its word shingles. ``SYMBOLS`` minimum hashes of the set, ``16`` bits of each, are its
signature; the Hamming distance of two signatures counts the symbols that differ. Two sets of similarity s differ in a
binomial number of symbols with mean (1 - s) * SYMBOLS: at 0.85 it exceeds ``DISTANCE`` (23 of 64) for about one pair in
100,000, and at 0.9 for fewer than one in 10^9.

The join finds all pairs within the distance: the signature is split into ``CHUNKS`` (12) chunks, so that by the
pigeonhole principle some chunk of such a pair has at most 23 // 12 = 1 error, and every chunk is entered once for each
symbol that may be the wrong one. Documents that share an entry form a bucket. Identical sets are joined beforehand, and
buckets with the same members are looked at once.

In a bucket no pairs are listed: a breadth-first walk over the distances gives a spanning forest, and the forests of all
buckets give groups outside of which no pair is within the distance. Only inside such a group are full sets compared:
documents are linked when ``100 * intersection >= percent * union``. Buckets and groups above a fixed size are dealt out
by pairs of tiles, each task holding two tiles, so that no task holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.graph import components
from wayline.llm.shared import materialize, prepare, released, shuffle_partitions
from wayline.llm.words import hashed_words, mix, rolling

SYMBOLS = 64
DISTANCE = 23
CHUNKS = 12
#: Members of a bucket that one task compares; above it, tiles of half as many.
BUCKET = 8192
#: Shingles of a group that one task holds; above it, tiles of half as many.
GROUP_SHINGLES = 4_000_000
_FACTORS = np.random.default_rng(20240607).integers(1, 2**62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 16


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of each run of ``size`` words, A-Z lower-cased, or of the
    whole word sequence if it is shorter; none without words. Of a list of texts, those of all of them."""
    if pa.types.is_list(texts.type):
        own, end = shingle_sets(texts.flatten(), size), np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))
        return [np.unique(np.concatenate([np.empty(0, np.uint64), *own[a:b]])) for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
    words, counts = hashed_words(texts, lower=True)
    runs, out, at = rolling(words, size), [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1]))
        else:
            out.append(rolling(words[at : at + n], n) ^ np.uint64(n) if n else np.empty(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each of these sets, none of them empty."""
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    sizes = np.array([len(s) for s in sets])
    block = np.cumsum(sizes) // _BLOCK
    for b in np.unique(block):
        own = np.flatnonzero(block == b)
        flat = np.concatenate([sets[i] for i in own])
        starts = np.cumsum(sizes[own]) - sizes[own]
        for k in range(SYMBOLS):
            out[own, k] = (np.minimum.reduceat(flat * _FACTORS[k], starts) >> np.uint64(12)) & np.uint64(0xFFFF)
    return out


def _sign(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = shingle_sets(part.column(1), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed: list[bytes | None] = [None] * len(sets)
                for i, s in zip(full, signatures([sets[i] for i in full]), strict=True):
                    signed[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(signed, pa.binary())],
                    names=["doc_id", "n_shingles", "set_hash", "signature"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def entries(signature: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """The index entries of each signature, one for each symbol: its chunk without that symbol. A hash of a chunk is
    the sum of its symbols' hashes, so leaving one out is a subtraction."""
    place = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(1 << 20)
    symbol = mix((signature.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place)
    out = np.empty(symbol.shape, dtype=np.uint64)
    for part in np.array_split(np.arange(SYMBOLS), chunks):
        out[:, part] = mix(symbol[:, part].sum(axis=1, keepdims=True) - symbol[:, part] + place[part])
    return out.view(np.int64)


def _enter(chunks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if part.num_rows:
                    rep = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
                    yield pa.RecordBatch.from_arrays([pa.array(entries(_matrix(part.column(1)), chunks).ravel()), pa.array(rep)], names=["key", "rep"])

    return run


#: Rows of one key that a task holds before it passes them on under the key itself.
_HELD = 1_000_000


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rep) of the keys with two members or more, from rows sorted by key and rep. Buckets of the same
    members get the same number; one that is too large to hold keeps its key as its number."""

    def found(key: np.ndarray, rep: np.ndarray, whole: bool = True) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        # The smallest member and the size go in with the sum, so that two sets of members hardly get one number; if they do, they share a bucket.
        number = mix(np.add.reduceat(mix(rep.view(np.uint64)), first) + mix(rep[first].view(np.uint64)) * size.astype(np.uint64)).view(np.int64) if whole else key[first]
        keep = np.repeat(size > 1, size) if whole else np.ones(len(key), bool)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(number, size)[keep]), pa.array(rep[keep])], names=["bucket", "rep"])

    held_key, held_rep = np.empty(0, np.int64), np.empty(0, np.int64)
    passed: int | None = None  # the key whose rows are passed on
    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
        rep = np.concatenate([held_rep, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        if passed is not None:
            n = int(np.searchsorted(key, passed, "right"))
            if n:
                yield found(key[:n], rep[:n], whole=False)
            key, rep = key[n:], rep[n:]
            if not len(key):
                held_key, held_rep = key, rep
                continue
            passed = None
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield found(key[:last], rep[:last])
        held_key, held_rep = key[last:], rep[last:]
        if len(held_key) > _HELD:
            yield found(held_key, held_rep, whole=False)
            passed, held_key, held_rep = int(held_key[0]), held_key[:0], held_rep[:0]
    if len(held_key):
        yield found(held_key, held_rep)


def tiled(rows: DataFrame, key: str, rep: str, weight: str, limit: int) -> DataFrame:
    """``rows`` with columns ``tile_a`` and ``tile_b``. Keys up to ``limit`` in total weight have one tile. A larger
    key's rows are dealt to tiles of about half the limit, and each row appears with every pair that has its tile, so
    that any two rows of the key meet in some (key, tile_a, tile_b)."""
    large = materialize(rows.groupBy(key).agg(F.sum(weight).alias("w")).where(F.col("w") > limit), "large")
    if not large.take(1):
        return rows.withColumns({"tile_a": F.lit(0), "tile_b": F.lit(0)})
    tiles = F.ceil(F.coalesce(F.col("w") * 2 / limit, F.lit(1))).cast("int")
    own = F.pmod(F.xxhash64(rep), F.col("tiles")).cast("int")
    return (
        rows.join(large, key, "left").withColumn("tiles", tiles).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"tile_a": F.least("own", "other"), "tile_b": F.greatest("own", "other")})
        .drop("w", "tiles", "own", "other")
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    value: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            own = tuple(c[a] for c in columns)
            if value is not None and own != value:
                yield pa.Table.from_batches(held)
                held = []
            value = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def forest(signature: np.ndarray, sizes: np.ndarray, distance: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins two signatures within the distance whose sets' sizes allow a link."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(signature))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (np.minimum(sizes[left], sizes[x]) * 100 >= np.maximum(sizes[left], sizes[x]) * percent) & ((signature[left] != signature[x]).sum(axis=1) <= distance)
            out += [(x, y) for y in left[near].tolist()]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _forests(distance: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for group in _groups(batches, 3):
            rep = group.column("rep").to_numpy()
            if len(rep) < 2:
                continue
            signature = _matrix(group.column("signature"))
            if edges := forest(signature, group.column("n_shingles").to_numpy(), distance, percent):
                ends = np.array(edges)
                a.append(rep[ends[:, 0]])
                b.append(rep[ends[:, 1]])
            if len(a) >= 2000:
                yield _edges(a, b)
                a, b = [], []
        if a:
            yield _edges(a, b)

    return run


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Enough links to connect all sets that a chain of links connects, each compared in full.

    Sets are taken by size. Two of them can only be linked if their rarest elements, ``size - ceil(percent * size /
    100) + 1`` of each, have one in common; an element that no other set has can't be that one. Pairs that are
    connected already are not compared again.
    """
    sizes = np.array([len(s) for s in sets])
    distinct, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_rarity = np.empty(len(distinct), dtype=np.int64)
    by_rarity[np.argsort(count, kind="stable")] = np.arange(len(distinct))
    alone = int((count == 1).sum())
    ranked = [np.sort(r) for r in np.split(by_rarity[code], np.cumsum(sizes)[:-1])]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    # Element -> root -> the sets below that root that have it: a set that is connected with a root skips all of them at
    # once, so that a group whose members are all alike costs a comparison or two for each member, not one for each pair.
    seen: dict[int, dict[int, list[int]]] = {}
    mark = np.zeros(len(distinct), dtype=bool)
    out: list[tuple[int, int]] = []
    for x in np.argsort(sizes, kind="stable").tolist():
        n, own = int(sizes[x]), ranked[x]
        prefix = own[: n - -(-percent * n // 100) + 1]
        prefix = prefix[prefix >= alone].tolist()
        mark[own] = True
        tried: set[int] = set()
        for e in prefix:
            for r in (held := _rooted(seen, e, find)):
                for y in held[r]:
                    if find(x) == find(r):
                        break
                    if y in tried or int(sizes[y]) * 100 < n * percent:
                        continue
                    tried.add(y)
                    both = int(mark[ranked[y]].sum())
                    if both * 100 >= (n + int(sizes[y]) - both) * percent:
                        rx, ry = find(x), find(y)
                        root[max(rx, ry)] = min(rx, ry)
                        out.append((x, y))
        mark[own] = False
        for e in prefix:
            seen.setdefault(e, {}).setdefault(find(x), []).append(x)
    return out


def _rooted(seen: dict[int, dict[int, list[int]]], e: int, find: Callable[[int], int]) -> dict[int, list[int]]:
    """The sets that have ``e``, by their present roots: the shorter of two lists whose roots were joined goes to the longer."""
    held = seen.get(e)
    if held is None:
        return {}
    for r in [r for r in held if find(r) != r]:
        own = held.pop(r)
        other = held.get(find(r), [])
        longer, shorter = (own, other) if len(own) > len(other) else (other, own)
        longer.extend(shorter)
        held[find(r)] = longer
    return held


def _links(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rep = group.column("rep").to_numpy()
            first = np.concatenate([[True], rep[1:] != rep[:-1]])  # a row that is there twice
            rep, texts = rep[first], group.column("text").combine_chunks().filter(pa.array(first))
            if len(rep) > 1 and (edges := links(shingle_sets(texts, size), percent)):
                ends = np.array(edges)
                yield _edges([rep[ends[:, 0]]], [rep[ends[:, 1]]])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bucket: int = BUCKET, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``percent`` is the least similarity of a link in hundredths. A text without words, or a null one, has no shingles
    and is linked with nothing. A row without an id is linked with nothing either: its component_id is null and it is
    kept. Rows with the same id are one document, whose set has the shingles of all its texts; each of them gets the
    document's result. ``component_id`` is the smallest id reachable by links, and
    ``kept`` marks the rows whose own id it is. An empty table gives an empty result; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("the signature's distance is set for similarities of 0.8 and more")
    # The distance leaves room of about five standard deviations above the mean number of errors at the least similarity.
    mean = SYMBOLS * (100 - percent) / 100
    distance = DISTANCE if percent >= 85 else min(SYMBOLS - 1, int(mean + 5 * (mean * percent / 100) ** 0.5))
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    several = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    repeated = bool(several.take(1))
    if repeated:
        own = rows.join(several.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_set("text").alias("text"))
        rows = rows.join(several, "doc_id", "left_anti").select("doc_id", F.array("text").alias("text")).unionByName(own)
    signed = materialize(rows.mapInArrow(released(_sign(shingle)), "doc_id long, n_shingles long, set_hash binary, signature binary"), "signed")
    sets = materialize(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "sets",
    )
    chunks = -(-(distance + 1) // 2)
    found = (
        sets.select("rep", "signature").mapInArrow(released(_enter(chunks)), "key long, rep long")
        .repartition(parts, "key").sortWithinPartitions("key", "rep").mapInArrow(released(_buckets), "bucket long, rep long")
    )
    members = materialize(found.repartition(parts, "rep").dropDuplicates(["rep", "bucket"]).join(sets.select("rep", "n_shingles", "signature"), "rep"), "members")
    near = (
        tiled(members.withColumn("one", F.lit(1)), "bucket", "rep", "one", bucket)
        .select("bucket", "tile_a", "tile_b", "rep", "n_shingles", "signature")
        .repartition(parts, "bucket", "tile_a", "tile_b").sortWithinPartitions("bucket", "tile_a", "tile_b", "rep")
        .mapInArrow(released(_forests(distance, percent)), "a long, b long")
    )
    grouped = components(near).withColumnsRenamed({"node": "rep", "component": "candidates"})
    grouped = materialize(grouped.join(sets.select("rep", "n_shingles"), "rep"), "grouped")
    texts = (
        tiled(grouped, "candidates", "rep", "n_shingles", group_shingles)
        .hint("merge").join(rows.select(F.col("doc_id").alias("rep"), "text"), "rep")  # one plan at every size
        .select("candidates", "tile_a", "tile_b", "rep", "text")
        .repartition(parts, "candidates", "tile_a", "tile_b").sortWithinPartitions("candidates", "tile_a", "tile_b", "rep")
    )
    linked = components(texts.mapInArrow(released(_links(shingle, percent)), "a long, b long")).withColumnRenamed("node", "rep")
    label = sets.select("set_hash", "rep").join(linked, "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(label, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    if repeated:
        out = out.join(several, "doc_id", "left").withColumn("_row", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))).drop("n", "_row")
    return out
