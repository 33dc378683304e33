"""Exact deduplication by a tree of merges of sorted digest runs.

Every task sorts the digests of its own rows into a run and keeps one entry for each digest: the smallest identifier
and the number of rows. A run travels as blocks, each a piece of it in order, packed as bytes. The runs are merged in
rounds over numbered nodes. A node's number and the digest's slice are both written in base ``fan_in``; in round r each
node deals its run out among the ``fan_in`` nodes that differ from it in digit r alone, by digit r of the entry's slice.
A node therefore receives sorted runs, whose blocks come to it in the order of their first digests; it merges them as
they come, gives out what lies before the next block's first digest, and again keeps one verified entry for each digest.
It holds one block of each run. After the last round a node holds one slice of all digests, so no single task ever holds
the whole, and copies of one text shrink at every level before they travel further.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.shared import HEAVY, Run, materialize, prepare, released, salted_join, shuffle_partitions

#: What one space replaces: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Runs that one node merges in a round.
FAN_IN = 8
#: Tasks that the rows of one very common text are dealt to.
SALTS = 16
_NO_ID = (1 << 63) - 1
#: Entries of a block.
BLOCK = 4096
_ENTRY = np.dtype([("digest", "S32"), ("check", "<i8"), ("n_bytes", "<i8"), ("keep_id", "<i8"), ("n", "<i8")])
_BLOCKS = "node int, first binary, entries binary"


def normalized(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(doc_id, digest, check, n_bytes) of each row, with ``carry`` the whole row as ``row``; ``check`` is a second,
    independent hash of the text."""
    text = normalized(F.col(text_col))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), *whole).select(
        "doc_id", F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").cast("long").alias("n_bytes"), *(["row"] if carry else [])
    )


def combined(entries: np.ndarray) -> np.ndarray:
    """Sorted runs that stand one after the other as one run with one entry for each digest: the smallest identifier and
    the summed size. Entries of one digest must agree in the length of their text and in its second hash; if they don't,
    two texts collide and the merge stops rather than join them."""
    entries = entries[np.argsort(entries["digest"], kind="stable")]  # a stable sort finds the runs and merges them
    same = entries["digest"][1:] == entries["digest"][:-1]
    if (same & ((entries["n_bytes"][1:] != entries["n_bytes"][:-1]) | (entries["check"][1:] != entries["check"][:-1]))).any():
        raise ValueError("two different texts have one digest")
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    out = entries[first]
    out["keep_id"] = np.minimum.reduceat(entries["keep_id"], first)
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


def merged(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The run that blocks of several runs merge into, in parts, from blocks in the order of their first digests. What is
    held lies in blocks that overlap: at most one of each run."""
    held = np.empty(0, _ENTRY)
    for block in blocks:
        done = int(np.searchsorted(held["digest"], block["digest"][0]))
        if done:
            yield held[:done]
        held = combined(np.concatenate([held[done:], block]))
    if len(held):
        yield held


def _slices(entries: np.ndarray, nodes: int) -> np.ndarray:
    """The slice of each entry: its digest's first eight bytes, modulo the number of nodes."""
    raw = np.ascontiguousarray(entries["digest"]).view("S1").reshape(len(entries), -1)[:, :8]
    return (np.ascontiguousarray(raw).view(">u8").ravel() % np.uint64(nodes)).astype(np.int64)


def _dealt(node: int, run: Iterator[np.ndarray], step: int, fan_in: int, nodes: int) -> Iterator[pa.RecordBatch]:
    """The blocks of a node's run for the nodes that differ from it in one digit."""
    base = node - node // step % fan_in * step
    waiting: dict[int, list[np.ndarray]] = {}

    def block(digit: int) -> pa.RecordBatch:
        entries = np.concatenate(waiting.pop(digit))
        return pa.RecordBatch.from_arrays([pa.array([base + digit * step], pa.int32()), pa.array([entries[:1].tobytes()[:32]], pa.binary()), pa.array([entries.tobytes()], pa.binary())], names=["node", "first", "entries"])

    for part in run:
        digits = _slices(part, nodes) // step % fan_in
        for d in np.unique(digits).tolist():
            waiting.setdefault(d, []).append(part[digits == d])
            if sum(map(len, waiting[d])) >= BLOCK:
                yield block(d)
    for d in sorted(waiting):
        yield block(d)


def first_runs(nodes: int, fan_in: int) -> Run:
    """The run of a task's own rows (doc_id, digest, check, n_bytes), which come sorted by digest, dealt by digit 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                if batch.num_rows:
                    entries = np.empty(batch.num_rows, _ENTRY)
                    entries["digest"] = np.array(batch.column(1).to_pylist(), "S32")
                    for name, c in (("keep_id", 0), ("check", 2), ("n_bytes", 3)):
                        entries[name] = batch.column(c).to_numpy(zero_copy_only=False)
                    entries["n"] = 1
                    yield entries

        yield from _dealt(TaskContext.get().partitionId() % nodes, merged(blocks()), 1, fan_in, nodes)

    return run


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """(node, its blocks) of rows sorted by (node, first); a node's blocks must be read before the next node."""
    rows = ((int(n.as_py()), np.frombuffer(e.as_buffer(), _ENTRY)) for b in batches for n, e in zip(b.column(0), b.column(2), strict=True))
    for node, own in groupby(rows, key=lambda r: r[0]):
        yield node, (block for _, block in own)


def merge_round(step: int, nodes: int, fan_in: int) -> Run:
    """Each node's runs as one, dealt by the digit whose place value is ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, blocks in _by_node(batches):
            yield from _dealt(node, merged(blocks), step, fan_in, nodes)

    return run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, keep_id, group_size) of the nodes' last runs."""
    for _, blocks in _by_node(batches):
        for part in merged(blocks):
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(part["digest"].tobytes())])
            yield pa.RecordBatch.from_arrays([digest.cast(pa.binary()), pa.array(part["keep_id"]), pa.array(part["n"])], names=["digest", "keep_id", "group_size"])


def merged_runs(entries: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, keep_id, group_size) of all of ``entries`` (doc_id, digest, check, n_bytes), by merges in rounds."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    rounds, nodes = 1, fan_in
    while nodes < shuffle_partitions(entries.sparkSession):
        rounds, nodes = rounds + 1, nodes * fan_in
    own = entries.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "digest", "check", "n_bytes").sortWithinPartitions("digest")
    blocks = own.mapInArrow(released(first_runs(nodes, fan_in)), _BLOCKS)
    for r in range(1, rounds + 1):
        blocks = blocks.repartitionById(nodes, "node").sortWithinPartitions("node", "first")
        if r < rounds:
            blocks = blocks.mapInArrow(released(merge_round(fan_in**r, nodes, fan_in)), _BLOCKS)
    runs = blocks.mapInArrow(released(_last), "digest binary, keep_id long, group_size long")
    return runs.select("digest", F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, with ``carry`` also the row itself,
    as the structure ``row``.

    Texts are equal when they are identical after white-space runs became one space; null counts as empty. Of equal
    texts the row with the smallest id stays. ``group_size`` counts rows, so a row that is there twice counts twice and
    both are kept. Rows of one id with different texts are judged each by itself. A row without an id takes part in its
    group but is kept only if no row of the group has an id. An empty table gives an empty result; other columns, whatever
    their names, are ignored. Two different texts of one SHA-256 end the job with an error instead of being joined.
    """
    prepare(docs.sparkSession)
    entries = materialize(digests(docs, id_col, text_col), "digests")
    groups = materialize(merged_runs(entries, fan_in).where("group_size > 1"), "groups")
    # Copies of one text may be a large part of all rows: the rows of such a text are dealt to several tasks.
    heavy = groups.where(F.col("group_size") > max(entries.count() // HEAVY, 1))
    rows = digests(docs, id_col, text_col, True) if carry else entries
    return salted_join(rows.drop("check", "n_bytes"), groups, ["digest"], "left", heavy, SALTS).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["row"] if carry else []),
    )
