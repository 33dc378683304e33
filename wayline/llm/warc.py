"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a line whose separator is the blank line that ends every record; the record separator of the format
and the line separator of the writer are one and the same. Reading is the other way round: the version line that opens
every record is the line separator, so that tasks split the archives wherever the version line stands, also inside a
payload, and a file of any size can be read in many splits. Each such place is a candidate record: its header gives its
length and so the offset of its successor. Starting at offset 0 and jumping from record to successor, only true records
are reached. A split's pointers are doubled inside the task until they leave the split; the jumps from split to split are
doubled by joins. A payload with version lines in it comes in fragments, which are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.shared import HEAVY, discard, fresh_path, materialize, prepare, salted_join, shuffle_partitions

VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
#: Records of one archive file; bounds what is lost with a file and read by a task when archives are compressed.
FILE_RECORDS = 20_000
#: Tasks that the rows of one very common payload are dealt to.
SALTS = 16
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal string whose number of digits is a multiple of five."""
    parts = []
    for at in range(1, digits, 5):
        n = F.conv(F.substring(hexadecimal, at, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(_ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def assigned(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` (page_id, payload and others) with ``refers_to``: for a page that revisits another one the id of that one.
    Of equal payloads of at least ``least`` bytes the largest id is the response. Payloads are equal when their SHA-256
    is. Rows are judged by their own payload, also where several have one id; a payload that a large part of all rows has
    is dealt to several tasks."""
    same = F.unhex(F.sha2("payload", 256))
    keys = materialize(pages.where("page_id IS NOT NULL").where(F.octet_length("payload") >= least).select("page_id", same.alias("same")), "payloads")
    groups = materialize(keys.groupBy("same").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1"), "responses")
    heavy = groups.where(F.col("n") > max(keys.count() // HEAVY, 1))
    joined = salted_join(pages.withColumn("same", same), groups.drop("n"), ["same"], "left", heavy, SALTS)
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("largest"), F.col("largest"))).drop("same", "largest")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip", date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row of ``pages`` below ``path``.

    A null payload is empty. Of equal payloads of ``least`` bytes or more the page with the largest id becomes the
    response and the others revisit it; smaller payloads, and pages without an id, are responses. Repeated rows give
    repeated records. A URL's characters outside visible ASCII are percent-encoded; a null URL has no header. An empty
    table writes an archive folder without records; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    joined = assigned(rows, least)
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(BLANK))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    uri = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    for kept in ":/?#[]@!$&'()*,;=~":  # signs that may stand in a URL
        uri = F.replace(uri, F.lit("%%%02X" % ord(kept)), F.lit(kept))
    uri = F.replace(F.replace(uri, F.lit("%2B"), F.lit("+")), F.lit("%25"), F.lit("%"))
    header = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("payload")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {_PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK), block,
    )
    joined.select(header.alias("value")).write.option("lineSep", BLANK).option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(path)


def _field(head: Column, name: str) -> Column:
    value = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def _after_blank(data: Column) -> tuple[Column, Column]:
    """What stands before the first blank line, and the number of bytes up to and with it (null without one)."""
    head = F.substring_index(data.cast("string"), BLANK, 1)
    return head, F.when(F.octet_length(head) < F.octet_length(data), F.octet_length(head) + len(BLANK))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines, in order of (file, block, place)."""
    lines = spark.read.option("lineSep", VERSION).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("data")
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``: record_id, record_type, target_uri, refers_to,
    declared_digest, payload_bytes, payload_digest. A revisit's length and digest are those that it declares. Only records that the chain from the start of their file reaches are returned; a file that does not begin
    with a record has none."""
    pieces = materialize(_summaries(_fragments(spark, path)), "candidates")
    true = materialize(_reached(pieces), "records")
    # A record is whole in its fragment unless its payload holds a version line.
    broken = true.where("NOT whole")
    out = true.where("whole").select(*_COLUMNS)
    if broken.take(1):
        out = out.unionByName(_rejoined(spark, path, pieces, true))
    return out


_COLUMNS = ["record_id", "record_type", "target_uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest"]


def _length(head: str) -> Column:
    """The length that a header tells, null beyond 15 digits: inside a payload any number may stand."""
    return F.expr(f"try_cast(regexp_extract({head}, '(?im)^Content-Length:[ \\\\t]*([0-9]{{1,15}})(?![0-9])', 1) AS bigint)")


def _described(df: DataFrame, data: str) -> DataFrame:
    """Adds what a record's bytes say to rows with ``data``, the bytes after its version line."""
    head, size = _after_blank(F.col(data))
    df = df.withColumns({"head": head, "head_bytes": size}).withColumn("length", _length("head"))
    # A length beyond the fragment is cut there, and the record is not whole.
    df = df.withColumn("content", F.expr(f"substring({data}, head_bytes + 1, CAST(least(length, octet_length({data})) AS INT))"))
    http, skip = _after_blank(F.col("content"))
    df = df.withColumns({"http": http, "skip": F.coalesce(skip, F.lit(0))})
    payload = F.expr("substring(content, skip + 1, octet_length(content) - skip)")
    revisit = F.lower(F.coalesce(_field(F.col("head"), "WARC-Type"), F.lit(""))) == "revisit"
    said = F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "")
    return df.withColumns({
        "record_id": _field(F.col("head"), "WARC-Record-ID"), "record_type": F.lower(_field(F.col("head"), "WARC-Type")), "target_uri": _field(F.col("head"), "WARC-Target-URI"),
        "refers_to": _field(F.col("head"), "WARC-Refers-To"), "declared_digest": said,
        "payload_bytes": F.when(revisit, _length("http")).otherwise(F.octet_length(payload).cast("long")),
        "payload_digest": F.when(revisit, said).otherwise(base32(F.sha1(payload))),
        "whole": F.octet_length("content") == F.col("length"),
    })


def _summaries(fragments: DataFrame) -> DataFrame:
    """Fragments without their bytes: offsets, and for those that look like a record its successor and description."""
    seen = _described(fragments.withColumn("bytes", F.octet_length("data").cast("long")), "data")
    seen = materialize(seen.select("file", "block", "place", "bytes", "head_bytes", "length", "whole", *_COLUMNS), "fragments")
    step = len(VERSION)
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    # The first fragment of a file stands before its first version line.
    at = F.col("base") + F.coalesce(F.sum(F.col("bytes") + step).over(inside), F.lit(0)) - step
    placed = seen.join(blocks, ["file", "block"]).withColumn("at", at)
    return placed.select("file", "block", "place", "at", (F.col("at") + step + F.col("head_bytes") + F.col("length") + len(BLANK)).alias("next"), F.coalesce("whole", F.lit(False)).alias("whole"), *_COLUMNS)


def _ends(at: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For candidates sorted by offset: the candidate that each points to (its own number if none of these), and the
    offset at which the chain from each leaves them. Pointers double until they no longer move."""
    n = len(at)
    to = np.minimum(np.searchsorted(at, following), n - 1)
    step = np.where(at[to] == following, to, np.arange(n))
    last = step.copy()
    while True:
        jump = last[last]
        if (jump == last).all():
            return step, following[last]
        last = jump


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from wayline.llm.near_dedup import _groups

    for group in _groups(batches, 2):
        _, leaves = _ends(group.column("at").to_numpy(), group.column("next").to_numpy())
        yield pa.RecordBatch.from_arrays([group.column("file").combine_chunks(), group.column("at").combine_chunks(), pa.array(leaves)], names=["file", "at", "leaves"])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each (file, block) that its entry reaches: what is reached doubles together with the jumps."""
    from wayline.llm.near_dedup import _groups

    for group in _groups(batches, 2):
        at = group.column("at").to_numpy()
        jump, _ = _ends(at, group.column("next").to_numpy())
        reached = group.column("entry").to_numpy(zero_copy_only=False).astype(bool)
        while True:
            more = reached.copy()
            more[jump[reached]] = True
            if (more == reached).all() and (jump == jump[jump]).all():
                break
            reached, jump = more, jump[jump]
        own = np.flatnonzero(reached)
        yield pa.RecordBatch.from_arrays([group.column("file").combine_chunks().take(pa.array(own)), pa.array(at[own])], names=["file", "at"])


def _reached(pieces: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches."""
    parts = shuffle_partitions(pieces.sparkSession)
    candidates = pieces.where("next IS NOT NULL AND at >= 0").select("file", "block", "at", "next")
    by_block = candidates.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "at")
    entries = candidates.where("at = 0").select("file", "at").distinct()
    if pieces.select("file", "block").where("block > 0").take(1):
        jumps = materialize(by_block.mapInArrow(_leave, "file string, at long, leaves long"), "jumps")
        entries = materialize(entries, "entries")
        while True:
            further = entries.join(jumps, ["file", "at"]).select("file", F.col("leaves").alias("at")).join(candidates.select("file", "at"), ["file", "at"], "left_semi")
            grown = materialize(entries.unionByName(further).distinct(), "entries")
            done = grown.count() == entries.count()
            discard(entries)
            entries = grown
            if done:
                break
            double = jumps.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("then"))
            doubled = materialize(jumps.join(double, ["file", "leaves"], "left").select("file", "at", F.coalesce("then", "leaves").alias("leaves")), "jumps")
            discard(jumps)
            jumps = doubled
    marked = candidates.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").select("file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    reached = marked.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "at").mapInArrow(_follow, "file string, at long")
    return pieces.join(reached, ["file", "at"])


def _rejoined(spark: SparkSession, path: str, pieces: DataFrame, true: DataFrame) -> DataFrame:
    """The records whose payload holds version lines: all fragments from their start to their successor's."""
    starts = true.select("file", "at", F.lit(True).alias("start"), F.col("whole").alias("start_whole"))
    rows = pieces.select("file", "block", "place", "at").join(starts, ["file", "at"], "left")
    # The record that a fragment belongs to began at the last true start before it, in this block or an earlier one.
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("record", F.last(F.when(F.col("start"), F.struct("at", "start_whole")), ignorenulls=True).over(own))
    last = rows.groupBy("file", "block").agg(F.max(F.when(F.col("start"), F.struct("at", "start_whole"))).alias("carried"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("carried", ignorenulls=True).over(before).alias("carried"))
    rows = rows.join(last, ["file", "block"]).withColumn("record", F.coalesce("record", "carried")).where("NOT record.start_whole")
    wanted = rows.select("file", "block", "place", "at", F.col("record.at").alias("record"))
    found = _fragments(spark, path).join(wanted.hint("merge"), ["file", "block", "place"])
    joined = found.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("data").alias("data")))).alias("parts"))
    data = F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), VERSION.encode().hex()))
    return _described(joined.select(data.alias("data")), "data").select(*_COLUMNS)


def warc_round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives of ``pages`` to shared storage, reads them back and returns a row for each record: page_id,
    payload_bytes, payload_digest, record_type, refers_to (page ids; null where there is none)."""
    spark = pages.sparkSession
    prepare(spark)
    path = fresh_path(spark, "warc")
    write_warc(pages, path, least, id_col=id_col, url_col=url_col, payload_col=payload_col)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, ':([0-9-]+)>', 1) AS bigint)")
    return read_warc(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
