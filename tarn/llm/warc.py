"""WARC archives whose records are Zstandard frames with a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import file_system, lean, new_file, shared_dir, sized, table

#: A payload of fewer bytes is archived each time it occurs.
REVISIT_BYTES = 1000
#: Compressed bytes after which an archive file ends, and payload bytes of a task, about.
FILE_BYTES, TASK_BYTES = 1 << 30, 4 << 30
#: Records are held until they have WINDOW_BYTES: the dictionary leads the file, so it is built
#: before the first record is compressed. It decides how small a file gets and nothing else.
WINDOW_BYTES = 8 << 20
#: The dictionary's bytes at most, the bytes it is trained on and those of one sample.
DICTIONARY_BYTES, SAMPLE_BYTES, PIECE_BYTES = 32 << 10, 1 << 20, 4 << 10
#: Bytes of an archive that are read at once.
READ_BYTES = 1 << 16
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    return int(uri[10:-1]) if len(uri) > 11 else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = " ".join((url or "about:blank").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The fields of one record; digests that do not fit the bytes raise."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if base64.b32decode(fields["warc-block-digest"][5:]) != hashlib.sha1(block).digest():
        raise ValueError("a record's bytes do not fit its block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not fit its digest")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length: "))
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page_id(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary built from a file's records.

    It is trained on pieces of PIECE_BYTES that are spread evenly over all bytes of the records,
    about SAMPLE_BYTES in all. Where these are too few or too uniform to train on, the pieces
    themselves are the dictionary.
    """
    pieces = [(r, at) for r in records for at in range(0, len(r), PIECE_BYTES)]
    step = max(1, -(-len(pieces) * PIECE_BYTES // SAMPLE_BYTES))
    sample = [r[at : at + PIECE_BYTES] for r, at in pieces[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        # the reader tells by the first bytes that this is content, not a trained dictionary
        raw = b"".join(sample)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: Iterator[bytes], out: BinaryIO, limit: float = FILE_BYTES) -> tuple[int, int]:
    """Writes a file of the next records: the dictionary in a leading skippable frame, and one frame per record.

    Ends with the record at which the file reaches ``limit`` bytes, or WINDOW_BYTES of records if
    that is later. Returns the records and bytes written.
    """
    held, size = [], 0
    while size < WINDOW_BYTES and (one := next(records, None)) is not None:
        held.append(one)
        size += len(one)
    words = dictionary(held)
    raw = words.as_bytes()
    words.precompute_compress(level=3)
    press = zstandard.ZstdCompressor(dict_data=words, write_content_size=True)
    head = SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    out.write(head)
    n, size = len(held), len(head)
    for frame in map(press.compress, held):
        out.write(frame)
        size += len(frame)
    held.clear()
    while size < limit and (one := next(records, None)) is not None:
        frame = press.compress(one)
        out.write(frame)
        n, size = n + 1, size + len(frame)
    return n, size


def packed(records: list[bytes]) -> bytes:
    """A file of all ``records``."""
    out = io.BytesIO()
    pack(iter(records), out, math.inf)
    return out.getvalue()


def unpacked(data: bytes | BinaryIO) -> Iterator[bytes]:
    """The records of a file one by one; no more of the file than READ_BYTES is held."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    head = source.read(8)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("the leading dictionary frame is missing")
    words = zstandard.ZstdCompressionDict(source.read(int.from_bytes(head[4:], "little")))
    open_frames = zstandard.ZstdDecompressor(dict_data=words)
    piece = source.read(READ_BYTES)
    while piece:
        one, made = open_frames.decompressobj(), []
        while not one.eof:
            if not piece:
                raise ValueError("a record's frame is cut off")
            made.append(one.decompress(piece))
            piece = one.unused_data if one.eof else source.read(READ_BYTES)
        yield b"".join(made)
        piece = piece or source.read(READ_BYTES)


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, bytes, kept_id, n): a row for each distinct payload, its largest page_id and its rows.

    Digests are pre-aggregated before the shuffle, so a payload of a third of all rows is a row
    per task.
    """
    made = pages.select("page_id", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    return made.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("n"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; a row per file: name, attempt, records, bytes.

    Of equal payloads of REVISIT_BYTES or more the largest page_id is a response, the others are
    revisits of it; rows that repeat this id are responses too, and if all ids are null all are
    responses. A null html is an empty payload, a null url about:blank. Very large payloads are one
    record like any other. No pages give no files. Other columns are ignored.

    Payloads stay where they are read while the digests of repeated ones are few enough to be
    broadcast. Neighbouring partitions of the pages are one task, about TASK_BYTES, if there are
    more of them than that takes and than there are cores. Records go to the file as they are
    compressed; files end at FILE_BYTES, and their names hold the attempt of the task that wrote them.
    A repeated or speculative attempt writes beside the first, and the returned table, written by
    Spark's own committer, lists the files of just one attempt of each task.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    marked = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kinds = table(payloads(rows))
    total = kinds.agg(F.sum(F.col("payload_bytes") * F.col("n"))).first()[0] or 0
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    again = kinds.where((F.col("n") > 1) & (F.col("payload_bytes") >= REVISIT_BYTES)).drop("n")
    marked = marked.join(sized(again), ["payload_digest", "payload_bytes"], "left")
    other = F.col("page_id").isNull() | (F.col("page_id") < F.col("kept_id"))
    marked = marked.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("kept_id")).alias("refers_to"))

    def run(batches):
        attempt, serial = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        records = (record(*(batch.column(k)[i].as_py() for k in range(5))) for batch in batches for i in range(batch.num_rows))
        for first in records:
            name = f"part-{attempt}-{serial:06d}.warc.zst"
            with new_file(folder, name) as out:
                n, size = pack(chain([first], records), out)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([attempt]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "attempt", "records", "bytes"])
            serial += 1

    return table(marked.coalesce(tasks).mapInArrow(lean(run), "name string, attempt string, records long, bytes long"))


def read(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """A row per record of the archives that ``written`` lists: ids, url, payload and what write() made of it.

    ``written`` must not be empty, ``folder`` may hold other files too: what attempts left that
    did not count is not read. The tasks open the files by their names, so nobody lists the folder,
    and read them record by record. A file that is missing, or holds other records than it should,
    fails the job. Revisits have a null payload.
    """
    listed = written.select("name", "records")
    system, path = file_system(folder)

    def there(batches):
        for batch in batches:
            held = [system.get_file_info(f"{path}/{name}").type == pafs.FileType.File for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_())], names=["there"])

    found = listed.select("name").mapInArrow(there, "there boolean").agg(F.count("*").alias("n"), F.count_if("there").alias("there")).first()
    if found["there"] != found["n"]:
        raise ValueError(f"{folder} has {found['there']} of {found['n']} archives")

    def run(batches):
        for name, records in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for batch in batches for i in range(batch.num_rows)):
            held, size, n = [], 0, 0
            with system.open_input_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as source:
                for raw in unpacked(source):
                    held.append(parsed(raw))
                    size, n = size + len(raw), n + 1
                    if size > 1 << 21:
                        yield out(held)
                        held, size = [], 0
            if n != records:
                raise ValueError(f"an archive has {n} records instead of {records}")
            yield out(held)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in fields], names=[n for n, _ in fields])

    return listed.repartition(found["n"]).mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back, without payloads.

    Nulls, empty and very large payloads, ties and repeated rows are as in ``write``: each row of
    ``pages`` has one row here. No pages give no rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    written = write(pages, folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder, written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN top END AS refers_to
FROM m
"""
