"""Content-addressed WARC archives.

``write_store`` keeps every payload once under its SHA-256, checked by length and a second checksum, and the exact header
bytes of every record apart. ``records`` joins both to whole records again, ``write_warc`` puts them into ``.warc.gz``
files (a gzip member per record) and ``read_warc`` parses such files, checks lengths and digests, and takes the payload of a
revisit from the record it refers to. File names hold the task attempt and only files in the returned manifest are
read, so repeated tasks do no harm.

Of records with equal payloads of at least ``LEAST_BYTES``, the smallest page_id is the response. Null html: empty payload.
Null url: no target line. A null page_id is always a response. Repeated rows: a record each; copies of the response's own
row are responses too. Empty table: no records. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import buffers, new_folder, table, text_slices, written

#: Least payload that is replaced by a revisit, date of the records, compressed bytes of a file, bytes handled at once.
LEAST_BYTES, DATE, FILE_BYTES, SLICE_BYTES = 100, "1970-01-01T00:00:00Z", 16 << 20, 8 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STAGED = "page_id long, url string, payload_bytes long, payload_digest string, crc long, packed binary"
_PARSED = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def staged(pages: DataFrame) -> DataFrame:
    """Digest, length, checksum and deflated bytes of every payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html", SLICE_BYTES):
                data, offsets = buffers(part.column(2))
                whole = data.tobytes()
                payloads = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                        pa.array([zlib.crc32(p) for p in payloads], pa.int64()), pa.array([zlib.compress(p, 4) for p in payloads], pa.binary()),
                    ],
                    names=[f.split()[0] for f in _STAGED.split(", ")],
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(run, _STAGED)


def write_store(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) as written below ``folder``: (digest, packed) and (page_id, record_type, refers_to, digest, header)."""
    packed = staged(pages)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    # digests are cheap to take again, so the deflated payloads are not kept a second time beside the store
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"),
    )
    same = (F.min("payload_bytes") == F.max("payload_bytes")) & (F.min("crc") == F.max("crc"))
    payloads = packed.groupBy("payload_digest").agg(F.first("packed").alias("packed"), same.alias("same")).select(
        F.col("payload_digest").alias("digest"),
        F.when(F.col("same"), F.col("packed")).otherwise(F.raise_error(F.lit("different payloads with one digest"))).alias("packed"),
    )
    firsts = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy(F.col("payload_digest").alias("first_digest")).agg(F.min("page_id").alias("first_id"))
    known = rows.select("page_id", "url", "payload_bytes", "payload_digest").join(
        firsts, F.col("payload_digest") == F.col("first_digest"), "left"
    )
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    known = known.select("*", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first_id")).alias("refers_to"))
    # control characters and blanks in an address would break the header's lines
    address = F.expr("regexp_replace(url, '[\\\\x00-\\\\x20\\\\x7F]', '%20')")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))

    def line(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", address), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    )
    headers = known.select("page_id", "record_type", "refers_to", F.col("payload_digest").alias("digest"), F.encode(header, "UTF-8").alias("header"))
    spark = pages.sparkSession
    for name, part in (("payloads", payloads), ("headers", headers)):
        part.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return tuple(
        spark.read.schema(part.schema).parquet(f"{folder}/{name}") for name, part in (("payloads", payloads), ("headers", headers))
    )


def records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """(header, packed) of every record; a revisit has no payload of its own."""
    whole = headers.where("record_type = 'response'").join(payloads, "digest").select("header", "packed")
    return whole.union(headers.where("record_type = 'revisit'").select("header", F.lit(None).cast("binary").alias("packed")))


def write_warc(whole: DataFrame, folder: str) -> DataFrame:
    """The manifest (path) of the ``.warc.gz`` files written below ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        target, root = fs.FileSystem.from_uri(folder)
        seq, out, size = 0, None, 0
        paths = []
        for batch in batches:
            for header, packed in zip(batch.column(0), batch.column(1)):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.warc.gz"
                    out, size, seq = target.open_output_stream(f"{root}/{name}", compression=None), 0, seq + 1
                    paths.append(f"{folder}/{name}")
                member = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = member.compress(header.as_py())
                if packed.is_valid:
                    data += member.compress(zlib.decompress(packed.as_py()))
                data += member.compress(b"\r\n\r\n") + member.flush()
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return written(whole.mapInArrow(run, "path string"), "warc-manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The records of a ``.warc.gz`` file, a gzip member each."""
    view = memoryview(data)
    at = 0
    while at < len(data):
        member, found = zlib.decompressobj(31), []
        while not member.eof:
            step = view[at : at + (1 << 16)]
            if not len(step):
                raise ValueError("an archive ends inside a record")
            found.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        yield b"".join(found)


def parse(record: bytes) -> tuple:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of a record; its lengths and digest are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/1.") or len(rest) != int(fields["Content-Length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a whole WARC record")
    _, _, payload = rest[:-4].partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    own, other = (None if x in (None, "none") else int(x) for x in (
        fields["WARC-Record-ID"][10:-1], fields["WARC-Refers-To"][10:-1] if "WARC-Refers-To" in fields else None))
    if fields["WARC-Type"] == "revisit":
        return own, "revisit", other, None, digest
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of page {own} does not match its digest")
    return own, "response", None, len(payload), digest


def read_warc(manifest: DataFrame) -> DataFrame:
    """A row per record; a revisit has the length and digest of the payload it refers to."""
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as file:
                    rows = [parse(record) for record in members(file.read())]
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _PARSED.split(", ")]
                )

    tasks = max(1, min(files, 16 * manifest.sparkSession.sparkContext.defaultParallelism))
    parsed = written(manifest.repartition(tasks).mapInArrow(run, _PARSED), "warc-parsed")
    responses = parsed.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("of")).agg(
        F.collect_set(F.struct("payload_bytes", "payload_digest")).alias("kept")  # one, or one per row of a repeated id
    )
    revisits = parsed.where("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("of"), "left")
    # only the payload under the revisit's own digest counts
    match = F.get(F.filter("kept", lambda k: k["payload_digest"] == F.col("payload_digest")), F.lit(0))
    revisits = revisits.select(
        "page_id", "record_type", "refers_to",
        F.when(match.isNotNull(), match["payload_bytes"]).otherwise(F.raise_error(F.lit("a revisit refers to no such payload")).cast("long")).alias("payload_bytes"),
        "payload_digest",
    )
    return parsed.where("record_type = 'response'").union(revisits)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    payloads, headers = write_store(table(spark, sf_dir, "pages"), folder)
    files = write_warc(records(payloads, headers), new_folder(spark, "warc-files"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, case when payload_bytes >= {LEAST_BYTES} then min(page_id) over (partition by payload_digest) end as first_id from p)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from f
"""

QUERIES: dict[str, tuple[Callable, str | None]] = {"op4_warc": (op4_warc, _SQL)}
