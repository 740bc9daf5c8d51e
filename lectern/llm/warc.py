"""WARC archives: writing them as one gzip stream each, normalising them, reading them by offset.

``write_monolithic`` writes one archive for each Spark partition, the whole file one gzip stream, as
many crawls come. ``normalise`` inflates such a stream once, in pieces, and rewrites every record as
a gzip member of its own, with a sidecar index of offsets. ``read_records`` reads members by the
index. No step holds more than one record. Files are written under a name of the task's own and
renamed, so a task that runs again replaces its file whole; they go to the folder given, by
``pyarrow.fs``, which opens local, HDFS, S3 and GCS paths.

Equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the record of the smallest page id
is a response, others are revisit records that refer to it.

Defined results: a null payload is an empty one; payloads under the limit are always responses; of
equal payloads all rows with the smallest id are responses; a null page id comes after all others and
refers to them, and is a response if there are none; an empty table gives no archive and an empty result; null or odd URLs
are percent-encoded; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, qualified, table, work_dir

REVISIT_BYTES = 100
#: The time that records carry, so that reruns agree, and the revisit profile.
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
LEVEL = 3


def _name_of(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def format_record(row: dict) -> bytes:
    """One record: WARC headers, an HTTP head, and the payload unless it is a revisit."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{_name_of(row['page_id'])}>",
        f"WARC-Target-URI: {quote(row['url'] or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_name_of(row['refers_to'])}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordReader:
    """Records from a stream of bytes, one at a time: headers, block, and the raw bytes of both."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _fill(self, size: int) -> bool:
        while len(self.held) < size:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def __iter__(self):
        while True:
            end, seen = -1, 0
            while end < 0:
                end = self.held.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(self.held)
                if end < 0 and not self._fill(seen + 1):
                    if self.held.strip():
                        raise ValueError("the archive ends within a record's headers")
                    return
            lines = bytes(self.held[:end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = end + 4 + int(headers["content-length"]) + 4
            if not self._fill(size):
                raise ValueError("the archive ends within a record")
            raw = bytes(self.held[:size])
            del self.held[:size]
            yield headers, raw[end + 4 : -4], raw


def inflated(stream, members: bool = True) -> Iterator[bytes]:
    """The bytes of a gzip stream in pieces, of all its members."""
    gz = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if out := gz.decompress(data, PIECE):
                yield out
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz = gz.unused_data, zlib.decompressobj(31)


def _open_dir(path: str):
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    return files, root


def _replace(files, root: str, name: str, write) -> None:
    """``write`` a file under a name of its own and rename it to ``name``."""
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    if files.get_file_info(f"{root}/{name}").type != FileType.NotFound:  # of a task that ran before; some stores don't move onto it
        files.delete_file(f"{root}/{name}")
    files.move(own, f"{root}/{name}")


def _rows(batches) -> Iterator[dict]:
    for big in batches:
        for at in range(0, big.num_rows, 64):
            yield from big.slice(at, 64).to_pylist()


def _write(batches, folder: str):
    from pyspark import TaskContext

    rows = _rows(batches)
    first = next(rows, None)
    if first is None:
        return
    files, root = _open_dir(folder)
    name, count = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0

    def write(out):
        nonlocal count
        gz, row = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), first
        while row is not None:
            out.write(gz.compress(format_record(row)))
            count, row = count + 1, next(rows, None)
        out.write(gz.flush())

    _replace(files, root, name, write)
    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})


def _normalise(batches, source: str, target: str):
    for row in _rows(batches):
        files, root = _open_dir(source)
        to_files, to_root = _open_dir(target)
        index: list[tuple[int, int]] = []

        def write(out):
            at = 0
            with files.open_input_stream(f"{root}/{row['archive']}", compression=None) as stream:
                for _, _, raw in RecordReader(inflated(stream)):
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = gz.compress(raw) + gz.flush()
                    out.write(member)
                    index.append((at, len(member)))
                    at += len(member)

        _replace(to_files, to_root, row["archive"], write)
        lines = "".join(f"{a}\t{n}\n" for a, n in index).encode()
        _replace(to_files, to_root, row["archive"] + ".idx", lambda out: out.write(lines))
        yield pa.RecordBatch.from_pydict({"archive": [row["archive"]], "records": [len(index)]})


READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
    "archive string, member_offset long, member_length long, intact boolean"
)


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def _read(batches, folder: str):
    for row in _rows(batches):
        files, root = _open_dir(folder)
        with files.open_input_stream(f"{root}/{row['archive']}.idx", compression=None) as f:
            index = [tuple(map(int, x.split("\t"))) for x in f.read().decode().splitlines()]
        out = []
        with files.open_input_file(f"{root}/{row['archive']}") as archive:
            for at, size in index:
                member = archive.read_at(size, at)
                ((headers, block, _),) = RecordReader(inflated(io.BytesIO(member)))
                payload = block.partition(b"\r\n\r\n")[2]
                digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                whole = int(headers["x-payload-length"])
                intact = kind == "revisit" or (hashlib.sha256(payload).hexdigest(), len(payload)) == (digest, whole)
                out.append((
                    _page(headers["warc-record-id"]), whole, digest, kind, _page(headers.get("warc-refers-to")),
                    headers["warc-target-uri"], row["archive"], at, size, intact,
                ))
                if len(out) == 1024:
                    yield _read_batch(out)
                    out = []
        yield _read_batch(out)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in READ.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[x.strip().split(" ")[1]] for x in READ.split(",")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def plan_records(pages: DataFrame, revisit_bytes=REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its digest and length, ``record_type`` and ``refers_to``.

    Which payloads occur again is found on digests alone; only those digests meet the payloads, by a
    join that Spark broadcasts or, if they are many, shuffles and splits where hot.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("payload_bytes"))
    again = materialize(
        rows.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
        .where("n > 1 and first_page is not null")
        .select(F.col("digest").alias("again"), "first_page"),
        "payloads",
    )
    revisit = F.col("again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return rows.join(again, F.col("digest") == F.col("again"), "left").select(
        "page_id", "url", "payload", "digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each partition; returns the written ``archive`` names and ``records``."""
    folder = qualified(records.sparkSession, folder)
    return materialize(arrow_map(records, _write, "archive string, records long", folder=folder), "archives")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``source`` as one member for each record, with an index, in ``target``."""
    n = max(1, archives.count())
    source, target = (qualified(archives.sparkSession, x) for x in (source, target))
    spread = archives.repartition(n)
    return materialize(arrow_map(spread, _normalise, "archive string, records long", source=source, target=target), "normalised")


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """Records of normalised archives, read member by member by their index."""
    folder = qualified(archives.sparkSession, folder)
    return arrow_map(archives.repartition(max(1, archives.count())), _read, READ, folder=folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_monolithic(plan_records(table(spark, sf_dir, "pages")), f"{base}/whole")
    members = normalise(archives, f"{base}/whole", f"{base}/members")
    return read_records(members, f"{base}/members").drop("url", "archive", "member_offset", "member_length")


QUERIES = {"op10_warc": op10_warc}
ORACLES = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to, true AS intact
FROM f"""
}
