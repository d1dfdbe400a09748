"""WARC archives: one gzip member a record, written from a table and read back sequentially.

Writing: records of equal payload are found by their SHA-1 in one aggregation;
the one with the smallest id is a ``response``, the others are ``revisit`` records
that refer to it and carry headers only. Every task streams its rows into
archives of bounded size in the shared folder. A file name holds the task's
attempt, and only files in the written manifest are read, so tasks that ran
twice or were lost do no harm.

Reading: an archive is read in pieces; each gzip member is inflated as it
comes, the header block ends at the first empty line, ``Content-Length`` frames
the block, and the block's digest and the payload's are worked out on the way
and compared with those in the header. Memory doesn't grow with the archive.

Edge cases: a NULL html is an empty payload, a NULL url leaves out the target.
Where the smallest id of equal payloads occurs in several rows, all of these
are responses. A NULL id is last: its row revisits the smallest id there is,
and if there is none, all such rows are responses. An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowseg.functions.tables import materialize, scratch_path

ARCHIVE_BYTES = 64_000_000
PIECE = 1 << 18
DATE = "2000-01-01T00:00:00Z"  #: records come from a table without times
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean"


class BadArchive(ValueError):
    """An archive that isn't framed as it should be."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _target(url: str) -> str:
    """The URL in printable ASCII; other bytes are percent-encoded."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which tells the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _page_uri(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _target(url))] if url is not None else []),
        *([("WARC-Refers-To", _page_uri(refers_to)), ("WARC-Profile", REVISIT)] if revisit else []),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    coder = zlib.compressobj(wbits=31)
    return coder.compress(head.encode() + block + b"\r\n\r\n") + coder.flush()


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], int, str, bool]]:
    """For each record: its fields, the HTTP fields, payload bytes, payload SHA-1, and whether both digests hold.

    ``stream`` has read(n). Only the header of a record is held; its block passes through.
    """
    waiting = b""
    while True:
        waiting = waiting or stream.read(PIECE)
        if not waiting:
            return
        inflater, held, ended = zlib.decompressobj(wbits=31), b"", False

        def more() -> bytes:
            """Next bytes of this member; empty at its end."""
            nonlocal waiting, ended
            while not ended:
                if not waiting:
                    waiting = stream.read(PIECE)
                    if not waiting:
                        raise BadArchive("the archive ends within a member")
                try:
                    got = inflater.decompress(waiting, PIECE)
                except zlib.error as e:
                    raise BadArchive(str(e)) from e
                waiting, ended = inflater.unconsumed_tail, inflater.eof
                if ended:
                    waiting = inflater.unused_data
                if got:
                    return got
            return b""

        def until_empty_line(held: bytes) -> tuple[bytes, bytes]:
            while (at := held.find(b"\r\n\r\n")) < 0:
                got = more()
                if not got:
                    raise BadArchive("a record ends within its header")
                held += got
            return held[:at], held[at + 4 :]

        head, held = until_empty_line(held)
        if not head.startswith(b"WARC/"):
            raise BadArchive("a member doesn't start with a WARC header")
        fields = _fields(head)
        left = int(fields["content-length"])
        block, payload, size, http_head = hashlib.sha1(), hashlib.sha1(), 0, b""
        in_payload = False
        while left:
            held = held or more()
            if not held:
                raise BadArchive("a block is shorter than its Content-Length")
            part, held = held[:left], held[left:]
            left -= len(part)
            block.update(part)
            if not in_payload:
                http_head += part
                at = http_head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                in_payload, part, http_head = True, http_head[at + 4 :], http_head[:at]
            payload.update(part)
            size += len(part)
        while got := more():
            held += got
        if held != b"\r\n\r\n":
            raise BadArchive("a record doesn't end after its block")
        digest = base64.b32encode(payload.digest()).decode()
        block_ok = fields.get("warc-block-digest") == "sha1:" + base64.b32encode(block.digest()).decode()
        payload_ok = fields["warc-type"] == "revisit" or fields.get("warc-payload-digest") == "sha1:" + digest
        yield fields, _fields(http_head), size, digest, block_ok and payload_ok


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``first`` (the response's id, NULL for a response) to page_id, url, html.

    Only payloads that occur more than once, and their smallest ids, are joined
    to the pages; that table is written first, so Spark sees its size and
    broadcasts it only below its threshold.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    long_enough = F.octet_length("html") >= min_bytes
    repeated = materialize(
        rows.filter(long_enough).groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1 AND first IS NOT NULL").drop("n")
    )
    keyed = rows.withColumn("digest", F.when(long_enough, digest))
    joined = keyed if repeated.isEmpty() else keyed.join(repeated, "digest", "left")
    first = F.when(F.col("page_id").eqNullSafe(F.col("first")), F.lit(None)).otherwise(F.col("first")) if joined is not keyed else F.lit(None)
    return joined.select("page_id", "url", "html", first.cast("long").alias("first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below ``folder`` (a URI or path that all executors reach); returns the manifest, already written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, out, done = TaskContext.get(), None, []
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for rows in batches:
            for page_id, url, html, first in zip(rows["page_id"], rows["url"], rows["html"], rows["first"]):
                if out is None or written >= archive_bytes:
                    if out is not None:
                        out.close()
                        done.append((name, count, written))
                    name = f"{root}/pages-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.warc.gz"
                    out, count, written = store.open_output_stream(name, compression=None), 0, 0
                to = None if pd.isna(first) else int(first)
                data = record(None if pd.isna(page_id) else int(page_id), url, html.encode(), to, to is not None)
                out.write(data)
                count, written = count + 1, written + len(data)
        if out is not None:
            out.close()
            done.append((name, count, written))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return materialize(with_revisits(pages, min_bytes).mapInPandas(write, MANIFEST))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives in the manifest; a task reads whole archives, one after the other."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for files in batches:
            for path in files["path"]:
                made = []
                with store.open_input_stream(path, compression=None) as stream:
                    for fields, http, size, digest, good in read_records(stream):
                        kind = fields["warc-type"]
                        to = _page_id(fields["warc-refers-to"]) if kind == "revisit" else None
                        if kind == "revisit":  # both of the full payload, which the referred record holds
                            size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                        made.append((_page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, to, size, digest, good))
                        if len(made) >= 10_000:
                            yield _frame(made, columns)
                            made = []
                yield _frame(made, columns)

    files = manifest.count()
    return manifest.select("path").repartition(max(1, files)).mapInPandas(read, RECORD)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    uri = folder if ":" in folder else f"file://{folder}"
    return read_archives(write_archives(pages, uri, min_bytes), uri)
