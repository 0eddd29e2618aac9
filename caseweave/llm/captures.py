"""Web archive files with a two-level capture index.

Every page becomes one gzip member of a WARC file; pages whose payload is already held by a
page with a smaller id become revisit records. The index sorts the captures by reversed-host
URL key and page id, cuts them into compressed blocks, and keeps a sparse directory with the
first key of each block. A lookup goes to the index part by the parts' first keys, to the
block by binary search in that part's directory, reads the block's byte range, searches it,
and then reads the record's byte range in its archive.

Archives and blocks are files in the shared folder, reached through the file system that the
folder's address names. A task writes under a name of its own; a file counts once its index
rows are committed, so a lost task leaves at most an unreferenced file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import materialise, scratch_path

LEAST_BYTES = 100
BLOCK_ROWS, PART_ROWS = 1_000, 50_000
MERGE_BYTES = 4_000_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, port, path and query: ``com,example,www)/path?query``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + re.sub(r"^(file:)?/*", "/", folder)
    return pafs.FileSystem.from_uri(folder)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    body = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")

    def page(name: str) -> int | None:
        digits = fields.get(name, "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    kind = fields["WARC-Type"]
    if kind == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return page("WARC-Record-ID"), size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, page("WARC-Refers-To")
    return page("WARC-Record-ID"), len(payload), hashlib.sha256(payload).hexdigest(), kind, None


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): a revisit refers to the smallest page with its payload."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    long = rows.where(F.octet_length("html") >= LEAST_BYTES)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    later = long.select("page_id", "digest").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    later = materialise(later.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to")), "revisits")
    return rows.join(later, rows["page_id"].eqNullSafe(later["r_page"]) & (rows["digest"] == later["r_digest"]), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task; (key, page_id, row, file, offset, length) of every record."""

    def run(batches):
        fs, root = opened(folder)
        name, at, row = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        out = None
        for batch in batches:
            found = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(record(page_id, url, html.encode(), digest, refers_to))
                out.write(member)
                found.append((url_key(url), page_id, row, name, at, len(member)))
                at, row = at + len(member), row + 1
            cols = list(zip(*found)) if found else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["key", "page_id", "row", "file", "offset", "length"])
        if out is not None:
            out.close()

    return with_roles(pages).mapInArrow(run, "key string, page_id long, row long, file string, offset long, length long")


def capture_id(page_id, file: str, row: int) -> list:
    """Sorts captures of one key: null ids first, then by id, file and row."""
    return [-1 if page_id is None else 0, page_id or 0, file, row]


def write_index(captures: DataFrame, folder: str, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Sorts the captures into compressed blocks; (part, first, file, offset, length) of each block."""
    parts = max(1, -(-captures.count() // part_rows))
    order = ["key", "page_id", "file", "row"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        fs, root = opened(folder)
        name, at, held, part = f"{uuid.uuid4().hex}.idx", 0, [], 0
        out = None
        directory: list[tuple] = []

        def flush():
            nonlocal at, held, out
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            block = zlib.compress("\n".join(held).encode())
            out.write(block)
            directory.append((part, json.dumps(json.loads(held[0])[0]), name, at, len(block)))
            at, held = at + len(block), []

        for batch in batches:
            for key, page_id, row, file, offset, length, part in zip(*(batch.column(i).to_pylist() for i in range(7))):
                held.append(json.dumps([[key, *capture_id(page_id, file, row)], page_id, file, offset, length]))
                if len(held) >= block_rows:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        cols = list(zip(*directory)) if directory else [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["part", "first", "file", "offset", "length"])

    return ranged.select("key", "page_id", "row", "file", "offset", "length", "part").mapInArrow(run, "part int, first string, file string, offset long, length long")


def lookup(requests: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(page_id, file, offset, length) of the captures that ``requests`` (key, page_id) name.

    A request finds every capture of its key and id. The parts' first keys, one per part of
    the index, travel with the plan; each part's directory meets its requests in one group.
    """
    firsts = sorted((json.loads(r["first"]), r["part"]) for r in directory.groupBy("part").agg(F.min_by("first", "offset").alias("first")).collect())
    heads, parts = [f for f, _ in firsts], [p for _, p in firsts]

    def low(key, page_id):
        return [key or "", *(capture_id(page_id, "", -1))]

    def route(batches):
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist()):
                want = low(key, page_id)
                at = max(0, bisect_right(heads, want) - 1)
                # captures of one page may go on in the next part
                while at < len(parts) and (heads[at] <= want or heads[at][:3] == want[:3]):
                    rows.append((parts[at], key, page_id))
                    at += 1
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int32(), pa.string(), pa.int64()])], ["part", "key", "page_id"])

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        fs, root = opened(folder)
        entries = sorted((json.loads(f), n, o, s) for f, n, o, s in zip(*(known.column(c).to_pylist() for c in ("first", "file", "offset", "length"))))
        firsts_here = [e[0] for e in entries]
        files: dict[str, object] = {}
        blocks: OrderedDict[int, list] = OrderedDict()

        def block(i: int) -> list:
            if i not in blocks:
                _, name, offset, size = entries[i]
                if name not in files:
                    files[name] = fs.open_input_file(f"{root}/{name}")
                files[name].seek(offset)
                blocks[i] = [json.loads(line) for line in zlib.decompress(files[name].read(size)).decode().split("\n")]
                if len(blocks) > 16:
                    blocks.popitem(last=False)
            return blocks[i]

        found = []
        wants = sorted({(k or "", *capture_id(p, "", -1)) for k, p in zip(asked.column("key").to_pylist(), asked.column("page_id").to_pylist())})
        for want in map(list, wants):
            i = max(0, bisect_right(firsts_here, want) - 1)
            while i < len(entries) and (firsts_here[i] <= want or firsts_here[i][:3] == want[:3]):
                lines = block(i)
                j = bisect_right(lines, want, key=lambda line: line[0])
                while j < len(lines) and lines[j][0][:3] == want[:3]:
                    found.append(lines[j][1:])
                    j += 1
                i += 1
        for f in files.values():
            f.close()
        cols = list(zip(*found)) if found else [[]] * 4
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("page_id", "file", "offset", "length"), cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))})

    routed = requests.select("key", "page_id").mapInArrow(route, "part int, key string, page_id long")
    return routed.groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(search, "page_id long, file string, offset long, length long")


def read_records(located: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from ranges of the archives."""

    def run(batches):
        fs, root = opened(folder)
        name, file = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            found, i = [], 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lengths[i]
                # neighbouring records are fetched by one read
                while j < len(files) and files[j] == files[i] and offsets[j] <= end + 65_536 and offsets[j] + lengths[j] - offsets[i] <= MERGE_BYTES:
                    end, j = max(end, offsets[j] + lengths[j]), j + 1
                if files[i] != name:
                    if file is not None:
                        file.close()
                    name, file = files[i], fs.open_input_file(f"{root}/{files[i]}")
                file.seek(offsets[i])
                data = file.read(end - offsets[i])
                for k in range(i, j):
                    at = offsets[k] - offsets[i]
                    found.append(parsed(zlib.decompress(data[at : at + lengths[k]], 31)))
                i = j
            cols = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file is not None:
            file.close()

    near = located.repartition("file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of every page: the requests that read all of them back."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["key", "page_id"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").mapInArrow(run, "key string, page_id long").distinct()


def archived(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` and reads every page back through the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per input row.
    Payloads of at least 100 bytes that occur at several pages are held once, by the smallest
    page_id; a null html is an empty payload, a null url has the empty key. Rows repeated with
    the smallest page_id are responses each; a row with a null page_id is a revisit if any page
    with an id holds its payload. An empty table gives an empty result; other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    captures = materialise(write_archives(pages, folder), "captures")
    directory = materialise(write_index(captures, folder), "directory")
    located = lookup(keys(pages), directory, folder)
    return read_records(located, folder)
