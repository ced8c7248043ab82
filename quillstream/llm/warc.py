"""WARC archives with revisit records and a two-level capture index.

Every page becomes a record, gzipped as a member of its own; a page whose payload another record holds becomes a revisit
record without payload. A record's block is an HTTP response, of a revisit only its header. Spark's text writer puts the
members into files, so any store that Spark reaches will do: the writer's line separator, a zero byte, supplies the last
byte of every member. (A gzip member ends with the high byte of its length, zero below 16 MiB; to a longer record an empty
member is added, which ends with zeros.) The files are plain .warc.gz content; the first of each task begins with a
warcinfo record.

The index has two levels. Reading the archives once, as streams, gives for every record its reversed-host key, file, offset
and length. These lines are sorted by key into blocks of `block_lines`, each compressed; a file of blocks ends with its
sparse directory, the first key and the byte range of each block, and that with the range of the directory. Only the first
and last key of every file, one row for each partition of the sort, come to the driver.

`lookup` takes keys to the files that can hold them by binary search among those, there to the blocks by binary search in
the directory, and in a block to its lines by binary search; blocks and records are read in their byte ranges, neighbours
together. No archive content is shuffled. Ranges are read through pyarrow's file systems (file, hdfs, s3, gs, abfs), as
Spark has no reader for them, so archives and index must lie where one of these reaches.

Equal payloads are found by their digest with an aggregate; the payload itself is never a key. The join that tells a page
of its group is a sort-merge join at every size: there is a row per group of equal payloads, which grows with the input,
so it is never broadcast; a hot payload is split by adaptive execution.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import map_batches, materialize, partitions, shared_path

#: Fixed value, as pages have no date of capture.
DATE = "2000-01-01T00:00:00Z"
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
_HEAD = re.compile(rb"(?s)^WARC/1\.1\r\n(.*?)\r\n\r\n")


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def uri(url: str) -> str:
    """A url as a header states it: without spaces and control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def surt(url: str | None) -> str:
    """Reversed-host key: com,example,www)/path?query, hosts in lower case. Urls without :// keep their text."""
    url = uri(url or "")
    m = re.match(r"(?s)[^:]*://([^/?#]*)(.*)", url)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2].partition('#')[0] or '/'}" if m else url


def packed(lines: list[str], block: bytes) -> bytes:
    """A gzipped record without its last byte, a zero."""
    raw = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    return (out if out[-1] == 0 else out + _EMPTY)[:-1]


def member(page_id: int | None, url: str | None, kind: str, digest: str, size: int, refers_to: int | None, payload: bytes, date: str = DATE) -> bytes:
    """A page's record."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return packed(lines, http + payload if kind == "response" else http)


def info(number: int, date: str = DATE) -> bytes:
    """The warcinfo record of a task's files."""
    return packed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:warcinfo:{number}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"software: quillstream\r\nformat: WARC file version 1.1\r\n")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's length is the one its header states."""
    m = _HEAD.match(raw)
    if not m:
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in m[1].decode("utf-8", "surrogatepass").split("\r\n"))
    n = int(headers["Content-Length"])
    block = raw[m.end() : m.end() + n]
    if len(block) != n or raw[m.end() + n :] != b"\r\n\r\n":
        raise ValueError("a record of another length than it states")
    return headers, block


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length of the payload as the HTTP header states it, and what follows the header."""
    header, _, payload = block.partition(b"\r\n\r\n")
    return int(re.search(rb"\r\nContent-Length: (\d+)", header)[1]), payload


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place on."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member of a file, read as a stream; an empty member belongs to the one before."""
    at, held, rest = 0, None, b""
    while True:
        z, raw, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            piece = rest or file.read(1 << 16)
            if not piece:
                if used:
                    raise ValueError("a member that doesn't end")
                break
            raw.append(z.decompress(piece))
            used += len(piece) - len(z.unused_data)
            rest = z.unused_data
        if not used:
            break
        data = b"".join(raw)
        if data:
            if held:
                yield held
            held = (at, used, data)
        elif held:
            held = (held[0], held[1] + used, held[2])
        at += used
    if held:
        yield held


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, begun = [], 0, False
        for batch in batches:
            for i, url, html, copies, last in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun:
                    out, begun = [info(TaskContext.get().partitionId() if TaskContext.get() else 0, date)], True
                payload = (html or "").encode()
                kind = "revisit" if copies is not None and i != last else "response"
                out.append(member(i, url, kind, b32(hashlib.sha1(payload).digest()), len(payload), last if kind == "revisit" else None, payload, date))
                held += len(out[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, file_records: int = 5000, date: str = DATE) -> None:
    """Write a record for each page. Of pages with equal payloads of at least `least` bytes, that with the largest id is a
    response and the others revisit it; smaller payloads are all responses. Null html is empty. Pages that share the
    largest id are responses all; a null id is smaller than any other. Records of null urls state no target. Further columns
    are not read; an empty table gives no records."""
    html = F.col(f"`{html_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")))
    groups = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least).groupBy(sha.alias("sha")).agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1 and last is not null")
    joined = rows.withColumn("sha", sha).join(groups.hint("merge"), "sha", "left").select("page_id", "url", "html", "copies", "last")
    records = map_batches(joined, _write(date), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", file_records).text(path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index lines of each archive file named."""
    kinds, names = [pa.string()] * 4 + [pa.int64()] * 2, ["key", "record", "kind", "file", "at", "n"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows: list[tuple] = []
            with opened(path) as file:
                for at, n, raw in members(file):
                    h, _ = parse(raw)
                    if h["WARC-Type"] != "warcinfo":
                        rows.append((surt(h.get("WARC-Target-URI")), h["WARC-Record-ID"], h["WARC-Type"], path, at, n))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


_ESCAPED = {"\\": "\\\\", "\t": "\\t", "\n": "\\n"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}


def squeezed(rows: list[tuple]) -> bytes:
    """Rows as a gzip member without its last byte, a zero."""
    text = "\n".join("\t".join(re.sub(r"[\\\t\n]", lambda m: _ESCAPED[m[0]], str(x)) for x in r) for r in rows)
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    out = z.compress(text.encode("utf-8", "surrogatepass")) + z.flush()
    return (out if out[-1] == 0 else out + _EMPTY)[:-1]


def unsqueezed(data: bytes) -> list[list[str]]:
    text = zlib.decompressobj(31).decompress(data).decode("utf-8", "surrogatepass")
    return [[re.sub(r"\\[\\tn]", lambda m: _PLAIN[m[0]], x) for x in line.split("\t")] for line in text.split("\n")]


def _blocks(lines: int):
    """Blocks of sorted lines; then the directory (first key, offset and length of each block, and the last key of all),
    and then its own offset and length in 40 digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        directory: list[tuple] = []
        at, last = 0, ""

        def out(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal at, last
            block = squeezed(rows)
            directory.append((rows[0][0], at, len(block) + 1))
            at, last = at + len(block) + 1, rows[-1][0]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["value"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= lines:
                yield out(held[:lines])
                held = held[lines:]
        if held:
            yield out(held)
        if directory:
            end = squeezed([*directory, (last, at, 0)])
            yield pa.RecordBatch.from_arrays([pa.array([end, f"{at:020d}{len(end) + 1:020d}".encode()], pa.binary())], names=["value"])

    return run


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files in a folder; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def write_index(spark: SparkSession, archives: str, path: str, block_lines: int = 300) -> None:
    """Index the archives: files apart by key, of compressed blocks of lines sorted by key, each with its directory. No
    archives give no files."""
    lines = materialize(map_batches(files_in(spark, archives).select("path"), _scan, "key string, record string, kind string, file string, at long, n long"), "lines")
    sorted_lines = lines.repartitionByRange(partitions(spark), "key", "file", "at").sortWithinPartitions("key", "file", "at")
    blocks = map_batches(sorted_lines, _blocks(block_lines), "value binary")
    blocks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def directory_of(file: pa.NativeFile) -> tuple[list[str], list[tuple[int, int]], str]:
    """First keys and ranges of an index file's blocks, and its last key."""
    end = file.size()
    file.seek(end - 41)
    at, n = (int(x) for x in re.fullmatch(rb"(\d{20})(\d{20})\x00", file.read(41)).groups())
    file.seek(at)
    *rows, (last, _, _) = unsqueezed(file.read(n))
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows], last


def _fences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if length:
                with opened(path) as file:
                    first, _, last = directory_of(file)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first[0], last, path)], names=["first", "last", "path"])


def holders(fences: list[tuple[str, str, str]], key: str) -> list[str]:
    """The index files (first key, last key, path; sorted) that can hold a key, by binary search."""
    i = bisect.bisect_right(fences, (key, "\U0010ffff")) - 1
    out = []
    while i >= 0 and fences[i][1] >= key:
        out.append(fences[i][2])
        i -= 1
    return out


def _dealt(fences: list[tuple[str, str, str]]):
    """Urls to their keys and the index files that can hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, p) for k in map(surt, batch.column(0).to_pylist()) for p in holders(fences, k)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows))], names=["key", "path"])

    return run


def find_lines(file: pa.NativeFile, keys: Iterator[str]) -> Iterator[list[str]]:
    """The lines of ascending keys in an index file: binary search in its directory, a range read of each block that can
    hold the key, binary search in the block."""
    first, ranges, _ = directory_of(file)
    now, lines, have = -1, [], []
    for key in keys:
        i = max(0, bisect.bisect_left(first, key) - 1)  # the block before the first that begins with the key may end with it
        while i < len(first) and first[i] <= key:
            if i != now:
                file.seek(ranges[i][0])
                now, lines = i, unsqueezed(file.read(ranges[i][1]))
                have = [x[0] for x in lines]
            yield from lines[bisect.bisect_left(have, key) : bisect.bisect_right(have, key)]
            i += 1


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of the records of (path of an index file, key), which are sorted."""
    from itertools import groupby

    rows = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    for path, group in groupby(rows, key=lambda r: r[0]):
        found: list[list[str]] = []

        def out() -> pa.RecordBatch:
            cols = [pa.array([x[3] for x in found]), pa.array([int(x[4]) for x in found], pa.int64()), pa.array([int(x[5]) for x in found], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(cols, names=["file", "at", "n"])

        with opened(path) as file:
            for line in find_lines(file, (k for _, k in group)):
                found.append(line)
                if len(found) == 1000:
                    yield out()
        if found:
            yield out()


#: Ranges of one file that lie so near one another are read at once, up to so many bytes.
GAP, AT_ONCE = 1 << 14, 1 << 22


def ranges_of(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, length, places within) of the reads that cover sorted places (offset, length)."""
    i = 0
    while i < len(places):
        at, end, j = places[i][0], sum(places[i]), i + 1
        while j < len(places) and places[j][0] <= end + GAP and sum(places[j]) - at <= AT_ONCE:
            end, j = max(end, sum(places[j])), j + 1
        yield at, end - at, places[i:j]
        i = j


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at the places (file, at, n), sorted by file and place, by range reads."""
    from itertools import groupby

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "kind", "digest", "size", "refers_to", "payload"]
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    for batch in batches:
        for path, group in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[0]):
            with opened(path) as file:
                for at, n, inside in ranges_of([(x[1], x[2]) for x in group]):
                    file.seek(at)
                    content, rows = file.read(n), []
                    for a, m in inside:
                        h, block = parse(zlib.decompressobj(31).decompress(content[a - at : a - at + m]))
                        size, payload = payload_of(block)
                        rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), size, number(h.get("WARC-Refers-To")), payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def lookup(spark: SparkSession, archives: str, index: str, urls: DataFrame | list[str]) -> DataFrame:
    """All records of the urls (a table with one column, or a list), each once: page_id, url (null if the record states
    none), kind, digest, size, refers_to, payload. Urls that no record has give none; null and empty urls share a key, that of
    records without a target; urls may repeat and differ in the case of the host and in what follows a #."""
    if isinstance(urls, list):
        urls = spark.createDataFrame([(u,) for u in urls], "url string")
    fences = sorted(tuple(r) for r in map_batches(files_in(spark, index), _fences, "first string, last string, path string").collect())
    wanted = map_batches(urls, _dealt(fences), "key string, path string").distinct()
    n = partitions(spark)
    places = map_batches(wanted.select("path", "key").repartition(n, "path").sortWithinPartitions("path", "key"), _search, "file string, at long, n long")
    dealt = places.repartition(n, "file").sortWithinPartitions("file", "at")
    return map_batches(dealt, _fetch, "page_id long, url string, kind string, digest string, size long, refers_to long, payload binary")


def round_trip(pages: DataFrame, url_col: str = "url", **columns) -> DataFrame:
    """Write the archives and their index to the shared folder and look all urls of pages up in them."""
    spark = pages.sparkSession
    archives, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    write_archives(pages, archives, url_col=url_col, **columns)
    write_index(spark, archives, index)
    return lookup(spark, archives, index, pages.select(F.col(f"`{url_col}`").cast("string").alias("url")))
