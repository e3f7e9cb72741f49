"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.common import settle
from jobtide.streaming.sinks import shared_folder

#: Payloads below this size are always stored in full.
MIN_REVISIT_BYTES = 0
#: Records of one archive and lines of one index block at most.
ARCHIVE_RECORDS, BLOCK_LINES = 4_000, 1_000
_CHUNK = 1 << 18

#: A gzip member without content. The text writer puts it behind each record, as it wants a separator:
#: an archive then is a plain series of gzip members, which every WARC reader takes.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000") + bytes(4)

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Bare upper-case base32 of a digest of 40 hex digits, by built-in functions: five bytes are eight letters."""
    letters = []
    for five in range(4):
        value = F.conv(F.substring(digest, 10 * five + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then port, path and query; scheme, user and fragment go. Null gives ``)/``."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/:?]*)", 1))
    port = F.regexp_extract(rest, r"^[^/:?]*(:[0-9]*)", 1)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path)


def _record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response, or a revisit where ``payload`` is None."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {url} {digest}")
    kind = "revisit" if payload is None else "response"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "WARC/1.1\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for every row into gzip archives below ``folder``. Of equal payloads of at least ``min_revisit`` bytes
    the one with the largest id is stored, the others revisit it; rows that repeat that id are stored too. The files
    come from Spark's own writer, so a repeated task leaves no half archives."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("hex"))
    first = rows.groupBy("hex").agg(F.max("page").alias("stored"))
    joined = rows.join(first, "hex").withColumn("digest", base32_of_hex(F.col("hex")))
    revisit = (F.col("size") >= min_revisit) & ~F.col("page").eqNullSafe(F.col("stored"))
    joined = joined.select("page", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("stored")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                records = [_record(*row, date) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.record_batch([pa.array(records, pa.binary())], ["value"])

    packed = joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(folder)


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of each gzip member with content, read in chunks."""
    at, pending = 0, b""
    while True:
        pending = pending or file.read(_CHUNK)
        if not pending:
            return
        unpack, begin, parts = zlib.decompressobj(31), at, []
        while not unpack.eof:
            if not pending:
                pending = file.read(_CHUNK)
                if not pending:
                    raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(pending))
            at += len(pending) - len(unpack.unused_data)
            pending = unpack.unused_data
        content = b"".join(parts)
        if content:
            yield begin, at - begin, content


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block; the block's length is what the header says, whatever it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _open(path: str):
    """A file for range reads in a task, from whatever store the path names."""
    store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return store.open_input_file(name)


def _url(fields: dict[str, str]) -> str | None:
    url = fields.get("WARC-Target-URI")
    return None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


_LINES = "page long, url string, path string, offset long, length long"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``, found by reading them: page, URL, path, offset, length."""
    paths = spark.read.format("binaryFile").load(folder).select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    found = []
                    for offset, length, raw in members(file):
                        fields, _ = parse_record(raw)
                        found.append((_number(fields.get("X-Page-ID")), _url(fields), path, offset, length))
                if found:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["page", "url", "path", "offset", "length"])

    many = max(spark.sparkContext.defaultParallelism, 1)
    return paths.repartition(many, "path").mapInArrow(scan, _LINES)


_NO_PAGE = -(1 << 63)


def build_index(spark: SparkSession, archives: str, index: str, block_lines: int = BLOCK_LINES) -> None:
    """Writes the index of the archives: lines sorted by reversed-host key and page, range-partitioned into shards, cut into
    compressed blocks of ``block_lines``. A block row also has its shard and first key, which make up the sparse directory.
    Captures of one URL may fill many blocks and shards, as the page is part of the order."""
    lines = read_lines(spark, archives).select(surt(F.col("url")).alias("key"), F.coalesce("page", F.lit(_NO_PAGE)).alias("page"), "path", "offset", "length")
    ordered = lines.repartitionByRange("key", "page", "path", "offset").sortWithinPartitions("key", "page", "path", "offset")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pending = TaskContext.get().partitionId(), []

        def pack(rows: list) -> pa.RecordBatch:
            text = "\n".join("\t".join((k.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n"), str(p), f, str(o), str(n))) for k, p, f, o, n in rows)
            cols = [pa.array([shard], "int32"), pa.array([rows[0][0]]), pa.array([rows[0][1]], "int64"), pa.array([zlib.compress(text.encode())], pa.binary())]
            return pa.record_batch(cols, ["shard", "first_key", "first_page", "lines"])

        for batch in batches:
            pending += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(pending) >= block_lines:
                yield pack(pending[:block_lines])
                del pending[:block_lines]
        if pending:
            yield pack(pending)

    ordered.mapInArrow(block, "shard int, first_key string, first_page long, lines binary").write.parquet(index)


_ESCAPES = {"\\\\": "\\", "\\t": "\t", "\\n": "\n"}
_ESCAPED = re.compile(r"\\[\\tn]")


def _block_lines(data: bytes) -> list[tuple[tuple[bytes, int], str, int, int]]:
    out = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, page, path, offset, length = line.split("\t")
        key = _ESCAPED.sub(lambda m: _ESCAPES[m.group()], key)
        out.append(((key.encode(), int(page)), path, int(offset), int(length)))
    return out


def lookup(spark: SparkSession, index: str, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Places of the captures that ``wanted`` names by page and URL: ``page``, ``path``, ``offset``, ``length``.

    Two binary searches: the first keys of the shards, of which there are as many as partitions, give the shard; inside it,
    the first keys of its blocks give the blocks, and only these are unpacked. Pairs asked for twice count once;
    pairs without a capture give no row.
    """
    blocks = spark.read.schema("shard int, first_key string, first_page long, lines binary").parquet(index)
    tops = blocks.groupBy("shard").agg(F.min(F.struct(F.col("first_key").cast("binary").alias("k"), F.col("first_page").alias("p"))).alias("first")).collect()
    tops = sorted(((bytes(r["first"]["k"]), r["first"]["p"]), r["shard"]) for r in tops)
    firsts = [t[0] for t in tops]
    keys = wanted.select(surt(F.col(url_col)).alias("key"), F.coalesce(F.col(id_col), F.lit(_NO_PAGE)).alias("page")).distinct()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pair = (key.encode(), page)
                last = bisect_right(firsts, pair) - 1
                # Captures that share page and URL may go on over several shards.
                while last >= 0:
                    rows.append((tops[last][1], key, page))
                    if firsts[last] != pair:
                        break
                    last -= 1
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], ["shard", "key", "page"])

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        order = sorted(zip(((k.encode(), p) for k, p in zip(held["first_key"].to_pylist(), held["first_page"].to_pylist(), strict=True)), held["lines"], strict=True), key=lambda b: b[0])
        begin, found = [b[0] for b in order], []
        by_block: dict[int, set] = {}
        for pair in zip((k.encode() for k in asked["key"].to_pylist()), asked["page"].to_pylist(), strict=True):
            at = bisect_right(begin, pair) - 1
            while at >= 0:
                by_block.setdefault(at, set()).add(pair)
                if begin[at] != pair:
                    break
                at -= 1
        for at, pairs in by_block.items():
            found += [(pair[1], path, offset, length) for pair, path, offset, length in _block_lines(order[at][1].as_py()) if pair in pairs]
        cols = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page", "path", "offset", "length"])

    placed = keys.mapInArrow(place, "shard int, key string, page long")
    return placed.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(search, "page long, path string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """The records at the given places: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``,
    ``payload`` (null for revisits). Only the named ranges are read; a stored payload's size and digest are those of its bytes, and
    an archive whose bytes do not fit its header is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = []
                for name, offset, length in zip(*(c.to_pylist() for c in batch.slice(begin, 256).columns), strict=True):
                    if name != path:
                        if file is not None:
                            file.close()
                        path, file = name, _open(name)
                    file.seek(offset)
                    fields, block = parse_record(zlib.decompress(file.read(length), 31))
                    digest, size, payload = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"]), None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (own, len(payload)) != (digest, size):
                            raise ValueError(f"{name} at {offset}: payload and header differ")
                    rows.append((_number(fields.get("X-Page-ID")), _url(fields), size, digest, fields["WARC-Type"], _number(fields.get("X-Refers-To-Page-ID")), payload))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if file is not None:
            file.close()

    near = places.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return near.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(df: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes ``df`` (``page_id``, ``url``, ``html``) as archives in the shared folder, indexes them, looks every page up and reads its record.

    A null html is an empty payload; null pages and URLs keep their record. Rows that repeat page and URL give as many
    records; an empty table gives no rows; payloads and URLs may have any length and characters; other columns are ignored,
    whatever their names. An index that gives another number of captures than there are rows is an error.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    write_archives(df, f"{folder}/archives", min_revisit=min_revisit)
    build_index(spark, f"{folder}/archives", f"{folder}/index")
    places = settle(lookup(spark, f"{folder}/index", df))
    found, rows = places.count(), df.count()
    if found != rows:
        raise ValueError(f"the index gave {found} captures for {rows} rows")
    return read_records(places)
