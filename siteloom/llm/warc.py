"""WARC archives of pages, a two-level capture index over them, and reads through it.

Archives are compressed WARC 1.1 files: one gzip member per record. Spark's own text writer puts
them in place, with an empty gzip member as its line end, so a lost task is repeated and nothing is written past
its commit. The index sorts reversed-host URL keys into
compressed blocks and keeps one directory line per block (the begin of its first key); a lookup finds the
blocks by binary search in the directory, the lines by binary search in the block, and then
reads the named byte ranges of the archives. Blocks grow with the index, so the directory has at most about
``DIRECTORY_LINES`` lines and can be handed to every task; keys, index lines and ranges are shuffled, archives are not.

Among records whose payloads are equal and at least ``min_bytes`` long, the one with the
smallest page id is the response; the others are revisits without a payload.

Files hold ``FILE_BYTES`` and what the last record adds, so the largest page bounds them.

Defined cases: a null html is the empty payload; a null url has the key "" and no target line;
pages with equal url keep one index line each; rows with the same page id are written each and judged
by their own payload; a page with a null id is a response and its id is written as "-".
Extra columns are ignored. An empty table gives an empty archive, index and result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, small_batches

#: Least number of lines of an index block; blocks are larger where the directory would exceed its bound.
BLOCK_LINES = 2048
#: Bounds of the directory: its lines (one more for each write task at most) and the characters of a key in it.
DIRECTORY_LINES, DIRECTORY_KEY = 65536, 256
#: Bytes after which an archive file is closed: bounds what a task holds of it.
FILE_BYTES = 1 << 25
#: Neighbouring ranges are read at once up to so many bytes; a task is meant to read TASK_BYTES.
RUN_BYTES, TASK_BYTES = 1 << 22, 1 << 27
END = b"\r\n\r\n"
LEVEL = 3
#: A gzip member without content; it parts the records in a file.
GAP = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: Bytes of an archive given to the decompressor at a time.
FEED = 1 << 16
#: Fixed value: the profile of revisits that share a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ENTRY = "url_key string, page_id long, file string, at long, size long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def target(url: str) -> str:
    """A URL as the header line of a record carries it."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def url_key(url: str | None) -> str:
    """Reversed-host sort key: com,example,www)/path?query in lower case."""
    if not url:
        return ""
    url = target(url).replace("\t", "%09")
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return (key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    name = "-" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if url:
        head.append("WARC-Target-URI: " + target(url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + payload + END) + packer.flush()


def members(data: bytes):
    """(start, end, content) of each gzip member of an archive that has content."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, parts, opener = at, [], zlib.decompressobj(31)
        while not opener.eof:
            if at >= len(data):
                raise ValueError(f"the member at byte {start} is cut off")
            piece = view[at:at + FEED]
            parts.append(opener.decompress(piece))
            at += len(piece) - len(opener.unused_data)
        if any(parts):
            yield start, at, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    if data[:5] != b"WARC/":
        raise ValueError("not a record")
    stop = data.index(END)
    lines = data[:stop].decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    begin = stop + len(END)
    return fields, data[begin:begin + int(fields["content-length"])]


def _page(urn: str | None):
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write all pages as WARC files under ``path``."""
    pages = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # The digest alone is shuffled; only pages that have a twin are joined back.
    marks = materialise(pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length(body).alias("n")).where(f"n >= {int(min_bytes)}"), "warc_digests")
    first = marks.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    twins = materialise(
        marks.join(first.select("sha", "n", "first"), ["sha", "n"]).where("page_id <> first").select("page_id", "sha", "first").distinct(), "warc_twins")
    todo = pages.withColumn("sha", F.sha1(body)).join(twins, ["page_id", "sha"], "left")

    def build(batches):
        written = 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")}
            rows = [record(p, u, (h or "").encode("utf-8", "surrogatepass"), f) for p, u, h, f in zip(*cols.values())]
            ends = written + np.cumsum([len(r) + len(GAP) for r in rows], dtype=np.int64)
            begins = np.concatenate([[written], ends[:-1]])
            written = int(ends[-1]) if rows else written
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(begins // FILE_BYTES, pa.int64())], names=["value", "part"])

    out = todo.mapInArrow(build, "value binary, part long").select(F.col("value").cast("string"), "part")
    # Latin-1 maps the characters of the line end to the same bytes. Each task writes a file for each of its parts.
    out.write.option("encoding", "ISO-8859-1").option("lineSep", GAP.decode("latin-1")).partitionBy("part").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole archive files, one row each; FILE_BYTES bounds their size."""
    return small_batches(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives, in the layout :data:`ENTRY`."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, rows = data.as_py(), []
                for start, end, content in members(data):
                    f, _ = parse(content)
                    rows.append({
                        "url_key": url_key(f.get("warc-target-uri")), "page_id": _page(f["warc-record-id"]), "file": file, "at": start,
                        "size": end - start, "record_type": f["warc-type"], "refers_to": _page(f.get("warc-refers-to")),
                        "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(f["x-payload-length"])})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return _files(spark, path).mapInArrow(run, ENTRY)


_SCHEMA = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.strip().split(" ") for x in ENTRY.split(","))])


def write_index(entries: DataFrame, path: str) -> None:
    """Blocks of sorted compressed lines under ``path``/blocks and their directory under ``path``/directory."""
    order = ["url_key", "page_id", "file", "at"]
    entries = materialise(entries, "warc_entries")
    size = max(BLOCK_LINES, -(-entries.count() // DIRECTORY_LINES))

    def pack(batches):
        def block(lines):
            data = "\n".join(line for _, line in lines).encode()
            return {"first_key": lines[0][0][:DIRECTORY_KEY], "lines": len(lines), "block": zlib.compress(data, 6)}

        held = []
        for batch in batches:
            for r in batch.to_pylist():
                held.append((r["url_key"], "\t".join("-" if r[c] is None else str(r[c]) for c in _SCHEMA.names)))
            while len(held) >= size:
                yield pa.RecordBatch.from_pylist([block(held[:size])], schema=_BLOCK)
                held = held[size:]
        if held:
            yield pa.RecordBatch.from_pylist([block(held)], schema=_BLOCK)

    sorted_rows = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = sorted_rows.mapInArrow(pack, "first_key string, lines long, block binary")
    blocks = blocks.withColumn("block_id", F.monotonically_increasing_id())  # rises with the key
    blocks.write.parquet(f"{path}/blocks")
    stored = entries.sparkSession.read.parquet(f"{path}/blocks")
    stored.select("block_id", "first_key", "lines").write.parquet(f"{path}/directory")


_BLOCK = pa.schema([("first_key", pa.string()), ("lines", pa.int64()), ("block", pa.binary())])


def parse_block(block: bytes) -> list[list]:
    """Lines of an index block, fields in the order of :data:`ENTRY`."""
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        v = line.split("\t")
        out.append([x if t == pa.string() else (None if x == "-" else int(x)) for x, t in zip(v, _SCHEMA.types)])
    return out


def blocks_of(first_keys: list[str], key: str, cut: int) -> range:
    """Places in the directory of the blocks that can hold ``key``, by binary search; keys in it have ``cut`` characters at most."""
    short = key[:cut]
    return range(max(0, bisect.bisect_left(first_keys, short) - 1), bisect.bisect_right(first_keys, short))


def lookup(spark: SparkSession, index: str, urls: DataFrame | list[str]) -> DataFrame:
    """Index lines of all URLs given, a list or a table of one column, in the layout :data:`ENTRY`; each URL counts once.

    Every task searches the directory, whose size is bounded. Only blocks that can hold a key are read, and each
    meets at most as many keys at a time as a block has lines.
    """
    if not isinstance(urls, DataFrame):
        urls = spark.createDataFrame([(u,) for u in urls], "url string")
    directory = spark.read.parquet(f"{index}/directory").select("block_id", "first_key").orderBy("block_id").collect()
    ids, first_keys = [r.block_id for r in directory], [r.first_key for r in directory]
    cut = DIRECTORY_KEY

    def key(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["want"])

    def descend(batches):
        for batch in batches:
            hits = [(ids[i], k) for k in batch.column("want").to_pylist() for i in blocks_of(first_keys, k, cut)]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.string())], names=["block_id", "want"])

    keys = small_batches(urls.distinct()).mapInArrow(key, "want string").distinct()
    hits = materialise(small_batches(keys).mapInArrow(descend, "block_id long, want string"), "warc_hits")
    parts = hits.groupBy("block_id").agg(F.ceil(F.count("*") / BLOCK_LINES).alias("parts"))
    asked = (hits.join(parts, "block_id").groupBy("block_id", F.pmod(F.xxhash64("want"), F.col("parts")).alias("part"))
             .agg(F.collect_list("want").alias("wanted")))
    met = spark.read.parquet(f"{index}/blocks").select("block_id", "block").join(asked, "block_id").select("wanted", "block")

    def search(batches):
        for batch in batches:
            for wanted, block in zip(batch.column("wanted").to_pylist(), batch.column("block").to_pylist()):
                lines = parse_block(block)
                starts = [line[0] for line in lines]
                rows = [e for k in wanted for e in lines[bisect.bisect_left(starts, k):bisect.bisect_right(starts, k)]]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in rows], t) for i, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)

    return small_batches(met).mapInArrow(search, ENTRY)


def open_archive(file: str):
    """A file of an archive for reading at a place; the store must be one that pyarrow reaches."""
    if file.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + file.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def runs(ranges: list[tuple[int, int]]):
    """Ranges (at, size) in order, gathered to runs (from, to, ranges) that are read at once."""
    held: list[tuple[int, int]] = []
    for at, size in sorted(ranges):
        if held and (at - sum(held[-1]) > len(GAP) or at + size - held[0][0] > RUN_BYTES):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((at, size))
    if held:
        yield held[0][0], sum(held[-1]), held


def read_ranges(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Read the byte ranges of ``entries`` from the archives: page_id, payload, and what the record itself says.

    A range that is no record, or whose payload does not have its digest, is an error. Tasks
    receive files and ranges, whose number FILE_BYTES bounds, and read no other bytes.
    """
    entries = materialise(entries.select("file", "at", "size"), "warc_ranges")
    n_bytes = entries.agg(F.sum("size")).first()[0] or 0
    # The ranges are few bytes, what they name is much: the number of tasks follows the latter.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    per_file = entries.repartition(tasks, "file").groupBy("file").agg(F.collect_list(F.struct("at", "size")).alias("ranges"))

    def run(batches):
        for batch in batches:
            for file, ranges in zip(batch.column("file").to_pylist(), batch.column("ranges")):
                with open_archive(file) as archive:
                    for start, end, members_ in runs([(r["at"], r["size"]) for r in ranges.as_py()]):
                        data, rows = archive.read_at(end - start, start), []
                        for at, size in members_:
                            (_, _, content), = members(data[at - start:at - start + size])
                            f, payload = parse(content)
                            said = f["warc-payload-digest"].removeprefix("sha1:")
                            if f["warc-type"] == "response" and digest(payload) != said:
                                raise ValueError(f"digest of {f['warc-record-id']} differs")
                            rows.append((_page(f["warc-record-id"]), None if f["warc-type"] == "revisit" else payload, int(f["x-payload-length"]),
                                         said, f["warc-type"], _page(f.get("warc-refers-to"))))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)

    return small_batches(per_file).mapInArrow(run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


_READ = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64())])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and index to the shared folder, look every URL up and read its records back."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "index")
    write_archives(pages, archives, min_bytes=min_bytes)
    write_index(scan(spark, archives), index)
    return read_ranges(spark, lookup(spark, index, pages.select("url")))
