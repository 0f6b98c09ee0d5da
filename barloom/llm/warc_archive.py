"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, one gzip member each, in archive files of the shared folder. The index holds a line per record,
sorted by reversed-host URL key, in gzip blocks; a sparse directory per index file gives the first key, place and length
of each block. A lookup finds the file by its first key, the block by binary search in the directory, the line by binary
search in the block, and reads the record by its byte range.

Files are written by tasks through ``pyarrow.fs`` (local paths, and stores that it knows) under a name that depends on the
partition alone; each is written aside and moved into place, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import bisect
import gzip
import json
import uuid
import zlib
from hashlib import sha1

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import fresh_folder, read_table, staged

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"
ENTRY = "key string, page_id {id}, digest string, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """Reversed-host key ``com,example,www)/path?query`` of a url; without ``://`` the url itself, null as empty."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(url.contains("://"), F.concat(turned, F.lit(")"), rest)).otherwise(url)


def capture_types(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, refers_to``: null where the record holds its payload.

    Pages are grouped by size and SHA-256; of a group of large payloads the largest page_id answers for all.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = pages.select("page_id", F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html).alias("payload_digest"), F.sha2(html, 256).alias("content"))
    facts = staged(facts, "payloads")
    large = facts.where(F.col("payload_bytes") >= least_bytes)
    holders = large.groupBy("content").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("content", "holder")
    joined = facts.join(staged(holders, "holders"), "content", "left")
    is_revisit = (F.col("payload_bytes") >= least_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when(is_revisit, F.col("holder")).alias("refers_to"))


def _record(kind: str, page_id, url: str | None, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", json.dumps(url) if url is not None and any(c in url for c in "\r\n") else url or ""),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("WARC-Page-ID", json.dumps(page_id)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To-Page-ID", json.dumps(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(payload))))
    head = BREAK.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)])
    return head.encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record; raises ValueError where it is not whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split(BREAK)
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return fields, rest[:size]


def _packed(raw: bytes) -> bytes:
    return gzip.compress(raw, 6, mtime=0)


class _File:
    """A file written aside and moved into place when complete."""

    def __init__(self, folder: str, name: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.path, self.aside = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.store.create_dir(path, recursive=True)
        self.out, self.at = self.store.open_output_stream(self.aside), 0

    def add(self, data: bytes) -> int:
        start, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.store.move(self.aside, self.path)


def _uri(folder: str) -> str:
    return folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html, payload_bytes, payload_digest, refers_to)``; the index entries, staged.

    Every partition of ``pages`` becomes one archive file.
    """
    folder = _uri(folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    dealt = pages.withColumn("key", url_key(F.col("url"))).withColumn("tie", F.xxhash64("url", "html"))
    dealt = dealt.sortWithinPartitions("page_id", "tie").drop("tie").withColumn("part", F.spark_partition_id())

    def run(batches):
        out, name = None, None
        for b in batches:
            entries = []
            for r in b.itertuples(index=False):
                if out is None:
                    name = f"pages-{r.part:05d}.warc.gz"
                    out = _File(folder, name)
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                refers_to = None if pd.isna(r.refers_to) else int(r.refers_to)
                payload = b"" if refers_to is not None or r.html is None else r.html.encode()
                raw = _packed(_record("response" if refers_to is None else "revisit", page_id, r.url, r.payload_digest, r.payload_bytes, refers_to, payload))
                entries.append((r.key, page_id, r.payload_digest, name, out.add(raw), len(raw)))
            if entries:
                yield pd.DataFrame(entries, columns=["key", "page_id", "digest", "file", "offset", "length"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return staged(dealt.mapInPandas(run, ENTRY.format(id=kind)), "captures")


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted blocks and a directory per index file; ``first_key, file`` of every index file, in order of keys."""
    folder = _uri(folder)
    ordered = entries.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "digest", "file", "offset").withColumn("part", F.spark_partition_id())

    def run(batches):
        out, name, held, directory = None, None, [], []

        def flush():
            raw = _packed(b"".join(held_line.encode() + b"\n" for _, held_line in held))
            directory.append([held[0][0], out.add(raw), len(raw)])
            held.clear()

        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    name = f"index-{r.part:05d}.gz"
                    out = _File(folder, name)
                page_id = None if pd.isna(r.page_id) else int(r.page_id)
                place = sort_place(r.key, page_id, r.digest)
                held.append((place, json.dumps([*place, r.file, int(r.offset), int(r.length)])))
                if len(held) == block_lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            listing = _File(folder, f"{name}.directory")
            listing.add(json.dumps(directory).encode())
            listing.close()
            yield pd.DataFrame({"key": [directory[0][0][0]], "id": [json.dumps(directory[0][0][1:])], "file": [name]})

    return staged(ordered.mapInPandas(run, "key string, id string, file string"), "index-files")


def sort_place(key: str, page_id: int | None, digest: str = "") -> list:
    """Place of a capture in the index, as its sort compares it: key by bytes, then page_id, nulls first, then payload digest."""
    return [key, page_id is not None, page_id or 0, digest]


def _order(place: list) -> tuple:
    return place[0].encode(), *place[1:]


class Index:
    """Binary search in the index files of one folder; keeps the block and directory it read last."""

    def __init__(self, folder: str, files: list[tuple[list, str]]):
        self.store, self.path = fs.FileSystem.from_uri(_uri(folder))
        self.files = sorted(((_order(p), name) for p, name in files))
        self.first = [p for p, _ in self.files]
        self.name, self.directory, self.block_at, self.block = None, [], None, []

    def _range(self, name: str, offset: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.path}/{name}") as f:
            return f.read_at(length, offset)

    def _open_block(self, b: int) -> None:
        if self.block_at != b:
            _, offset, length = self.directory[b]
            self.block = [json.loads(line) for line in gzip.decompress(self._range(self.name, offset, length)).splitlines()]
            self.block_at = b

    def _first_from(self, k: int, want: tuple) -> list | None:
        """First entry of file ``k`` at ``want`` or behind it."""
        if self.name != (name := self.files[k][1]):
            with self.store.open_input_file(f"{self.path}/{name}.directory") as f:
                self.directory = [(_order(p), o, n) for p, o, n in json.loads(f.read())]
            self.name, self.block_at = name, None
        b = max(bisect.bisect_right(self.directory, want, key=lambda d: d[0]) - 1, 0)
        self._open_block(b)
        at = bisect.bisect_left(self.block, want, key=lambda e: _order(e[:4]))
        if at == len(self.block):
            if b + 1 == len(self.directory):
                return None
            self._open_block(b + 1)
            at = 0
        return self.block[at]

    def find(self, key: str, page_id: int | None, digest: str | None = None) -> tuple[str, int, int] | None:
        """File, offset and length of a capture: of the one with this payload digest, or of the first one."""
        place = sort_place(key, page_id, digest or "")
        want = _order(place)
        k = max(bisect.bisect_right(self.first, want) - 1, 0)
        entry = self._first_from(k, want) if self.files else None
        if entry is None and k + 1 < len(self.files):
            entry = self._first_from(k + 1, want)
        if entry is None or entry[:3] != place[:3] or digest not in (None, entry[3]):
            return None
        return tuple(entry[4:])


def look_up(wanted: DataFrame, index_files: DataFrame, folder: str) -> DataFrame:
    """Read back the captures ``wanted(key, page_id, payload_digest)``: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``. Without a digest column the first capture of a key and page_id is read.

    Captures that are not in the index give no row. Payloads are digested again; a record that does not hold what its header
    says raises. Wanted keys are read in index order, so a task touches few blocks; records are then read per archive file.
    """
    folder = _uri(folder)
    # one row per index file: as many as the index has partitions
    files = [([r["key"], *json.loads(r["id"])], r["file"]) for r in index_files.collect()]
    kind = wanted.schema["page_id"].dataType.simpleString()

    def locate(batches):
        index = Index(folder, files)
        for b in batches:
            ids = [None if pd.isna(p) else int(p) for p in b["page_id"]]
            digests = b["payload_digest"] if "payload_digest" in b else [None] * len(b)
            found = [(p, *f) for k, p, d in zip(b["key"], ids, digests) if (f := index.find(k, p, d))]
            yield pd.DataFrame(found, columns=["page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    placed = wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInPandas(locate, f"page_id {kind}, file string, offset bigint, length bigint")

    def read(batches):
        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.file != name:
                    if source is not None:
                        source.close()
                    name, source = r.file, store.open_input_file(f"{path}/{r.file}")
                raw = zlib.decompress(source.read_at(r.length, r.offset), 31)
                out.append(_answer(*parse_record(raw)))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    # a range of an archive per task: a large archive is read by several tasks
    sliced = placed.repartition("file", F.expr("offset div 16777216")).sortWithinPartitions("file", "offset")
    return sliced.mapInPandas(read, f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")


def _answer(fields: dict[str, str], payload: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, size = fields["WARC-Type"], int(fields["WARC-Payload-Length"])
    if kind == "response" and (sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload differs from its digest")
    refers = fields.get("WARC-Refers-To-Page-ID")
    return json.loads(fields["WARC-Page-ID"]), size, digest, kind, None if refers is None else json.loads(refers)


def archive_and_read(pages: DataFrame, folder: str | None = None, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives with an index, look every page up again, one row per row.

    ``page_id`` is a whole number. Null html is an empty payload, a null url an empty key. Rows with a null page_id are archived
    and found too; they never answer for others. Rows of one page_id with different payloads are found by their own payload. An
    empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    types = capture_types(pages, least_bytes).withColumnRenamed("page_id", "_page").dropDuplicates(["_page", "payload_digest"])
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")))
    typed = pages.withColumn("_digest", digest).join(types, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_digest") == F.col("payload_digest")))
    entries = write_archives(typed.drop("_page", "_digest"), folder)
    index_files = write_index(entries, folder)
    return look_up(pages.select(url_key(F.col("url")).alias("key"), "page_id", digest.alias("payload_digest")), index_files, folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read_table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc": op7_warc}
ORACLES = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
                     max(page_id) OVER (PARTITION BY html) AS holder FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND holder <> page_id THEN holder END AS refers_to
        FROM s"""
}
