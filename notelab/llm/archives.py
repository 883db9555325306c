"""Operator 3: legacy archives (ARC, versions 1 and 2) to WARC, and readers and writers of both on Spark.

Archives are written by Spark's text writer, one record per row with the format's record separator as line separator,
gzip-compressed, into the shared folder; they are read as binary files and parsed by declared lengths, never by
separators. ``records_per_file`` bounds a file.

The converter parses ARC header lines by the version that a file's first record declares (version 1: url, ip, date,
type, length; version 2: also result code, checksum, location, offset, file name) and synthesises for each record a WARC
identifier (a name-based UUID of file, offset and url), an ISO timestamp from the 14 digits, a record type, and SHA-1
digests of payload and block. A first pass over the archives yields only keys, lengths and digests; from these, records
with equal payloads of ``min_revisit`` bytes or more become revisits of the one with the largest page id. The second
pass writes the records; a revisit keeps its HTTP head only.

Hot payloads: the decision joins slim rows on the digest, an equi-join that AQE splits; decisions return to their files
by file name.

Edge cases: a null html is an empty payload; a null or blank url becomes ``urn:page``; white space and control
characters in urls are percent-encoded; null page ids are kept and count as smallest; of repeated rows the first in the
archives is the response; tables without rows give an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, read

RECORDS_PER_FILE = 2000
#: Pages carry no capture date or address; archives need both.
CAPTURE_DATE, ADDRESS = "20000101000000", "0.0.0.0"
# --- fixed values of the formats
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# ---


def http_block(page_id, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join([*head, "", ""]).encode() + payload


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """The head with its blank line, its fields by lower-case name, and the payload."""
    cut = block.find(b"\r\n\r\n")
    cut = len(block) if cut < 0 else cut + 4
    fields = (line.split(":", 1) for line in block[:cut].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return block[:cut], {k.strip().lower(): v.strip() for k, v in fields}, block[cut:]


def arc_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip()) or "urn:page"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 notelab\n{ARC_FIELDS[version]}\n".encode()
    last = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} {ADDRESS} {CAPTURE_DATE} {last}\n".encode() + body


def arc_record(version: int, url: str, block: bytes, name: str, offset: int) -> bytes:
    more = "" if version == 1 else f"200 {hashlib.sha1(block).hexdigest()} - {offset} {name} "
    return f"{url} {ADDRESS} {CAPTURE_DATE} text/html {more}{len(block)}\n".encode() + block


def unpacked(content: bytes) -> bytes:
    """Contents of a plain file or of a gzip file of any number of members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records after each version block."""
    at, names = 0, ARC_FIELDS[1].split(" ")
    while at < len(data):
        if data[at] == 10:  # the newline that ends the record before
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").split(" ")
        if data[at:end].startswith(b"filedesc://"):
            body = data[end + 1 : end + 1 + int(values[-1])]
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} at {at}")
            names = ARC_FIELDS[version].split(" ")
        else:
            if len(values) != len(names):
                raise ValueError(f"ARC header of {len(values)} fields at {at}; the version has {len(names)}")
            yield at, dict(zip(names, values, strict=True)), data[end + 1 : end + 1 + int(values[-1])]
        at = end + 1 + int(values[-1])


def record_id(name: str, offset: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset} {url}')}>"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it (the text writer adds them)."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", sha1_label(block)), ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_VALUE = pa.schema([("value", pa.string())])


def _texts(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).cast(pa.string())], schema=_VALUE)


def _to_arc(records_per_file: int):
    """ARC records; a version block opens each file, the versions taking turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, version, name, offset = 0, 1, "", 0
        for batch in batches:
            out: list[bytes] = []
            ids, urls, pages = (batch.column(i).to_pylist() for i in range(3))
            for page_id, url, html in zip(ids, urls, pages, strict=True):
                if n % (records_per_file - 1) == 0:
                    version = 1 + n // (records_per_file - 1) % 2
                    name = f"part-{n // (records_per_file - 1):05d}.arc"
                    out.append(arc_version_block(version, name))
                    offset = len(out[-1]) + 1
                out.append(arc_record(version, arc_url(url), http_block(page_id, (html or "").encode()), name, offset))
                offset += len(out[-1]) + 1
                n += 1
            yield _texts(out)

    return run


def write_arc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_to_arc(records_per_file), "value string")
    (rows.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records_per_file).text(path))


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _arc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """File, offset, page id, payload length and digest of every ARC record."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            for offset, header, block in parse_arc(unpacked(content.as_py())):
                _, fields, payload = split_http(block)
                name = fields.get("x-page-id")
                rows.append((path.as_py(), offset, int(name) if name else None, len(payload), hashlib.sha1(payload).hexdigest(), record_id(path.as_py().rsplit("/", 1)[-1], offset, header["URL"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KEYS)], schema=_KEYS)


_KEYS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("record_id", pa.string())])


def revisits(keys: DataFrame, min_revisit: int) -> DataFrame:
    """(path, offset, refers_to): records whose payload another one holds, with that one's record id."""
    large = keys.where(F.col("bytes") >= min_revisit)
    # the largest page id; among equal ids the record that comes first in the archives
    response = F.min_by(F.struct("path", "offset", "record_id"), F.struct(F.col("page_id").isNull(), -F.col("page_id"), "path", "offset"))
    best = large.groupBy("digest", "bytes").agg(response.alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    return (large.join(best, ["digest", "bytes"]).where((F.col("path") != F.col("response.path")) | (F.col("offset") != F.col("response.offset")))
            .select("path", "offset", F.col("response.record_id").alias("refers_to")))


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records of each ARC file, after a warcinfo record that names it."""
    for batch in batches:
        for path, content, decided in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            name = path.as_py().rsplit("/", 1)[-1]
            refers = {x["offset"]: x["refers_to"] for x in decided.as_py() or []}
            info = f"software: notelab\r\nformat: WARC File Format 1.0\r\nconverted-from: {name}\r\n".encode()
            out = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1, "warcinfo")), ("WARC-Date", iso_date(CAPTURE_DATE)), ("Content-Type", "application/warc-fields")], info)]
            for offset, header, block in parse_arc(unpacked(content.as_py())):
                head, _, payload = split_http(block)
                to = refers.get(offset)
                fields = [("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", record_id(name, offset, header["URL"])), ("WARC-Date", iso_date(header["Archive-date"])), ("WARC-Target-URI", header["URL"]), ("WARC-IP-Address", header["IP-address"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1_label(payload))]
                if to:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to)]
                out.append(warc_record(fields, head if to else block))
            yield _texts(out)


def convert(spark: SparkSession, arc_path: str, warc_path: str, scratch: Scratch, min_revisit: int = 1000, records_per_file: int = RECORDS_PER_FILE) -> None:
    """ARC files of a folder to WARC files of another."""
    keys = scratch.stage(files(spark, arc_path).mapInArrow(_arc_keys, "path string, offset long, page_id long, bytes long, digest string, record_id string"), "keys")
    decided = revisits(keys, min_revisit).groupBy("path").agg(F.collect_list(F.struct("offset", "refers_to")).alias("decided"))  # at most a file's records
    rows = files(spark, arc_path).join(decided, "path", "left").select("path", "content", "decided").mapInArrow(_to_warc, "value string")
    (rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .option("maxRecordsPerFile", records_per_file + 1).text(warc_path))


_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers", pa.string())])


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Responses and revisits of WARC files; digests and lengths are of the full payload and, where it is there, checked."""
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for fields, block in parse_warc(unpacked(content.as_py())):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                _, http, payload = split_http(block)
                digest = base64.b32decode(fields["warc-payload-digest"].split(":", 1)[1]).hex()
                size = len(payload) if kind == "response" else int(http["content-length"])
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                page = http.get("x-page-id")
                rows.append((fields["warc-record-id"], kind, fields["warc-target-uri"], fields["warc-date"], int(page) if page else None, size, digest, fields.get("warc-refers-to")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RECORDS)], schema=_RECORDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).mapInArrow(_from_warc, "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers string")


def archived(pages: DataFrame, min_revisit: int = 1000, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back: one row per page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "archives")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, records_per_file)
    convert(spark, arc, warc, scratch, min_revisit, records_per_file)
    records = scratch.stage(read_warc(spark, warc), "records")
    referred = records.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    first = records.where("refers is null").withColumn("refers_to", F.lit(None).cast("long"))
    again = records.where("refers is not null").join(referred, "refers", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return first.select(columns).unionByName(again.select(columns))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages")).drop("record_id")
