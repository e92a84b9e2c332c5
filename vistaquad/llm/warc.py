"""WARC archives: one gzip member per record, read back in sequence.

Archives are rows (path, content), as Spark's binaryFile source gives them, so files on any store that Spark reads can be
read with spark.read.format("binaryFile"). Written archives are a table of such rows in the shared folder.
"""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import dealt, hot_from, settle, utf8
from vistaquad.sources.files import write_files

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 4_000_000
PAYLOADS = 500_000  # payloads that several rows hold and that are broadcast at most (100 bytes each)
CHUNK = 65_536
MAGIC = b"\x1f\x8b\x08"  # with which a gzip member begins
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:record:"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member with a response, or with a revisit of the record refers_to, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID}{record_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode()) + gz.compress(block + b"\r\n\r\n") + gz.flush()


def _member(content: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of the gzip member that begins there, inflated chunk by chunk, and where the next one begins; -1 if it is
    damaged."""
    inflate, out = zlib.decompressobj(31), []
    try:
        while not inflate.eof and at < len(content):
            out.append(inflate.decompress(content[at : at + CHUNK]))
            at = at + CHUNK if not inflate.eof else min(at + CHUNK, len(content)) - len(inflate.unused_data)
    except zlib.error:
        return b"".join(out), -1
    return b"".join(out), at if inflate.eof else -1


def _resumed(content: bytes, at: int) -> int:
    """Where the next whole record begins: the first place from which a member inflates to one."""
    while (at := content.find(MAGIC, at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(content[at : at + CHUNK], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(content)


def members(content: bytes):
    """Each gzip member's bytes, inflated; of a damaged one, what could be read. Reading goes on at the next record after it."""
    at = 0
    while at < len(content):
        out, end = _member(content, at)
        yield out
        at = end if end >= 0 else _resumed(content, at + 1)


def parsed(member: bytes) -> dict:
    """Fields of a record, framed by its Content-Length; valid if the frame is whole and its digests hold."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
    block = rest[: max(size, 0)]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), len(payload))
    valid = lines[0].startswith("WARC/1.") and size >= 0 and rest[size:] == b"\r\n\r\n" and fields.get("warc-block-digest") == _digest(block)
    valid = valid and (kind == "revisit" or (said == _digest(payload) and length == len(payload)))
    try:
        digest = base64.b32decode(said.removeprefix("sha1:")).hex()
    except ValueError:
        digest = None
    own = lambda name: fields.get(name, "").strip("<>").removeprefix(ID) or None
    return {"record_id": own("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "refers_to": own("warc-refers-to"), "payload": None if kind == "revisit" else payload, "valid": valid}


def _writer(batches):
    """Archives named by the task that wrote them, their number in it, and their first record."""
    task, made = TaskContext.get().partitionId(), 0

    def archive(records):
        name = f"{task:06d}-{made:06d}-{hashlib.sha1(records[0]).hexdigest()}.warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(records)], pa.binary())], ["path", "content"])

    pending, size = [], 0
    for batch in batches:
        for key, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pending.append(record(key, url, payload, refers_to))
            size += len(pending[-1])
            if size >= ARCHIVE_BYTES:
                yield archive(pending)
                pending, size, made = [], 0, made + 1
    if pending:
        yield archive(pending)


_FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("valid", pa.bool_())])


def _reader(batches):
    for batch in batches:
        for content in batch.column(0):
            found, size = [], 0
            for member in members(content.as_py() or b""):
                found.append(parsed(member))
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist(found, _FIELDS)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, _FIELDS)


def write_warc(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archives (path, content) with a record for each row of pages.

    Of payloads that are equal and have revisit_bytes at least, the row with the largest id is written whole, the others
    as revisits of it. Null html is an empty payload, a null url an empty one. A row with a null id is written whole and
    read back with a null id. Repeated rows are written as often as they occur, the largest id's all whole. Other columns
    are not looked at; no rows give no archives.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), utf8(html_column).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("same", F.when(F.col("size") >= revisit_bytes, F.sha2("payload", 256)))  # SHA-1 has collisions
    large = rows.where("id is not null and same is not null")
    firsts = settle(large.groupBy("same").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "firsts")
    several, copies = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if several <= PAYLOADS:
        chosen = rows.join(F.broadcast(firsts), "same", "left")  # its size is checked; no payload is shuffled
    else:
        chosen = dealt(rows.where("same is not null"), firsts, ["same"], hot_from(copies), "left")
        chosen = chosen.unionByName(rows.where("same is null"), allowMissingColumns=True)
    revisited = F.when(F.col("id") != F.col("refers_to"), F.col("refers_to").cast("string"))
    return settle(chosen.select(F.coalesce(F.col("id").cast("string"), F.lit("")), "url", "payload", revisited).mapInArrow(_writer, "path string, content binary"), "warc")


def write_warc_files(pages: DataFrame, folder: str, mode: str = "append", **columns) -> None:
    """The archives of write_warc as files {digest}.warc.gz in a folder that driver and executors reach; all of them come to
    their places when the job is through, none before. read_warc reads them by spark.read.format("binaryFile")."""
    write_files(write_warc(pages, **columns), folder, mode)


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of archives (content): record_id, record_type, url, payload_bytes, payload_digest (hex), refers_to,
    payload (null for revisits) and valid. Null or empty content has no records; a damaged one comes out as a record that isn't
    valid, with what could be read of it, and the records after it as they are."""
    return archives.select("content").mapInArrow(_reader, "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, valid boolean")


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """Of the records of read_warc, the pairs (refers_to, payload_digest) that revisits name and no valid response has: the
    response is lacking or damaged, or holds another payload. n says how many revisits name the pair. Revisits are counted by
    pair before anything is joined, so a response that very many of them name is one row."""
    named = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    held = records.where("record_type = 'response' and valid").select(F.col("record_id").alias("refers_to"), "payload_digest")
    return named.join(held, ["refers_to", "payload_digest"], "left_anti")


def warc_query(pages: DataFrame) -> DataFrame:
    """op6: write, read back, and keep what the archives say; a record that isn't valid is an error, none is dropped."""
    found = read_warc(write_warc(pages))
    known = F.when(F.col("valid"), F.col("record_id").cast("long")).otherwise(F.raise_error(F.concat(F.lit("broken WARC record "), F.coalesce("record_id", F.lit("")))).cast("long"))
    return found.select(known.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest,
       case when strlen(h) >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when strlen(h) >= 1000 and page_id <> last then last end as refers_to
from p
"""
