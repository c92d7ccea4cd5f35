"""WARC archives without repeated payloads: revisit records stand in for payloads stored elsewhere."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageway.llm.common import written

RECORDS = "record_id string, uri string, date string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"
#: Payload bytes meant for one archive file.
FILE_BYTES = 32 * 1024 * 1024
_END = "\r\n"


def payload_digests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` with payload_bytes and payload_digest (base32 of the SHA-1, upper case, 32 characters)."""

    @F.pandas_udf("string")
    def base32(raw):
        return raw.map(lambda x: base64.b32encode(bytes(x)).decode("ascii"))

    return df.withColumns({"payload_bytes": F.octet_length(payload).cast("bigint"), "payload_digest": base32(F.unhex(F.sha1(payload)))})


def resolve_revisits(headers: DataFrame, key: str = "key", least: int = 0) -> DataFrame:
    """record_type and refers_to for record headers (key, payload_digest, payload_bytes).

    Of the records with equal payloads of at least ``least`` bytes the one with the largest key is the response and
    the others are revisits that refer to it; smaller payloads are all responses. Headers are shuffled by digest: the
    largest key is found with map-side maxima, and joined back. Records that repeat the response's key are responses
    like it, as are all records of a payload without any key; records with a null key are revisits elsewhere.
    """
    same = ["payload_digest", "payload_bytes"]
    original = headers.filter(F.col("payload_bytes") >= least).groupBy(*same).agg(F.max(key).alias("_original"))
    joined = headers.join(original, same, "left")
    revisit = F.col("_original").isNotNull() & ~F.col(key).eqNullSafe(F.col("_original"))
    return joined.withColumns(
        {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("_original"))}
    ).drop("_original")


def _line(name: str, value: Column) -> Column:
    """A header line; line breaks inside a value would end it and become spaces. A null value leaves the line out."""
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(_END)), F.lit(""))


def record_text(key: Column, uri: Column, date: Column) -> Column:
    """A whole WARC/1.1 record (as raw bytes in a string) of a row with payload, payload_digest, payload_bytes,
    record_type, refers_to; its last line break is left to the writer. Record ids are made from the key."""
    revisit = F.col("record_type") == "revisit"
    name = lambda k: F.concat(F.lit("<urn:record:"), F.url_encode(k.cast("string")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_END + _END),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    block = F.octet_length(http) + F.octet_length(body)
    return F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "),
        F.col("record_type"),
        F.lit(_END),
        _line("WARC-Record-ID", F.coalesce(name(key), F.lit("<urn:record>"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", uri),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.lit(_END),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}")).otherwise(F.lit("")),
        F.coalesce(F.when(revisit, _line("WARC-Refers-To", name(F.col("refers_to")))), F.lit("")),
        F.lit("Content-Length: "),
        block.cast("string"),
        F.lit(_END + _END),
        http,
        body,
        F.lit(_END),
    )


def write_archives(records: DataFrame, path: str, key: str = "key", uri: str = "uri", date: str = "date") -> None:
    """Write records as gzipped WARC files with fresh headers, one for each partition; payloads of revisits are left out.

    Spark's text writer does it, ending each record with its second line break, so files reach any shared storage and
    a task that is lost or repeated leaves no half archive.
    """
    text = records.select(record_text(F.col(key), F.col(uri), F.col(date)).alias("value"))
    text.write.option("lineSep", _END).option("compression", "gzip").text(path)


def parse_records(data: bytes):
    """Records of one archive, as tuples in the order of ``RECORDS``. A damaged record is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(_END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        begin = end + 4
        at = begin + int(head["content-length"])
        split = data.index(b"\r\n\r\n", begin) + 4
        http = data[begin:split].decode("latin-1").lower()
        size = int(http.rpartition("content-length: ")[2].split(_END, 1)[0])
        payload = data[split:at] if head["warc-type"] == "response" else None
        yield (head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-date"), head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), size, head.get("warc-refers-to"), payload)
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record without end before byte {at}")
        at += 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files (plain or gzipped) below ``path``; payloads of responses are checked against digests."""
    import zlib

    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def unpacked(data: bytes) -> bytes:
        parts = []
        while data[:2] == b"\x1f\x8b":  # members follow one another
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        return b"".join(parts) if parts else data

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_records(unpacked(content.as_py())):
                    if row[7] is not None and base64.b32encode(hashlib.sha1(row[7]).digest()).decode("ascii") != row[4]:
                        raise ValueError(f"payload of {row[0]} does not have its digest")
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORDS)


def record_key(name: Column | str) -> Column:
    """The key a record id was made from."""
    return F.url_decode(F.regexp_extract(name, r"^<urn:record:(.*)>$", 1))


def archive_pages(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write one record per page to deduplicated archives below ``path`` and read them back.

    Returns the records read. Null payloads are empty; null and repeated keys: see ``resolve_revisits``; an empty
    table writes archives without records; other columns are ignored. Headers alone are shuffled by digest; payloads
    move once, to meet their record types in files of about ``FILE_BYTES``.
    """
    spark = pages.sparkSession
    records = payload_digests(
        pages.select(
            F.col(key).alias("key"),
            F.col(uri).cast("string").alias("uri"),
            F.lit("1970-01-01T00:00:00Z").alias("date"),
            F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
        )
    ).withColumn("_id", F.concat_ws("|", F.col("key").cast("string"), "payload_digest"))
    headers = written(records.select("_id", "key", "payload_digest", "payload_bytes"), "headers")
    types = resolve_revisits(headers, "key", least).select("_id", "record_type", "refers_to").distinct()
    total = headers.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0))).first()[0]
    files = max(total // FILE_BYTES + 1, spark.sparkContext.defaultParallelism)
    write_archives(records.repartition(files, "_id").join(types, "_id"), path)
    return read_archives(spark, path)
