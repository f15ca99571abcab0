"""Content-addressed web archive: payloads once by digest, record heads apart, joined on reading.

An archive is a folder with two tables. ``heads``: a row per record with its exact bytes up to the
payload (WARC fields, HTTP head). ``payloads``: digest and payload, each once, as a zstd frame.
Reading joins both by digest, checks every digest and gives back the records byte by byte.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.shared import new_path, stage

# Smaller payloads are always stored as a response of their own.
MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-record:([^:>]*):([0-9]+)>")
_NO_ID = "!"  # stands for a null id, and occurs in no encoded one

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("record", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _urn(page: str, row: str):
    value = F.coalesce(F.url_encode(F.col(page).cast("string")), F.lit(_NO_ID))
    return F.concat(F.lit("<urn:x-record:"), value, F.lit(":"), F.col(row).cast("string"), F.lit(">"))


def _id_of(urn: str) -> str | None:
    code = _ID.fullmatch(urn)[1]
    return None if code == _NO_ID else unquote_plus(code)


def _heads(records: DataFrame) -> DataFrame:
    """The head of each record, and the digest of the payload that follows it."""
    narrow = stage(
        records.select(
            F.col("id"),
            F.regexp_replace("uri", r"[\x00-\x20]+", "%20").alias("uri"),
            F.sha2("payload", 256).alias("digest"),
            F.octet_length("payload").cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "records",
    )
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    firsts = narrow.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("copies")
    )
    # Only payloads with copies; a hot one is split by the adaptive join.
    firsts = firsts.where("copies > 1").select(
        "digest", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row")
    )
    judged = narrow.join(firsts, "digest", "left").withColumn(
        "revisit", F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n_bytes"))
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _urn("id", "row"),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("uri")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit(f"\r\nWARC-Profile: {_REVISIT}\r\nWARC-Refers-To: "), _urn("first_id", "first_row")
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
    )
    return judged.select(F.concat(fields, http).cast("binary").alias("head"), "digest")


def _payloads(records: DataFrame) -> DataFrame:
    """Each payload once. Copies are dropped before the shuffle; equal digests must agree in length
    and in a second hash, else the write fails."""
    schema = "digest string, frame binary, n_bytes long, second long"

    def pack(stream):
        import xxhash
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in stream:
            payloads = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([packer.compress(p) for p in payloads], pa.binary()),
                    pa.array([len(p) for p in payloads], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(p) >> 1 for p in payloads], pa.int64()),
                ],
                names=["digest", "frame", "n_bytes", "second"],
            )

    packed = records.select("payload").mapInArrow(pack, schema)
    same = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("second") == F.max("second"))
    return packed.groupBy("digest").agg(
        F.first("frame").alias("frame"), same.alias("same")
    ).select(
        "digest",
        F.when(F.col("same"), F.col("frame"))
        .otherwise(F.raise_error(F.lit("different payloads of one digest")).cast("binary"))
        .alias("frame"),
    )


def write_archive(df: DataFrame, path: str, id: str, uri: str, payload: str) -> None:
    """Archive a record per row of ``df`` below ``path``.

    Of equal payloads of ``MIN_REVISIT_BYTES`` or more, the record with the least id is the
    response (a null id comes last; of repeated ids, one row) and the others revisit it. A null
    payload is an empty one, a null uri leaves its field out, other columns are not stored. Ids are
    percent-encoded in the records, so they may hold anything; control characters and blanks in a
    uri become ``%20``.
    """
    records = df.select(
        F.col(id).alias("id"),
        F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    _payloads(records).write.parquet(f"{path}/payloads")
    _heads(records).write.parquet(f"{path}/heads")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of one record."""
    end = record.index(b"\r\n\r\n") + 4
    lines = record[: end - 4].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = record[end : end + int(fields["Content-Length"])]
    if record[end + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    split = block.index(b"\r\n\r\n") + 4
    return fields, block[:split], block[split:]


def _described(record: bytes, full_payload: bytes | None) -> dict:
    fields, _, payload = parse_record(record)
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        payload = full_payload
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return {
        "id": _id_of(fields["WARC-Record-ID"]),
        "uri": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": None if payload is None else len(payload),
        "payload_digest": digest,
        "refers_to": _id_of(fields["WARC-Refers-To"]) if revisit else None,
    }


def read_archive(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """Every record of an archive: its fields, its exact bytes and its full payload.

    Each record is put together from its head and its payload, parsed, and its payload checked
    against the digest; a payload that is missing from the archive is an error. ``with_bytes=False`` leaves ``record`` and ``payload`` null.
    """
    heads = spark.read.schema("head binary, digest string").parquet(f"{path}/heads")
    payloads = spark.read.schema("digest string, frame binary").parquet(f"{path}/payloads")
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def rebuild(stream):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in stream:
            rows, records, full = [], [], []
            for head, frame, digest in zip(*batch.columns, strict=True):
                if not frame.is_valid:
                    raise ValueError(f"the archive has lost the payload {digest}")
                payload = unpacker.decompress(frame.as_py())
                head = head.as_py()
                stored = b"" if b"\r\nWARC-Type: revisit\r\n" in head else payload
                record = head + stored + b"\r\n\r\n"
                rows.append(_described(record, payload))
                records.append(record if with_bytes else None)
                full.append(payload if with_bytes else None)
            columns = [
                pa.array([r[f.name] for r in rows], t)
                for f, t in zip(RECORD.fields, types, strict=False)
            ]
            columns += [pa.array(records, pa.binary()), pa.array(full, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=RECORD.names)

    return heads.join(payloads, "digest", "left").select("head", "frame", "digest").mapInArrow(rebuild, RECORD)


def export_files(spark: SparkSession, path: str, target: str) -> None:
    """Write an archive's records as gzipped WARC files, which other tools read."""
    records = read_archive(spark, path).select(
        F.expr("cast(substring(record, 1, octet_length(record) - 2) as string)").alias("value")
    )
    records.write.option("lineSep", "\r\n").option("compression", "gzip").text(target)


def records_of_file(content: bytes) -> list[bytes]:
    """The records of a WARC file's bytes, cut by their lengths."""
    records, at = [], 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", content[at:end])
        stop = end + int(length[1]) + 4
        records.append(content[at:stop])
        at = stop
    return records


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped or not; a file is read whole by one task.

    Revisits come without payload, their length is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def cut(stream):
        import gzip

        for batch in stream:
            for content in batch.column(0).to_pylist():
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                records = records_of_file(raw)
                rows = [_described(r, None) for r in records]
                columns = [
                    pa.array([r[f.name] for r in rows], t)
                    for f, t in zip(RECORD.fields, types, strict=False)
                ]
                columns += [
                    pa.array(records, pa.binary()),
                    pa.array([parse_record(r)[2] for r in records], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=RECORD.names)

    return files.mapInArrow(cut, RECORD)


def op3_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = new_path(spark, "archive")
    write_archive(pages, path, "page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    return read_archive(spark, path, with_bytes=False).select(
        F.col("id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def sql() -> str:
    """DuckDB SQL of ``op3_archive``."""
    return f"""
    with p as (
      select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
             sha256(coalesce(html, '')) as payload_digest
      from pages),
    o as (
      select *, row_number() over (partition by payload_digest order by page_id nulls last) as k,
             first_value(page_id) over (partition by payload_digest order by page_id nulls last) as f
      from p)
    select page_id, payload_bytes, payload_digest,
      case when payload_bytes >= {MIN_REVISIT_BYTES} and k > 1 then 'revisit' else 'response' end as record_type,
      case when payload_bytes >= {MIN_REVISIT_BYTES} and k > 1 then f end as refers_to
    from o"""
