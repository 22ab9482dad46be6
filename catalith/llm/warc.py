r"""WARC archives: write captures, read records back, assemble transactions.

*Writing* is plain Spark: a record is one string, and the text writer's separator is the
blank pair of line ends that closes a WARC record, so archives (``*.gz``, WARC/1.1) go to
any file system Spark can write.  Each capture gives a request, a response (or a revisit
of an earlier equal payload) and a metadata record; request and metadata name the
response in ``WARC-Concurrent-To``.

*Reading* splits a file at ``\r\n\r\nWARC/`` and repairs that by ``Content-Length``: a piece
shorter than its record announces goes on into the next one, so payloads that hold WARC
text themselves come back whole.  A gzip file is read by one task from start to end, in
batches; memory holds one record.

*Assembly* joins records through the graph of their concurrent-to identifiers, whichever
record names which, and however many it names.  A record that no other names and that names
one only (requests and metadata of most archives) belongs to that one; the components of
the remaining edges, if there are any, tell which of these belong together.  Then one
shuffle by capture gives one nested row for each.

Defined results: null payloads are empty, null urls ``about:blank``, a null id is written
as ``null`` and read back as null; line ends in urls are percent-coded; an identifier holds
a digest of url and payload, so rows that share an id stay apart; rows that are equal in
all columns share identifiers and give as many captures; a payload of any length is one
record; other columns of the table, whatever their names, are not read; an empty table
gives empty archives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.graph import components
from catalith.plans.storage import checkpoint, write_table

CRLF = "\r\n"
URN = "urn:catalith:page:"
DATE = "2024-01-01T00:00:00Z"
#: Equal payloads of at least so many bytes are stored once.
LEAST_BYTES = 100
#: Rows (32-byte digest and id each) up to which the table of repeated payloads is broadcast.
BROADCAST_ROWS = 100_000
RECORD = "record_type string, record_id string, concurrent_to array<string>, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


def _header(*fields: tuple[str, Column | str]) -> Column:
    parts = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF)]
    return F.concat(*parts, F.lit(CRLF))


def repeated_payloads(keyed: DataFrame) -> DataFrame:
    """Digests (binary ``_digest``) that several rows share, with the smallest id as ``_first``."""
    return (
        keyed.where(F.col("_bytes") >= LEAST_BYTES)
        .groupBy("_digest")
        .agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_name"))).alias("_f"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select(F.col("_digest").alias("_same"), F.col("_f._id").alias("_first"), F.col("_f._name").alias("_first_name"))
    )


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write every row of ``df`` as one capture (three records) to gzipped archives under ``path``."""
    clean = F.replace(F.replace(F.coalesce(F.col(url), F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    keyed = df.select(F.col(id_col).alias("_id"), clean.alias("_url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("_body")).withColumns(
        {"_bytes": F.octet_length("_body").cast("long"), "_digest": F.sha2(F.encode("_body", "UTF-8"), 256)}
    )
    page = F.coalesce(F.col("_id").cast("string"), F.lit("null"))
    keyed = keyed.withColumns({"_page": page, "_name": F.concat(page, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "_digest", "_url"), 256), 1, 16))})
    same = checkpoint(repeated_payloads(keyed))
    # The payloads are shuffled by digest only where too many of them repeat for a broadcast.
    small = same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(same) if small else same, (F.col("_digest") == F.col("_same")) & (F.col("_bytes") >= LEAST_BYTES), "left")
    joined = joined.withColumns({"_revisit": F.coalesce(~F.col("_id").eqNullSafe(F.col("_first")), F.lit(False)) & F.col("_first").isNotNull()})
    urn = lambda kind, of="_name": F.concat(F.lit(f"<{URN}"), F.col(of).cast("string"), F.lit(f":{kind}>"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("_revisit"), F.col("_http")).otherwise(F.concat("_http", "_body"))
    ask = F.concat(F.lit("GET "), F.col("_url"), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    fields = F.concat(F.lit("page-id: "), F.col("_page"), F.lit(CRLF))
    size = lambda c: F.octet_length(c).cast("string")
    joined = joined.withColumn("_http", http).withColumns({"_block": block, "_ask": ask, "_fields": fields})

    answer = F.when(F.col("_revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    refers = F.when(F.col("_revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), urn("response", "_first_name"), F.lit(CRLF))).otherwise("")
    records = F.array(
        F.concat(_header(("WARC-Type", "request"), ("WARC-Record-ID", urn("request")), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("_url")), ("WARC-Concurrent-To", urn("response")), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", size("_ask"))), F.col("_ask")),
        F.concat(
            F.concat(F.lit("WARC/1.1" + CRLF + "WARC-Type: "), answer, F.lit(CRLF), refers),
            F.substring_index(_header(("WARC-Record-ID", urn("response")), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("_url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", size("_block"))), "WARC/1.1" + CRLF, -1),
            F.col("_block"),
        ),
        F.concat(_header(("WARC-Type", "metadata"), ("WARC-Record-ID", urn("metadata")), ("WARC-Date", DATE), ("WARC-Target-URI", F.col("_url")), ("WARC-Concurrent-To", urn("response")), ("Content-Type", "application/warc-fields"), ("Content-Length", size("_fields"))), F.col("_fields")),
    )
    joined.select(F.explode(records).alias("value")).write.option("compression", "gzip").option("lineSep", CRLF + CRLF).text(path)


_SPLIT = "\r\n\r\nWARC/"
_FIELD = re.compile(rb"(?m)^([A-Za-z-]+):[ \t]*(.*?)\r?$")


def _payload(kind: str, block: bytes, fields: dict[bytes, bytes]) -> tuple[int, str | None, bytes]:
    """Bytes and digest of the full payload, and what of it the record holds."""
    body = block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            inner = {k.lower(): v for k, v in _FIELD.findall(head)}
            return int(inner.get(b"content-length", b"0")), fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:") or None, b""
    return len(body), hashlib.sha256(body).hexdigest(), body


def _records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    held: bytearray | None = None
    need = 0
    for piece in pieces:
        if held is None:
            held = bytearray(piece if piece.startswith(b"WARC/") else b"WARC/" + piece)
            end = held.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError("a WARC record has no end of its header")
            m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", held[:end])
            if not m:
                raise ValueError("a WARC record has no Content-Length")
            need = end + 4 + int(m[1])
        else:
            held += _SPLIT.encode() + piece
        if len(held) < need:
            continue  # the separator stood inside the payload
        head, block = bytes(held[: end + 2]), bytes(held[end + 4 : need])
        held = None
        fields = {k.lower(): v for k, v in _FIELD.findall(head)}
        text = lambda k, f=fields: f[k].decode("utf-8", "replace") if k in f else None
        kind = text(b"warc-type") or ""
        named = [v.decode("utf-8", "replace") for k, v in _FIELD.findall(head) if k.lower() == b"warc-concurrent-to"]
        yield kind, text(b"warc-record-id"), named, text(b"warc-refers-to"), text(b"warc-target-uri"), *_payload(kind, block, fields)
    if held is not None:
        raise ValueError("an archive ends inside a record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the gzipped archives under ``path``, with its payload."""
    lines = spark.read.option("lineSep", _SPLIT).text(path).select(F.col("value").cast("binary").alias("value"))
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORD.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for record in _records(x for b in batches for x in b.column("value").to_pylist()):
            out.append(record)
            size += 500 + len(record[-1])
            if size > 16_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return lines.mapInArrow(parse, RECORD)


def capture_ids(records: DataFrame) -> DataFrame:
    """Records with ``capture_id``: the least identifier among those that concurrent-to edges connect."""
    answers = F.col("record_type").isin("response", "revisit", "resource")
    to = F.array_distinct(F.filter(F.coalesce("concurrent_to", F.array().cast("array<string>")), lambda x: x != F.coalesce("record_id", F.lit(""))))
    keyed = records.withColumn("_to", to)
    links = checkpoint(keyed.where(F.size("_to") > 0).select("record_id", "_to", (answers | (F.size("_to") > 1)).alias("_odd")))
    edges = links.select("record_id", F.explode("_to").alias("_t"), "_odd")
    named = edges.select(F.col("_t").alias("_named")).distinct()
    # a record that others name, or that names several: where it belongs depends on more than itself
    plain = edges.where(~F.col("_odd"))
    inner = plain.join(named, F.col("record_id") == F.col("_named"), "left_semi").select("record_id", "_t")
    odd = checkpoint(edges.where("_odd").select("record_id", "_t").unionByName(inner))
    keyed = keyed.withColumn("_key", F.when(~answers & (F.size("_to") == 1), F.get("_to", F.lit(0))).otherwise(F.col("record_id")))
    if odd.isEmpty():
        return keyed.withColumn("capture_id", F.col("_key")).drop("_to", "_key")
    found = components(odd, "record_id", "_t")
    joined = keyed.join(found, F.col("_key") == F.col("node"), "left")
    return joined.withColumn("capture_id", F.coalesce("component", "_key")).drop("_to", "_key", "node", "component")


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, uri, request, response, metadata and ``others``.

    Members that an archive lacks are null; ``others`` are a capture's further records of
    these kinds.  Several records of one identifier are as many captures.  ``payload=False``
    leaves payloads out of the shuffle, but for metadata records.
    """
    kind = F.col("record_type")
    keep = F.when(F.lit(payload) | (kind == "metadata"), F.col("payload"))
    member = F.struct("record_id", "record_type", "refers_to", "uri", "payload_bytes", "payload_digest", "payload")
    answers = kind.isin("response", "revisit", "resource")
    slim = records.where(answers | kind.isin("request", "metadata")).withColumn("payload", keep)
    # without payloads the parsed records are small, and archives are read once
    keyed = capture_ids(slim if payload else write_table(slim, "records")).withColumn("_m", member)
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("_m"))))
    grouped = keyed.groupBy("capture_id").agg(pick(answers).alias("response"), pick(kind == "request").alias("request"), pick(kind == "metadata").alias("metadata"))
    # equal identifiers are copies, one a row; of different identifiers the first is the member
    copies = lambda c: F.array_min(F.transform(c, lambda m: m["record_id"])) == F.array_max(F.transform(c, lambda m: m["record_id"]))
    rows = lambda c: F.when(F.coalesce(copies(F.col(c)), F.lit(False)), F.col(c)).otherwise(F.slice(c, 1, 1))
    rest = lambda c: F.when(F.coalesce(copies(F.col(c)), F.lit(False)), F.slice(c, 1, 0)).otherwise(F.slice(c, 2, 1_000_000_000))
    kinds = ["response", "request", "metadata"]
    grouped = grouped.withColumn("others", F.concat(*(rest(c) for c in kinds))).withColumns({c: rows(c) for c in kinds})
    each = grouped.select("capture_id", F.posexplode(F.arrays_zip(*kinds)).alias("_i", "_c"), "others")
    uri = F.coalesce("_c.response.uri", "_c.request.uri", "_c.metadata.uri").alias("uri")
    return each.select("capture_id", uri, "_c.request", "_c.response", "_c.metadata", F.when(F.col("_i") == 0, F.col("others")).otherwise(F.slice("others", 1, 0)).alias("others"))


def page_number(urn: Column) -> Column:
    """The id inside one of this module's record identifiers; null if it is ``null``."""
    return F.regexp_extract(urn, URN + r"(-?\d+):", 1).try_cast("long")
