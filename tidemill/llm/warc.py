"""WARC archives as tables of chunks.

An archive is a Parquet table with one row per record and chunk number; the
chunks of a record in order are its bytes. Payloads pass through tasks chunk by
chunk with a running SHA-1, whose value after each chunk is stored beside it, so
a task never holds a record whole and a reader can tell where one is damaged.
Payloads that repeat are stored once, and the other records refer to that one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.work import checkpoint_dir, own_columns, settled, small

CHUNK_BYTES = 1 << 14
BROADCAST_ROWS = 200_000
ARCHIVE = "record bigint, chunk int, data binary, sha1 string"
#: Written into each record; the time of the crawl isn't in the tables.
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header(page, url, kind, refers, n, digest) -> bytes:
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page is None else page}>")
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n if kind == 'response' else 0}"]
    return "\r\n".join(lines).encode() + _END


def _write(batches):
    sha = None
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            at = {k: columns[k][i].as_py() for k in ("record", "chunk", "chunks", "kind")}
            if at["chunk"] == 0:
                sha = hashlib.sha1()
                head = {k: columns[k][i].as_py() for k in ("page", "url", "kind", "refers", "n", "hex")}
                digest = base32(bytes.fromhex(head.pop("hex")))
                rows.append((at["record"], 0, _header(**head, digest=digest) + (_END if at["kind"] == "revisit" else b""), sha.hexdigest()))
            if at["kind"] == "response":
                data = columns["data"][i].as_py()
                sha.update(data)
                last = at["chunk"] == at["chunks"] - 1
                rows.append((at["record"], at["chunk"] + 1, data + _END if last else data, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))], ["record", "chunk", "data", "sha1"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, chunk: int = CHUNK_BYTES) -> None:
    """Writes one record per row of pages to a new archive at path, which all executors must share.

    Of payloads that are equal and have at least so many bytes, the one with the
    largest id is a response and the others revisit it; all rows that repeat
    that id are responses. Null texts are empty payloads. A null id revisits the
    others' record, and is a response if all are null. A payload's digest, which
    its header and the search for equal ones need first, is Spark's; the running
    one of the chunks confirms it. A text of any length is one row of the table and so in memory as
    Spark reads it; from there it goes on in chunks. Null urls stay null, other
    columns aren't read, and an empty table gives an empty archive.
    """
    page = own_columns(pages, {"page": id_col, "url": url_col, "html": html_col}).withColumn("page", F.col("page").cast("bigint"))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = page.select("page", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"hex": F.sha1("payload"), "n": F.octet_length("payload")})
    owners = keyed.where(F.col("n") >= least).groupBy("hex").agg(F.max("page").alias("owner"), F.count("*").alias("rows")).where("rows > 1 AND owner IS NOT NULL")
    owners = small(settled(owners.select("hex", "owner")), BROADCAST_ROWS)
    revisits = F.col("owner").isNotNull() & ~F.col("page").eqNullSafe(F.col("owner"))
    typed = keyed.join(owners, "hex", "left").withColumns({"kind": F.when(revisits, "revisit").otherwise("response"), "refers": F.when(revisits, F.col("owner")), "record": F.monotonically_increasing_id()})
    chunks = F.when(F.col("kind") == "revisit", 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))).cast("int")
    dealt = typed.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(F.col("kind") == "response", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    rows = dealt.select("record", "chunk", "chunks", "page", "url", "kind", "refers", "n", "hex", data.alias("data"))
    rows.mapInArrow(_write, ARCHIVE).write.parquet(path)


def _field(lines: list[str], name: str) -> str | None:
    return next((x[len(name) + 2 :] for x in lines if x.startswith(name + ": ")), None)


def _id(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


_RECORD = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("cut", pa.int64())]
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, cut bigint"


def _read(batches):
    """A row for each record whose chunks follow each other here, and one with its number in ``cut`` for each that lacks some."""
    state, rows = None, []

    def cut(record):
        if record is not None:
            rows.append((None, None, None, None, None, record))

    for batch in batches:
        for record, chunk, data, sha1 in zip(*(batch.column(i) for i in range(4)), strict=True):
            record, chunk, data = record.as_py(), chunk.as_py(), data.as_py()
            if chunk == 0:
                cut(state and state["open"])
                head, data = data.split(_END, 1)
                lines = head.decode().split("\r\n")
                state = {"open": record, "record": record, "next": 0, "lines": lines, "left": int(_field(lines, "Content-Length")), "sha": hashlib.sha1(), "tail": b""}
            elif state is None or state["record"] != record or state["next"] != chunk:  # its beginning is elsewhere
                if state and state["record"] != record:
                    cut(state["open"])
                if state is None or state["record"] != record or state["open"] is not None:
                    cut(record)
                state = {"open": None, "record": record, "next": -1}
                continue
            state["next"] += 1
            part = data[: state["left"]]
            state["left"] -= len(part)
            state["sha"].update(part)
            state["tail"] += data[len(part) :]
            if state["sha"].hexdigest() != sha1.as_py() or len(state["tail"]) > len(_END):
                raise ValueError(f"record {record} is damaged in chunk {chunk}")
            if state["left"] == 0 and state["tail"] == _END:
                lines, state["open"] = state["lines"], None
                kind, digest = _field(lines, "WARC-Type"), _field(lines, "WARC-Payload-Digest").removeprefix("sha1:")
                if kind == "response" and base32(state["sha"].digest()) != digest:
                    raise ValueError(f"record {record} has another digest than its header says")
                rows.append((_id(_field(lines, "WARC-Record-ID")), int(_field(lines, "X-Payload-Length")), digest, kind, _id(_field(lines, "WARC-Refers-To")), None))
        yield _records(rows)
        rows.clear()
    cut(state and state["open"])
    yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_RECORD)], [n for n, _ in _RECORD])


def _whole(batches):
    for batch in _read(batches):
        if batch.column(5).null_count < batch.num_rows:
            raise ValueError(f"record {next(x for x in batch.column(5).to_pylist() if x is not None)} lacks chunks")
        yield batch


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of an archive: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Digests of responses are those of the bytes read; a chunk that differs from
    what was written raises an error naming it, and so does a record that lacks
    chunks. A record's chunks are written one after the other, so most records
    are read where they lie; only those that Spark's splits cut, or whose chunks
    somebody has dealt anew, are brought together by record, in order. Payloads
    of any length pass chunk by chunk; an empty archive gives an empty result.
    """
    chunks = spark.read.schema(ARCHIVE).parquet(path)
    found = settled(chunks.mapInArrow(_read, RECORD))
    done = found.where("cut IS NULL").drop("cut")
    cut = settled(found.where("cut IS NOT NULL").select(F.col("cut").alias("record")).distinct())
    if cut.isEmpty():
        return done
    rest = chunks.join(small(cut, BROADCAST_ROWS), "record", "left_semi").select("record", "chunk", "data", "sha1")
    rest = rest.repartition("record").sortWithinPartitions("record", "chunk")
    return done.union(rest.mapInArrow(_whole, RECORD).drop("cut"))


def new_archive_path(spark: SparkSession) -> str:
    """A path that nothing has used, in the folder that executors share."""
    return f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"


#: The query in DuckDB's SQL; five hex digits at a time become four base-32 ones.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
o AS (SELECT hex, max(page_id) AS owner FROM d GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d JOIN o USING (hex)"""
