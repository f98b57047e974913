"""WARC archives with revisit resolution.

Header rows (id, url, digest, length) are grouped by payload digest; of the
records with one payload, the one with the largest id keeps it as a response
and the others become revisit records that refer to it. Revisit records are
written from header rows alone. Rows with payloads are only asked whether they
are revisits: by a broadcast while the shared digests are few, else by a
shuffle that the revisits of hot payloads never enter. Archives are written
with fresh headers by Spark's own text writer, a record a row, so they can lie
in any store that Spark writes to; reading parses records by their
Content-Length, checks every payload against its digest and joins revisits to
their responses, hot ones apart. Payloads of one kind of size are written
together, so a file holds ``FILE_BYTES`` of them or one record.

Edge cases: a null payload is empty; payloads below ``least_bytes`` are always
responses; a null id writes no id header and reads back as null, and never
becomes the response of a group that has an id; rows that repeat the largest
id of a group are all responses; an empty table gives empty archives; control
characters in a url are percent-encoded on writing; a very long payload is one
record in a file of its own, which a reader holds once; a revisit whose
response isn't in the archives reads back without length and target, and is
rewritten as an empty response; other columns, of whatever name, aren't
archived.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import BROADCAST_BYTES, HOT_ROWS, HOT_SHARE, joined_to_groups, new_path, small, stored

VERSION = "WARC/1.1"
#: Ends a record; the text writer puts it after each.
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000
#: Bytes of payload that a file of several records holds at most, so that a reader's memory is bounded by a file.
FILE_BYTES = 128 << 20
#: Largest payloads of the kinds of records that are written together; beyond the last, each record has its own file.
KINDS = (1 << 16, 1 << 20, 1 << 24)
#: Bytes of a row of shared digests: 40 of the digest, two longs, and their places.
SHARED_BYTES = 80


def _columns(id_col: str, url_col: str, payload_col: str) -> tuple[list[Column], Column]:
    """Header columns (page_id, url, payload_bytes, payload_digest) of a table of pages, and its payload as text."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    payload = F.encode(text, "UTF-8")
    return [F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")], text


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Narrow header rows: page_id, url, payload_bytes, payload_digest."""
    return pages.select(*_columns(id_col, url_col, payload_col)[0])


def originals(header_rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """payload_digest, original_id and n (its records) of each payload that several records share."""
    shared = header_rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original_id"), F.count("*").alias("n"))
    return shared.where("n > 1 and original_id is not null").select("payload_digest", "original_id", "n")


def revisits(header_rows: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """Header rows of revisits, with record_type and refers_to; ``total`` is the number of header rows."""
    joined = joined_to_groups(header_rows, shared, ["payload_digest"], "n", total)
    again = joined.where(~F.col("page_id").eqNullSafe(F.col("original_id")))
    return again.drop("n").withColumnRenamed("original_id", "refers_to").withColumn("record_type", F.lit("revisit"))


def responses(rows: DataFrame, shared: DataFrame, total: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (page_id, payload_digest and others) that aren't revisits, with record_type and refers_to.

    More shared digests than ``broadcast_bytes`` are shuffled, but the hot ones,
    fewer than ``HOT_SHARE``, have dropped their revisits before.
    """
    named = shared.select(F.col("payload_digest").alias("_digest"), F.col("original_id").alias("_original"), "n")
    revisit = (F.col("payload_digest") == F.col("_digest")) & ~F.col("page_id").eqNullSafe(F.col("_original"))
    if shared.count() * SHARED_BYTES <= broadcast_bytes:
        left = rows.join(F.broadcast(named), revisit, "left_anti")
    else:
        hot = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
        left = rows.join(F.broadcast(named.where(hot)), revisit, "left_anti").join(named.where(~hot), revisit, "left_anti")
    return left.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(shared.schema["original_id"].dataType)})


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def record(url: Column, payload: Column) -> Column:
    """The text of a record, without its end, from page_id, payload_digest, payload_bytes, record_type and refers_to."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("payload_bytes")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), " ", "%20")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", safe),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), _line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", length),
        F.lit("\r\n"),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(payload))


def _kind(size: Column) -> Column:
    return sum(((size > most).cast("int") for most in KINDS), F.lit(0))


def _written(header_rows: DataFrame, rows: DataFrame, path: str, least_bytes: int) -> None:
    """Archives of stored header rows; ``rows`` have the payloads (``_payload``, text) of all that can be responses."""
    shared = stored(originals(header_rows, least_bytes), "warc-originals")
    total = header_rows.count()

    def write(records: DataFrame, payload: Column, name: str, most: int) -> None:
        out = records.select(record(F.col("url"), payload).alias("value")).write
        out.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(f"{path}/{name}")

    write(revisits(header_rows, shared, total), F.lit(""), "revisits", FILE_BYTES // KINDS[0])
    kinds = sorted(r[0] for r in header_rows.select(_kind(F.col("payload_bytes"))).distinct().collect())  # four at most
    for kind in kinds:
        of_kind = rows.where(_kind(F.octet_length("_payload")) == kind)
        write(responses(of_kind, shared, total), F.col("_payload"), f"responses-{kind}", FILE_BYTES // KINDS[kind] if kind < len(KINDS) else 1)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Resolve revisits and write gzipped archives below ``path``, in a folder of revisits and one for each kind of size."""
    columns, text = _columns(id_col, url_col, payload_col)
    _written(stored(pages.select(*columns), "warc-headers"), pages.select(*columns, text.alias("_payload")), path, least_bytes)


def _unzipped(data: bytes) -> Iterator[bytes]:
    """Blocks of a file that is plain or made of one or more gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        while data and not z.eof:
            yield z.decompress(data, 1 << 22)
            data = z.unconsumed_tail
        data = z.unused_data


def parsed(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; memory holds one record and one block."""
    buffer, blocks = b"", iter(blocks)

    def until(n: int) -> bool:
        nonlocal buffer
        parts, have = [buffer], len(buffer)
        while have < n and (more := next(blocks, None)) is not None:
            parts.append(more)
            have += len(more)
        buffer = b"".join(parts)
        return have >= n

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not until(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("an archive ends inside a header")
                return
        lines = buffer[:at].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = at + 4, int(fields["content-length"])
        if not until(start + n + 4):
            raise ValueError("an archive ends inside a record")
        yield fields, buffer[start : start + n]
        buffer = buffer[start + n + 4 :]


READ = "page_id long, url string, record_id string, record_type string, refers_to_record string, payload_digest string, payload_bytes long"


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; with ``payloads`` also ``payload`` (binary, null for revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows: list[tuple] = []
                held = 0
                for f, block in parsed(_unzipped(bytes(data))):
                    body = block.partition(b"\r\n\r\n")[2]
                    digest = f["warc-payload-digest"].partition(":")[2]
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
                    page = f.get("warc-page-id")
                    row = (None if page is None else int(page), f.get("warc-target-uri"), f["warc-record-id"], f["warc-type"], f.get("warc-refers-to"), digest, None if revisit else len(body))
                    rows.append(row + ((None if revisit else body,) if payloads else ()))
                    held += len(body) if payloads else 0
                    if held > 1 << 24:
                        yield framed(rows)
                        rows, held = [], 0
                yield framed(rows)

    def framed(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=names)
        return df.astype({"page_id": "Int64", "payload_bytes": "Int64"})

    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payloads
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, READ + (", payload binary" if payloads else ""))


def joined_revisits(records: DataFrame, *others: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and ``others``; revisits take length and id from the response they refer to."""
    kept = ["page_id", "payload_digest", "record_type", *others]
    target = F.coalesce("refers_to_record", F.lit("")).alias("record_id")
    records = stored(records.select(*kept, "payload_bytes", "record_id", "refers_to_record"), "warc-read")
    own, again = records.where("record_type = 'response'"), records.where("record_type = 'revisit'").select(*kept, target)
    wanted = stored(again.groupBy("record_id").agg(F.count("*").alias("n")), "warc-wanted")
    found = own.join(small(wanted, 80), "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"))
    targets = stored(wanted.join(found, "record_id", "left"), "warc-targets")
    again = joined_to_groups(again, targets, ["record_id"], "n", again.count()).drop("record_id", "n")
    return own.select(*kept, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *others)


def rewrite(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Deduplicate archives below ``source`` into ``target``, with fresh headers.

    Payloads must be UTF-8 text. A revisit of the source is given a payload only
    if it becomes a response; all others stay header rows.
    """
    records = stored(read_records(spark, source, payloads=True), "warc-rewrite")
    lost = F.col("payload_bytes").isNull()
    narrow = joined_revisits(records.drop("payload"), "url").withColumns({"payload_digest": F.when(lost, F.sha1(F.lit("").cast("binary"))).otherwise(F.col("payload_digest")), "payload_bytes": F.coalesce("payload_bytes", F.lit(0).cast("long"))})
    narrow = stored(narrow, "warc-headers")
    header_rows = narrow.select("page_id", "url", "payload_bytes", "payload_digest")
    bodies = records.where("record_type = 'response'").select("page_id", "url", "payload_bytes", "payload_digest", F.decode("payload", "UTF-8").alias("_payload"))
    again = narrow.where("record_type = 'revisit'").select(*header_rows.columns)
    needy = stored(responses(again, stored(originals(header_rows, least_bytes), "warc-originals"), header_rows.count()).select(*header_rows.columns), "warc-needy")
    wanted = small(stored(needy.select("payload_digest").distinct(), "warc-wanted"), SHARED_BYTES)
    one = bodies.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.first("_payload").alias("_payload"))
    given = needy.join(one, "payload_digest", "left").select(*header_rows.columns, F.coalesce("_payload", F.lit("")).alias("_payload"))
    _written(header_rows, bodies.unionByName(given), target, least_bytes)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to archives on the shared folder, read them back and join the revisits."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, **columns)
    return joined_revisits(read_records(spark, path))
