"""WARC archives: writing pages, and reading with boundary-chain verification.

Writing. A record is one string that ends, with the writer's line separator, in the two
line ends the format asks for, so Spark's text writer makes the archives on any file
system it knows, gzipped. Payloads that equal an earlier-chosen one become revisit
records; the choice is an aggregate over digests, so page texts are not shuffled unless
the duplicate digests are too many for a broadcast of checked size.

Reading. Spark's text reader cuts the bytes of the archives at the version line, split by
split. Payloads can hold that line too, so every cut is only a candidate. A split's bytes
are divided into parts of about a megabyte; each task emits, for every candidate, the
offset of the successor that the record's length implies, and where the chain from it
leaves its part. Pointer jumping over these exits, from the start of each file, finds the
candidate at which the true chain enters each part (log2 of a file's parts in rounds).
Within a part chains only merge, so they form trees; a candidate carries its interval in
the tree's order, and those on the chain are the ones whose interval holds the entry: a
join, no walk. A record whose payload was cut is put together from its pieces. Gzipped
archives are one split a file, but have as many parts as plain ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a part of a split.
PART = 1 << 20


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, keeper): payload digests that several pages share, and the page that keeps the payload."""
    return pages.where(F.octet_length("_payload") >= least_bytes).groupBy(F.sha1("_payload").alias("digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")


def records(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """(value): the text of each page's record, without the two line ends that close it."""
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_payload"))
    shared = scratch.keep(revisits(src, least_bytes), "shared")
    digest = F.sha1("_payload")
    # only payloads that are long enough can be shared: the others stay out of the join's way
    src = src.withColumn("_digest", digest).withColumn("_key", F.when(F.octet_length("_payload") >= least_bytes, F.col("_digest")))
    src = src.join(shared, F.col("_key") == F.col("digest"), "left")
    again = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    maybe = lambda k, v: F.coalesce(line(k, v), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("_payload").cast("string")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("_payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head: Column = F.concat(
        F.lit(VERSION.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        maybe("WARC-Refers-To", F.when(again, name(F.col("keeper")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return src.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, scratch: Scratch, *, least_bytes: int = LEAST_BYTES, date: str = DATE, compression: str | None = "gzip", records_per_file: int = 50_000) -> None:
    """Write one WARC record per row of pages (page_id, url, html) below path."""
    out = records(pages, scratch, least_bytes, date).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    (out.option("compression", compression) if compression else out).text(path)


def parse_head(segment: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Header fields (names in small letters) and where the block starts; None if it is no header."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in segment[:end].split(b"\r\n"):
        k, colon, v = row.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower()] = v.strip()
    return (fields, end + 4) if fields.get(b"content-length", b"").isdigit() else None


def _page(name: bytes | None) -> int | None:
    number = (name or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number.lstrip(b"-").isdigit() else None


def _payload(fields: dict[bytes, bytes], block: bytes) -> tuple[int, str, str, int | None, int | None]:
    """(payload bytes, digest, type, page, refers to) of a whole record."""
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    cut = block.find(b"\r\n\r\n") if fields.get(b"content-type", b"").startswith(b"application/http") else -4
    body = block[cut + 4 :]
    told = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    if kind == "revisit":
        head = parse_head(block[block.find(b"\r\n") + 2 :])
        size, digest = int(head[0][b"content-length"]) if head else 0, told
    else:
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        if told and told != digest:
            raise ValueError(f"payload of {fields.get(b'warc-record-id')!r} has digest {digest}, its record says {told}")
    return size, digest, kind, _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to"))


PAYLOAD = "payload_bytes long, payload_digest string, record_type string, page_id long, refers_to long"
CANDIDATE = "file string, split long, part int, off long, succ long, leaves long, low int, high int, split_bytes long, " + PAYLOAD
RECORD = "file string, off long, succ long, " + PAYLOAD
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _table(ddl: str, rows: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(_names(ddl))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[x.split()[1]]) for c, x in zip(cols, ddl.split(", "), strict=True)], names=_names(ddl))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bool, bytes]]:
    """(file, split, offset in the split, whether a version line comes before it, bytes), in order."""
    at, offset = None, 0
    for b in batches:
        for value, file, split in zip(b.column("value").to_pylist(), b.column("file").to_pylist(), b.column("split").to_pylist(), strict=True):
            fresh = at != (file, split)
            if fresh:
                at, offset = (file, split), 0
            cut = not (fresh and split == 0)
            yield file, split, offset, cut, value
            offset += len(value) + len(VERSION) * cut


def chain_order(off: list[int], succ: list[int], part: list[int], size: int) -> tuple[list, list[int], list[int]]:
    """(leaves, low, high) of the candidates of one split, which come in order of offset.

    leaves: where the chain first meets another part or split, None if it breaks before.
    low, high: candidate c is on the chain from e, in one part, just if low[c] <= low[e] < high[c].
    """
    at = {o: i for i, o in enumerate(off)}
    n = len(off)
    leaves, up, weight = [None] * n, [-1] * n, [1] * n
    for i in range(n - 1, -1, -1):
        j = at.get(succ[i])
        if succ[i] >= size or (j is not None and part[j] != part[i]):
            leaves[i] = succ[i]
        elif j is not None:
            # a chain that points inside the split at no candidate is broken: it leads nowhere
            leaves[i], up[i] = leaves[j], j
    for i in range(n):
        if up[i] >= 0:
            weight[up[i]] += weight[i]
    low, free, roots = [0] * n, [0] * n, 0
    for i in range(n - 1, -1, -1):
        if up[i] < 0:
            low[i], roots = roots, roots + weight[i]
        else:
            low[i], free[up[i]] = free[up[i]], free[up[i]] + weight[i]
        free[i] = low[i] + 1
    return leaves, low, [a + w for a, w in zip(low, weight, strict=True)]


def _candidates(part_bytes: int):
    """Every candidate of every split, with its successor and where its chain leaves the part."""

    def closed(at: tuple, rows: list[tuple], size: int) -> pa.RecordBatch:
        off, succ = [r[0] for r in rows], [r[1] for r in rows]
        part = [o // part_bytes for o in off]
        leaves, low, high = chain_order(off, succ, part, size)
        out = [(*at, p, o, s, x, a, b, size, *r[2:]) for p, o, s, x, a, b, r in zip(part, off, succ, leaves, low, high, rows, strict=True)]
        # a row without offset stands for the split itself, which may have no candidate
        return _table(CANDIDATE, [(*at, 0, -1, -1, None, 0, 0, size, *(None,) * 5), *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, end = None, [], 0
        for file, split, offset, cut, value in _segments(batches):
            if at != (file, split):
                if at:
                    yield closed(at, rows, end)
                at, rows = (file, split), []
            end = offset + len(value) + len(VERSION) * cut
            if cut and (found := parse_head(value)):
                fields, start = found
                length = int(fields[b"content-length"])
                succ = offset + len(VERSION) + start + length + 4
                whole = _payload(fields, value[start : start + length]) if succ == end else (None,) * 5
                rows.append((offset, succ, *whole))
        if at:
            yield closed(at, rows, end)

    return run


def entries(cand: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, off): the candidate at which the true chain enters each part, offsets in the file.

    Pointer jumping: what is reached doubles its reach each round.
    """
    jump = cand.select("file", "off", "leaves")
    targets = jump.where("leaves is not null").select("file", F.col("leaves").alias("off")).distinct()
    # only candidates that some chain enters from another part, and the start of each file, matter
    jump = jump.where("off = 0").union(jump.join(targets, ["file", "off"], "left_semi")).distinct()
    jump = scratch.keep(jump.where("leaves is not null or off = 0"), "jump0")
    reach = jump.where("off = 0").select("file", "off")
    most = cand.groupBy("file").agg(F.count_distinct("split", "part").alias("n")).agg(F.max("n")).first()[0] or 1
    for i in range((most - 1).bit_length()):
        further = reach.join(jump, ["file", "off"]).where("leaves is not null").select("file", F.col("leaves").alias("off"))
        reach = scratch.keep(reach.union(further).distinct(), f"reach{i}")
        to = jump.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("next"))
        jump = scratch.keep(jump.join(to, ["file", "leaves"]).select("file", "off", F.col("next").alias("leaves")), f"jump{i + 1}")
    return reach


def read_archives(spark: SparkSession, path: str, scratch: Scratch, *, part_bytes: int = PART) -> DataFrame:
    """One row per reachable record of the archives below path: file, offset, succ, and PAYLOAD's fields.

    offset is the record's place in its (decompressed) file. Bytes before a file's first
    record, or a chain that breaks, end that file's records there. No archives or empty
    ones: no rows.
    """
    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    local = scratch.keep(lines.mapInArrow(_candidates(part_bytes), CANDIDATE), "candidates", rows=200)
    splits = local.groupBy("file", "split").agg(F.max("split_bytes").alias("size"))
    base = splits.selectExpr("file", "split", "coalesce(sum(size) over (partition by file order by split rows between unbounded preceding and 1 preceding), 0) as base")
    base = scratch.keep(base, "base")
    cand = local.join(base, ["file", "split"]).where("off >= 0")
    cand = cand.withColumns({c: F.col(c) + F.col("base") for c in ("off", "succ", "leaves")})
    cand = scratch.keep(cand, "chained")
    reach = entries(cand, scratch)
    entry = reach.join(cand.select("file", "split", "part", "off", "low"), ["file", "off"]).select("file", "split", "part", F.col("low").alias("entry"))
    true = cand.join(entry, ["file", "split", "part"]).where("low <= entry and entry < high")
    found = scratch.keep(true.select("split", *_names(RECORD)), "reachable")
    cut = found.where("payload_digest is null")
    whole = found.drop("split")
    if cut.head(1):
        whole = whole.where("payload_digest is not null").unionByName(_joined(lines, base, cut))
    return whole.withColumnRenamed("off", "offset")


def _joined(lines: DataFrame, base: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds the version line, put together from their parts.

    A group is one record, so its size is that of a record.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, offset, found, value in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split], pa.int64()), pa.array([offset], pa.int64()), pa.array([VERSION + value if found else value], pa.binary())], names=["file", "split", "at", "part"])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        record = b"".join(table.column("part").to_pylist())
        off, succ = table.column("off")[0].as_py(), table.column("succ")[0].as_py()
        fields, start = parse_head(record[len(VERSION) :])
        start += len(VERSION)
        row = (table.column("file")[0].as_py(), off, succ, *_payload(fields, record[start : start + int(fields[b"content-length"])]))
        return pa.Table.from_batches([_table(RECORD, [row])])

    pieces = lines.mapInArrow(parts, "file string, split long, at long, part binary").join(base, ["file", "split"])
    pieces = pieces.select("file", (F.col("at") + F.col("base")).alias("at"), "part")
    # a piece belongs to the records whose range it starts in; blocks of a megabyte make that an equi-join
    block = 1 << 20
    spans = cut.select("file", "off", "succ", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("succ") - 1) / block))).alias("_b"))
    inside = pieces.withColumn("_b", F.floor(F.col("at") / block)).join(spans, ["file", "_b"]).where("at >= off and at < succ")
    return inside.select("file", "off", "succ", "at", "part").groupBy("file", "off").applyInArrow(whole, RECORD)


def archive_round_trip(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, compression: str | None = "gzip", part_bytes: int = PART) -> DataFrame:
    """Write pages as archives in the shared folder and read the records back.

    A null html is an empty payload, a null url leaves its field out. Pages with a null
    page_id are written under no number; among equal payloads they are revisits unless
    all are null. Rows that share the largest page_id of equal payloads are all
    responses. No rows: none back. Other columns than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.path("archives"), scratch, least_bytes=least_bytes, compression=compression)
    out = scratch.keep(read_archives(spark, scratch.path("archives"), scratch, part_bytes=part_bytes), "records", rows=200)
    scratch.drop("archives", "candidates", "chained", "shared", "reachable")
    return out


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    got = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""
}
