"""WARC archives: written by Spark's text writer, read back by boundary chains.

Writing: payloads are digested and compressed in the task that reads them, so
the one shuffle (by digest, to find the first of equal payloads) carries small
rows; records are then laid out as bytes and written with ``\\r\\n`` ends by
Spark's own writer, so any file system that Spark knows will do.

Reading: Spark's text reader splits the files at the record magic, also inside
one large file. Each chunk behind a magic is a candidate record; its task
emits (offset, offset of the successor by the declared length). Offsets inside
a file follow from a running sum of the bytes each split consumed. Within a
block, pointers are followed to where they leave it; pointer jumping from the
start of each file then runs over blocks only (the logarithm of their number
in rounds), and a pass over each block keeps the chain from where it is
entered: a magic inside a payload is never reached, whatever stands behind it. A record
whose payload holds the magic is put together from its chunks in a second scan
that is joined to such records only.

Defined results: NULL html is an empty payload; a NULL page_id is never
referred to, and rows with a NULL id revisit the smallest id with their
payload (all are responses if there is none); of repeated rows with the
smallest id all are responses; an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shared_folder

# Fixed values of the format and the contract.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"

#: Records per archive file.
RECORDS_PER_FILE = 4096


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        body = [x or b"" for x in b.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"),
             pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()),
             pa.array([len(x) for x in body], pa.int64()),
             pa.array([zlib.compress(x, 1) for x in body], pa.binary())],
            names=["page_id", "url", "sha", "size", "z"])


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to record bytes, without the last ``\\r\\n`` (the writer adds it)."""
    for b in batches:
        out = []
        for page, url, sha, first, z in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "sha", "refers_to", "z")]):
            body = b"" if first is not None else zlib.decompress(z)
            head = [("WARC-Type", "response" if first is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE),
                    ("WARC-Payload-Digest", f"sha256:{sha.hex()}"), ("Content-Type", "text/html"),
                    ("Content-Length", str(len(body)))]
            if url is not None:
                head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
            if first is not None:
                head += [("WARC-Refers-To", f"<urn:page:{first}>"),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
            text = "".join(f"{k}: {v}\r\n" for k, v in head).encode("ascii")
            out.append(MAGIC + text + b"\r\n" + body + b"\r\n")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str | None = "url",
                   payload: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row: the first (smallest id) of equal payloads of at
    least 100 bytes is a response, the others revisit it; the rest are responses."""
    bounded_batches(pages.sparkSession)
    uri = F.lit(None).cast("string") if url is None else F.col(f"`{url}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), uri.alias("url"),
                        F.col(f"`{payload}`").cast("binary").alias("payload"))
    rows = rows.mapInArrow(_digest, "page_id long, url string, sha binary, size long, z binary")
    narrow = (pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                           F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("p"))
              .filter(F.octet_length("p") >= MIN_REVISIT_BYTES)
              .select("page_id", F.unhex(F.sha2("p", 256)).alias("sha")))
    firsts = (narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select("sha", "first"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    (rows.join(firsts, "sha", "left")
     .select("page_id", "url", "sha", F.when(later, F.col("first")).alias("refers_to"), "z")
     .mapInArrow(_layout, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(path))


_FIELDS = ("type", "page_id", "refers_to", "digest", "uri")
_CANDIDATE = ("file string, block long, at long, span long, succ long, type string, page_id long, refers_to long, "
              "digest string, uri string, size long, whole boolean, sha string")


def _parse(chunk: bytes) -> dict | None:
    """Header fields of a candidate, with ``body`` (where the payload starts)
    and ``size``; None if it is no record header."""
    end = chunk.find(END)
    if end < 0:
        return None
    head = {}
    for line in chunk[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        return None
    page = re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get("warc-record-id", ""))
    first = re.fullmatch(r"<urn:page:(-?[0-9]+)>", head.get("warc-refers-to", ""))
    return {"type": head.get("warc-type"), "page_id": page and int(page[1]), "refers_to": first and int(first[1]),
            "digest": head.get("warc-payload-digest", "").removeprefix("sha256:"), "uri": head.get("warc-target-uri"),
            "body": end + len(END), "size": int(head["content-length"])}


def _scan(with_bytes: bool):
    """Chunks in file order to candidates. ``at``: offset of the magic counted
    from what the split consumed first; ``succ``: the successor, likewise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pos = None, 0
        for b in batches:
            out = {k: [] for k in ("file", "block", "at", "span", "succ", *_FIELDS, "size", "whole", "sha", "chunk")}
            for file, block, chunk in zip(*[b.column(c).to_pylist() for c in ("file", "block", "value")]):
                if (file, block) != here:
                    here, pos = (file, block), 0
                start = pos
                pos += len(chunk) + len(MAGIC)
                lead = block == 0 and start == 0  # what stands in front of the first magic
                h = None if lead else _parse(chunk)
                out["file"].append(file)
                out["block"].append(block)
                out["at"].append(start - len(MAGIC))
                out["span"].append(len(chunk) + len(MAGIC))
                for k in _FIELDS:
                    out[k].append(h and h[k])
                size = h and h["size"]
                out["size"].append(size)
                out["succ"].append(h and start + h["body"] + size + len(END))
                whole = bool(h) and len(chunk) >= h["body"] + size
                out["whole"].append(whole)
                out["sha"].append(hashlib.sha256(chunk[h["body"]:h["body"] + size]).hexdigest() if whole and not with_bytes else None)
                out["chunk"].append(chunk if with_bytes else None)
            types = {"file": pa.string(), "type": pa.string(), "digest": pa.string(), "uri": pa.string(), "sha": pa.string(),
                     "whole": pa.bool_(), "chunk": pa.binary()}
            names = [k for k in out if with_bytes or k != "chunk"]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], types.get(k, pa.int64())) for k in names], names=names)
    return run


def _candidates(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    raw = (spark.read.option("lineSep", MAGIC.decode()).text(path)
           .select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
           .toDF("file", "block", "value"))
    return raw.mapInArrow(_scan(with_bytes), _CANDIDATE + (", chunk binary" if with_bytes else ""))


def _placed(cand: DataFrame, blocks: DataFrame) -> DataFrame:
    """Offsets from the start of the file."""
    return cand.join(blocks, ["file", "block"]).withColumns(
        {"at": F.col("at") + F.col("base"), "succ": F.col("succ") + F.col("base")}).drop("base", "span")


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates from the end of each block to its start: where the chain
    that starts at each of them leaves the block."""
    here, leaves = None, {}
    for b in batches:
        out = []
        for file, block, at, succ in zip(*[b.column(c).to_pylist() for c in ("file", "block", "at", "succ")]):
            if (file, block) != here:
                here, leaves = (file, block), {}
            leaves[at] = leaves.get(succ, succ)
            out.append(leaves[at])
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), pa.array(out, pa.int64())], names=["file", "at", "nxt"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each block in order: which are on the chain from its entry."""
    here, due = None, None
    for b in batches:
        keep = []
        for k, (file, block, at, succ, entry) in enumerate(zip(*[b.column(c).to_pylist() for c in ("file", "block", "at", "succ", "entry")])):
            if (file, block) != here:
                here, due = (file, block), None
            if entry or at == due:
                keep.append(k)
                due = succ
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("file").take(keep), b.column("at").take(keep)], names=["file", "at"])


def reachable(nodes: DataFrame) -> DataFrame:
    """``(file, at)`` of the candidates that the chain from offset 0 reaches.
    ``nodes``: ``(file, block, at, succ)``. Offsets only grow, so the chain
    enters a block once at most. Each round doubles both how far a pointer
    jumps over blocks and how many entries are marked."""
    blocks = nodes.select("file", "block", "at", "succ").repartition("file", "block")
    leaves = blocks.sortWithinPartitions("file", "block", F.desc("at")).mapInArrow(_exits, "file string, at long, nxt long")
    state = cut(leaves.withColumn("hit", F.col("at") == 0))
    while state.filter(F.col("hit") & F.col("nxt").isNotNull()).limit(1).count():
        ahead = state.select("file", F.col("at").alias("nxt"), F.col("nxt").alias("nxt2"))
        hop = state.join(ahead, ["file", "nxt"], "left")
        rows = hop.select("file", "at", F.col("nxt2").alias("nxt"), "hit", F.lit(True).alias("real")).unionAll(
            state.filter(F.col("hit") & F.col("nxt").isNotNull())
            .select("file", F.col("nxt").alias("at"), F.lit(None).cast("long").alias("nxt"), F.lit(True).alias("hit"),
                    F.lit(False).alias("real")))
        state = cut(rows.groupBy("file", "at").agg(F.max("nxt").alias("nxt"), F.max("hit").alias("hit"), F.max("real").alias("real"))
                    .filter("real").drop("real"))
    entries = state.filter("hit").select("file", "at", F.lit(True).alias("entry"))
    marked = nodes.join(entries, ["file", "at"], "left").select("file", "block", "at", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.repartition("file", "block").sortWithinPartitions("file", "block", "at").mapInArrow(_walk, "file string, at long")


def _join_chunks(spark: SparkSession, path: str, blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """``(file, at, payload)`` of the records in ``marked`` (``file, at, owner,
    size``: all chunks of each record, with the record's offset as owner)."""
    chunks = _placed(_candidates(spark, path, True), blocks).select("file", "at", "chunk")
    parts = chunks.join(marked, ["file", "at"])
    joined = parts.groupBy("file", F.col("owner").alias("at")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct(F.col("at").alias("k"), "chunk"))).alias("c"))
    whole = F.concat(F.lit(b""), F.aggregate(
        F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.get("c", F.lit(0))["chunk"],
        lambda a, x: F.concat(a, F.lit(MAGIC), x["chunk"])))
    body = F.length(F.substring_index(F.decode(F.col("w"), "ISO-8859-1"), "\r\n\r\n", 1)) + len(END)
    return joined.select("file", "at", "size", whole.alias("w")).select(
        "file", "at", F.col("w").substr(body + 1, F.col("size").cast("int")).alias("payload"))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record: ``file, at, type, page_id, refers_to, digest, uri,
    size, sha`` (SHA-256 of the payload as read) and, if asked, ``payload``."""
    bounded_batches(spark)
    cand = cut(_candidates(spark, path))
    in_order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (cand.groupBy("file", "block").agg(F.sum("span").alias("span"))
              .select("file", "block", F.coalesce(F.sum("span").over(in_order), F.lit(0)).alias("base")))
    placed = cut(_placed(cand, blocks))
    hits = reachable(placed.filter(F.col("succ").isNotNull()))
    marks = placed.join(hits.withColumn("hit", F.lit(True)), ["file", "at"], "left")
    records = cut(marks.filter("hit").drop("hit", "block"))
    parts = records if payload else records.filter(~F.col("whole"))
    if parts.limit(1).count() == 0:
        out = records.drop("succ", "whole")
        return out.withColumn("payload", F.lit(None).cast("binary")) if payload else out
    upto = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    owners = marks.select("file", "at", F.last(F.when(F.col("hit"), F.col("at")), ignorenulls=True).over(upto).alias("owner"))
    wanted = parts.select("file", F.col("at").alias("owner"), "size")
    bodies = _join_chunks(spark, path, blocks, owners.join(wanted, ["file", "owner"]))
    out = records.join(bodies, ["file", "at"], "left").withColumn("sha", F.coalesce("sha", F.sha2("payload", 256)))
    return out.drop("succ", "whole") if payload else out.drop("succ", "whole", "payload")


def op2_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_folder(spark, "warc")
    write_archives(pages, path)
    records = cut(read_archives(spark, path))
    responses = records.filter("type = 'response'")
    firsts = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("sha").alias("digest")).agg(F.max("size").alias("bytes"))
    revisits = records.filter("type = 'revisit'").join(firsts, ["refers_to", "digest"])
    return responses.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"),
                            F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
                            ).unionAll(revisits.select("page_id", "bytes", "digest", "type", "refers_to"))


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
t AS (SELECT *, payload_bytes >= {MIN_REVISIT_BYTES} AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM t
"""
