"""WARC archives written and read back, with record boundaries verified by their chain.

Writing: each page is one record; pages with equal payloads become revisits of the one with the
largest id. Spark's text writer ends every row with the blank line that ends a WARC record, so the
files are plain gzipped WARC in any store that Spark can write.

Reading: every place where a record seems to begin is a candidate, also inside payloads. Each
candidate names its successor from its Content-Length. Within a block of the file the successors are
followed at once to the first offset beyond the block; across blocks pointer jumping from the file's
start doubles the steps each round. Only candidates on the chain from the start are records.

Defined cases: a null payload is empty. Null urls are named by the page id, line ends in urls are
escaped. Rows that share both the largest id and the payload are each a response; a null id never is
the largest unless all ids of the payload are null, and then each row is a response. An empty table
writes no record and reads none.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrylens.llm.shared import saved

MAGIC = b"WARC/1.0\r\n"
CRLF = "\r\n"
#: Bytes of a file within which successors are followed in one go.
BLOCK = 1 << 20
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(column: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    hexa = F.sha1(column)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexa, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to, and whether the revisited payload is full."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    # Ids that are not the largest of their payload; joined by id, so that a common payload is spread out.
    again = (
        keys.distinct()
        .join(largest, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("none"), F.col("digest").alias("d"), "refers_to")
    )
    on = (F.coalesce("page_id", F.lit(-1)) == F.col("k")) & (F.col("page_id").isNull() == F.col("none")) & (F.col("digest") == F.col("d"))
    return rows.join(again, on, "left").select(
        "page_id", "url", "payload", "digest", "refers_to",
        F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
    )


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """One gzipped WARC file for each partition under ``path``."""
    typed = with_types(pages, id_col, url_col, payload_col, min_bytes)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    escaped = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(escaped, F.concat(F.lit("urn:page:"), page))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), body)
    typed.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF * 2).text(path)


def parse_header(content: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields and the offset of the block after them, or None where no record can begin."""
    end = content.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in content[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 4


def page_of(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value)
    return int(found[1]) if found else None


def candidates(content: bytes) -> list[dict]:
    """Every place that looks like a record: its offset, its successor's, and what its header says."""
    out = []
    at = content.find(MAGIC)
    while at >= 0:
        parsed = parse_header(content, at)
        if parsed:
            fields, start = parsed
            end = start + int(fields["content-length"])
            if content[end : end + 4] == b"\r\n\r\n":
                revisit = fields["warc-type"] == "revisit"
                named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                real = base64.b32encode(hashlib.sha1(content[start:end]).digest()).decode()
                out.append(
                    {
                        "at": at,
                        "next": end + 4,
                        "page_id": page_of(fields.get("warc-record-id", "")),
                        "record_type": fields["warc-type"],
                        "refers_to": page_of(fields.get("warc-refers-to", "")),
                        "payload_bytes": int(fields.get("x-payload-length", "0")) if revisit else end - start,
                        "payload_digest": named if revisit else real,
                    }
                )
        at = content.find(MAGIC, at + 1)
    return out


def scan(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Candidates of all files: file, block, at, next, exit (where its chain leaves the block), and the record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if content[:2] == b"\x1f\x8b":
                    content = zlib.decompress(content, 31)
                rows = pd.DataFrame(candidates(content))
                if not len(rows):
                    continue
                rows["file"], rows["file_bytes"] = path, len(content)
                rows["block"] = rows["at"] // block
                after, known = {}, set(rows["at"])
                for at, to in zip(rows["at"].to_numpy()[::-1].tolist(), rows["next"].to_numpy()[::-1].tolist()):
                    same = to // block == at // block
                    after[at] = after.get(to, -1) if same else to if to in known or to >= len(content) else -1
                rows["exit"] = [after[a] for a in rows["at"]]
                for c in ("page_id", "refers_to"):
                    rows[c] = rows[c].astype("Int64")
                yield rows

    return files.select("path", "content").mapInPandas(
        run, f"file string, file_bytes long, block long, at long, next long, exit long, {RECORD}"
    )


def on_chain(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches."""
    size = found.agg(F.max("file_bytes").alias("n"), F.max("block").alias("b")).first()
    rounds = max(1, math.ceil(math.log2((size["b"] or 0) + 2)))
    jump = saved(found.where("exit >= 0").select("file", "at", F.col("exit").alias("to")), "warc-jump")
    reached = found.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    for k in range(rounds):
        reached = saved(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        if k < rounds - 1:
            far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("on"))
            jump = saved(jump.join(far, ["file", "to"]).select("file", "at", F.col("on").alias("to")), "warc-jump")
    entries = reached.select("file", "at", F.lit(True).alias("entry"))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(pdf["at"], pdf["next"]))
        live: set[int] = set()
        for at in pdf["at"][pdf["entry"]].tolist():
            while at in to and at not in live:
                live.add(at)
                at = to[at]
        return pdf[pdf["at"].isin(live)][["file", "at", *names]]

    marked = found.join(entries, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(follow, f"file string, at long, {RECORD}")


def read_warc(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """One row per verified record: file, at, page_id, record_type, refers_to, payload_bytes, payload_digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return on_chain(saved(scan(files, block), "warc-candidates"))
