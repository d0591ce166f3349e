"""Delimited files as (row_number, fields), cell for cell as Python's csv module reads them.

Spark's own reader trims, splits or merges records with mixed line ends and embedded newlines, so
quoted files are parsed whole: Spark's binary reader fetches each file (from any store Spark can
read), and one task parses it as a stream. A file that is declared to have no quotes and no carriage
returns is read in splits instead, in parallel; its record numbers come from the line counts of the
splits, one number each.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = codecs.BOM_UTF8
BATCH = 4096
#: Row numbers of what isn't a record: a failure of the whole file.
BAD_ENCODING, BAD_CSV = -1, -2


@dataclass(frozen=True)
class FileFacts:
    """What is known of a file besides its records."""

    sha256: str
    has_bom: bool
    has_cr: bool


def facts(spark: SparkSession, path: str) -> FileFacts:
    content = spark.read.format("binaryFile").load(path).select(
        F.sha2("content", 256), F.substring("content", 1, 3) == F.lit(bytearray(BOM)), F.contains(F.decode("content", "ISO-8859-1"), F.lit("\r"))
    )
    row = content.first()
    # an empty file gives no row; a missing one has failed before
    return FileFacts(*row) if row is not None else FileFacts(hashlib.sha256(b"").hexdigest(), False, False)


def _parse(delimiter: str, quotechar: str, encoding: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple[int, list[str]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.string()))], names=["row_number", "fields"])

        for b in batches:
            for value in b.column("content"):
                data = value.as_buffer().to_pybytes()
                if data.startswith(BOM) and codecs.lookup(encoding).name in ("utf-8", "utf-8-sig"):
                    data = data[len(BOM) :]
                found: list[tuple[int, list[str]]] = []
                try:
                    text = data.decode(encoding)
                    for n, record in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quotechar), 1):
                        found.append((n, record))
                        if len(found) == BATCH:
                            yield rows(found)
                            found = []
                except (UnicodeDecodeError, LookupError) as e:
                    found = [(BAD_ENCODING, [str(e)])]
                except csv.Error as e:
                    found.append((BAD_CSV, [str(e)]))
                if found:
                    yield rows(found)

    return scan


def read_records(spark: SparkSession, path: str, delimiter: str = ",", quotechar: str = '"', encoding: str = "utf-8", plain: bool = False) -> DataFrame:
    """All records of one file, the header as number 1. plain: no quotes and no carriage returns in it, UTF-8."""
    if not plain:
        content = spark.read.format("binaryFile").load(path).select("content")
        return content.mapInArrow(_parse(delimiter, quotechar, encoding), "row_number long, fields array<string>")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    splits = sorted((r["at"], r["least"], r["n"]) for r in lines.groupBy("at").agg(F.min("m").alias("least"), F.count("*").alias("n")).collect())
    shift, seen = [], 0
    for at, least, n in splits:
        shift += [F.lit(at), F.lit(seen + 1 - least).cast("long")]
        seen += n
    number = F.col("m") + F.element_at(F.create_map(*shift), F.col("at")) if shift else F.lit(0).cast("long")
    value = F.when(number == 1, F.ltrim(F.col("value"), F.lit("﻿"))).otherwise(F.col("value"))
    cells = F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, "\\Q" + delimiter + "\\E", -1))
    return lines.select(number.alias("row_number"), cells.alias("fields"))


# Candidate encodings, delimiters and sizes of the samples.
CHARSETS = ("shift_jis", "euc_jp", "gb18030", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
HEAD_BYTES, SNIFF_CHARS = 65536, 8192


@dataclass(frozen=True)
class FileShape:
    """What a profile says of a file's bytes: leading marks, the first byte that isn't UTF-8, line ends, the head."""

    boms: int = 0
    utf16: str | None = None
    bad_at: int | None = None
    bad_why: str | None = None
    crlf: int = 0
    cr: int = 0
    lf: int = 0
    head: bytes = b""


SHAPE = "boms int, utf16 string, bad_at long, bad_why string, crlf long, cr long, lf long, head binary"


def _bare(data: bytes) -> tuple[bytes, int]:
    """Bytes without any leading UTF-8 marks, and their number."""
    boms = 0
    while data.startswith(BOM, boms * len(BOM)):
        boms += 1
    return data[boms * len(BOM) :], boms


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for value in b.column("content"):
            data, boms = _bare(value.as_buffer().to_pybytes())
            mark = data[:2].hex() if not boms and data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) else None
            bad_at = bad_why = None
            body = data
            if mark:
                body = data.decode("utf-16", "replace").encode("utf-8", "replace")
            else:
                try:
                    data.decode("utf-8")
                except UnicodeDecodeError as e:
                    bad_at, bad_why = e.start, e.reason
            crlf = body.count(b"\r\n")
            row = {"boms": boms, "utf16": mark, "bad_at": bad_at, "bad_why": bad_why, "crlf": crlf, "cr": body.count(b"\r") - crlf, "lf": body.count(b"\n") - crlf, "head": data[:HEAD_BYTES]}
            fields = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), fields, strict=True)], names=list(row))


def shape(spark: SparkSession, path: str) -> FileShape:
    """One task reads the file; only the counts and the head come to the driver."""
    row = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_measure, SHAPE).first()
    return FileShape(**(row.asDict() | {"head": bytes(row["head"])})) if row else FileShape()


def sample_records(spark: SparkSession, path: str, delimiter: str, encoding: str, max_rows: int | None) -> DataFrame:
    """The header and max_rows records (None: all), with undecodable bytes replaced and line ends unified."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column("content"):
                text = _bare(value.as_buffer().to_pybytes())[0].decode(encoding, "replace").replace("\r\n", "\n").replace("\r", "\n")
                records = enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1)
                while found := list(itertools.islice(records, BATCH)):
                    if max_rows is not None:
                        found = found[: max(0, max_rows + 2 - found[0][0])]
                    if not found:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([f for _, f in found], pa.list_(pa.string()))], names=["row_number", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, "row_number long, fields array<string>")


def rank_charsets(data: bytes) -> list[tuple[str, float]]:
    """Candidate encodings that decode the head (but for a character cut at its end), best first.

    The score is the share of characters that text may hold: replacement and control characters lower it.
    """
    out = []
    for name in CHARSETS:
        try:
            text = codecs.getincrementaldecoder(name)().decode(data, final=len(data) < HEAD_BYTES)
        except UnicodeDecodeError:
            continue
        odd = len(re.findall("[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text))
        out.append((name, round(1 - odd / len(text), 4) if text else 0.0))
    return sorted(out, key=lambda x: -x[1])


def sniff_delimiter(text: str) -> str | None:
    """None: no delimiter stands out."""
    try:
        return csv.Sniffer().sniff(text[:SNIFF_CHARS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return None
