"""Sources: website lists as text, CSV and spreadsheets, and the delivery sink.

All readers give sheet(sheet, row_idx, cells), which operators.importing takes. Files are small inputs typed by
people; each is read whole by one task, as their rows may span lines.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "sheet string, row_idx int, cells array<string>"
SUFFIXES = (".txt", ".csv", ".xlsx")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the supported files, by name."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.where(F.lower("path").rlike(r"\.(?:txt|csv|xlsx)$")).orderBy(F.lower("path"))


def _text_rows(content: bytes) -> list[list[str]]:
    lines = (x.strip() for x in content.decode("utf-8", "ignore").lstrip("﻿").splitlines())
    return [[x] for x in lines if x]


def _csv_rows(content: bytes) -> list[list[str]]:
    return list(csv.reader(io.StringIO(content.decode("utf-8-sig", "ignore"), newline="")))


def _column(reference: str) -> int:
    n = 0
    for c in re.sub(r"\d", "", reference):
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx_sheets(content: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Every worksheet in workbook order, with cached values."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        for s in tree("xl/workbook.xml").iterfind("m:sheets/m:sheet", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            rows = []
            for row in tree(target if target.startswith("xl/") else f"xl/{target}").iterfind("m:sheetData/m:row", _NS):
                cells: list[str] = []
                for k, c in enumerate(row.iterfind("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else k
                    value = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
                rows.append(cells)
            yield s.get("name"), rows


def read_sheets(files: DataFrame) -> DataFrame:
    """Sheets of files(path, content): one per text and CSV file, one per worksheet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                low = path.lower()
                if low.endswith(".xlsx"):
                    sheets = [(f"{path}#{n:04d}", rows) for n, (_, rows) in enumerate(_xlsx_sheets(content))]
                elif low.endswith((".csv", ".txt")):
                    sheets = [(path, _csv_rows(content) if low.endswith(".csv") else _text_rows(content))]
                else:
                    raise ValueError(f"unsupported file: {path}")
                for name, rows in sheets:
                    yield pd.DataFrame({"sheet": name, "row_idx": range(len(rows)), "cells": rows})

    return files.mapInPandas(run, SHEET)


COLUMNS = ("company_name", "representative", "emails", "phones", "website")


def write_delivery(rows: DataFrame, path: str) -> None:
    """Delivery as one CSV: UTF-8 with byte-order mark, CRLF, header, put in place at once.

    Executors write the lines beside the target, in the order of the rows' partitions; the parts are then joined as bytes
    through the file system, so path may be in any store that Spark reaches.
    """
    spark = rows.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder, whole = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".parts", ".part"))
    files = target.getFileSystem(conf)

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    rows.select(F.concat_ws(",", *[cell(c) for c in COLUMNS]).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(folder.toString())
    files.setWriteChecksum(False)
    out = files.create(whole, True)
    try:
        out.write(bytearray(("\ufeff" + ",".join(COLUMNS) + "\r\n").encode()))
        for name in sorted(f.getPath().getName() for f in files.listStatus(folder)):
            if name.startswith("part-"):
                part = files.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
        files.setWriteChecksum(True)
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(whole), files.makeQualified(target), over)
    files.delete(folder, True)
