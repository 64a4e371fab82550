"""Archives of institution XML reports: ZIP of ``FI <id>(ID RSSD) <YYYYMMDD>.xml`` members.

ZIP and XML decoding is the one place that needs Python: a batch iterator that streams
members out of each archive and emits long rows, so no archive, quarter or institution is
ever held as one object beyond the archive bytes themselves.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from finfacts.functions.text import ENTITY_ID

MEMBERS = (
    "path string, modified timestamp, quarter_date string, member string, rssd_id string, xml binary, status string"
)
FACT_ROWS = (
    "path string, modified timestamp, quarter_date string, member string, rssd_id string, code string,"
    " value_raw string, ord long, status string"
)
ROWS_PER_BATCH = 20_000
BYTES_PER_BATCH = 32 << 20


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files ``(path, modified, content, quarter_date)``; the quarter comes from the file name."""
    return with_quarter(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def quarter_of(path: str) -> Column:
    """The first eight digits of an archive's name; empty when it has none."""
    return F.regexp_extract(path, r"([0-9]{8})[^/]*\.zip$", 1)


def with_quarter(files: DataFrame) -> DataFrame:
    found = quarter_of("path")
    return files.select(
        "path", F.col("modificationTime").alias("modified"), "content", F.when(found != "", found).alias("quarter_date")
    )


def _members(path: str, content: bytes) -> Iterator[tuple[str, str | None, bytes | None, str]]:
    """``(member, rssd_id, bytes, status)`` of every XML member; a broken archive gives one status row."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield "", None, None, "unreadable_archive"
        return
    with archive:
        for name in archive.namelist():
            if not name.endswith(".xml"):
                continue
            found = re.search(ENTITY_ID, name)
            if found is None:
                yield name, None, None, "no_entity_id"
                continue
            try:
                yield name, found.group(1), archive.read(name), "ok"
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError):
                yield name, found.group(1), None, "unreadable_member"


def current_facts(xml: bytes, quarter_date: str) -> list[tuple[str, str]]:
    """Non-blank ratio texts of the report's own period, in document order.

    A fact counts when its context ends in the period's date and its qualified tag mentions
    ``UBPR``. The tree is dropped as it is read.
    """
    suffix = f"_{quarter_date[:4]}-{quarter_date[4:6]}-{quarter_date[6:8]}"
    facts = []
    for _, node in ET.iterparse(io.BytesIO(xml), events=("end",)):
        text = (node.text or "").strip()
        if text and "UBPR" in node.tag and node.get("contextRef", "").endswith(suffix):
            facts.append((re.split("[}:]", node.tag)[-1], text))
        node.clear()
    return facts


def list_members(archives: DataFrame, spread: int | None = None) -> DataFrame:
    """Members of every archive. An archive cannot be split, so its members are dealt out before they are
    parsed: over ``spread`` partitions, or as many as adaptive execution finds right for their bytes."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "modified", "quarter_date", "member", "rssd_id", "xml", "status"]
        rows, held = [], 0
        for batch in batches:
            for path, modified, content, quarter in zip(batch["path"], batch["modified"], batch["content"], batch["quarter_date"]):
                for member, rssd, xml, status in _members(path, content):
                    rows.append((path, modified, quarter, member, rssd, xml, status))
                    held += len(xml or b"")
                    if held >= BYTES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    if "modified" not in archives.columns:
        archives = archives.withColumn("modified", F.lit(None).cast("timestamp"))
    members = archives.select("path", "modified", "content", "quarter_date").mapInPandas(unzip, MEMBERS)
    return members.repartition(*([spread] if spread else []), "path", "member")


def extract_facts(members: DataFrame) -> DataFrame:
    """Long rows of every member, with a status row for each member that gave none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "modified", "quarter_date", "member", "rssd_id", "code", "value_raw", "ord", "status"]
        rows = []
        for batch in batches:
            for path, modified, quarter, member, rssd, xml, status in batch.itertuples(index=False):
                facts = []
                if status == "ok":
                    try:
                        facts = current_facts(bytes(xml), quarter or "")
                        status = "ok" if facts else "no_facts"
                    except ET.ParseError:
                        status = "malformed_xml"
                if not facts:
                    rows.append((path, modified, quarter, member, rssd, None, None, 0, status))
                rows.extend(
                    (path, modified, quarter, member, rssd, code, text, i, "ok") for i, (code, text) in enumerate(facts)
                )
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return members.mapInPandas(parse, FACT_ROWS)


def parse_archives(archives: DataFrame, spread: int | None = None) -> DataFrame:
    return extract_facts(list_members(archives, spread))


def facts_of(parsed: DataFrame) -> DataFrame:
    """One row per (institution, quarter, code). The institution's newest archive of the quarter gives all its
    codes (one that was withdrawn is gone); a later duplicate in its documents wins.

    The parsed rows are read once: the newest archive is found by a window over an institution's quarter, and the
    aggregate by code keeps that partitioning."""
    own = W.partitionBy("rssd_id", "quarter_date")
    archive = F.struct(F.coalesce(F.unix_micros("modified"), F.lit(0)).alias("at"), "path")
    usable = parsed.where((F.col("status") == "ok") & F.col("code").isNotNull()).select(
        "rssd_id", "quarter_date", "code", "value_raw", "member", "ord", archive.alias("archive"))
    return (
        usable.withColumn("newest", F.max("archive").over(own)).where(F.col("archive") == F.col("newest"))
        .groupBy("rssd_id", "quarter_date", "code")
        .agg(F.max_by("value_raw", F.struct("member", "ord")).alias("value_raw"))
    )


#: What can be wrong with an archive or with one of its members; each gives one row of that status.
REJECTS = ("unreadable_archive", "unreadable_member", "no_entity_id", "malformed_xml", "no_facts")


def parse_metrics() -> list[Column]:
    """Counts for a write of parsed rows to observe: members that gave facts, and rejects of each kind."""
    kinds = [F.count(F.when(F.col("status") == kind, 1)).alias(kind) for kind in REJECTS]
    # A member's first fact stands for the member.
    return [F.count(F.when((F.col("status") == "ok") & (F.col("ord") == 0), 1)).alias("n_members"), *kinds]


def archive_outcomes(parsed: DataFrame) -> DataFrame:
    """Per archive: institutions extracted, members skipped, and whether anything was usable. Facts are counted by
    their position in a document, so rows that were staged twice count once."""
    member = parsed.groupBy("path", "quarter_date", "member").agg(
        F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"),
        F.coalesce(F.max(F.when(F.col("code").isNotNull(), F.col("ord") + 1)), F.lit(0)).alias("n_facts"),
    )
    return member.groupBy("path", "quarter_date").agg(
        F.sum("ok").alias("n_institutions"),
        F.sum(1 - F.col("ok")).alias("n_skipped"),
        F.sum("n_facts").alias("n_facts"),
        F.when(F.sum("ok") > 0, "succeeded").otherwise("failed").alias("outcome"),
    )
