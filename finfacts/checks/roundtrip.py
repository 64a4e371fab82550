"""Documents and archives rendered from the panel, to parse back and compare.

A document holds one institution's quarter (bounded by the code list) or, for line items, one
slice of a filing; an archive holds at most ``MEMBERS_PER_ARCHIVE`` documents. So no task
gathers an unbounded group, however skewed the tables are.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MEMBERS_PER_ARCHIVE = 256
KEYS_PER_SLICE = 4096


def sdf_documents(items: DataFrame) -> DataFrame:
    """``(rssd_id, reporting_period, slice_a, slice_b, text)``: header plus quoted fields, slices by
    two independent keys so that neither one hot order nor one hot part makes a huge document."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(
        ";", "reporting_period", "rssd_id", "item_code", "value_raw", "last_update",
        quoted("description"), "schedule", "line_number",
    )
    keys = [
        "rssd_id", "reporting_period",
        F.floor(F.col("ord.l_orderkey") / KEYS_PER_SLICE).alias("slice_a"),
        F.floor(F.col("ord.l_partkey") / KEYS_PER_SLICE).alias("slice_b"),
    ]
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda r: r["line"])
    header = F.lit("Call Date;Bank RSSD Identifier;MDRM #;Value;Last Update;Short Definition;Call Schedule;Line Number")
    return items.groupBy(*keys).agg(F.concat_ws("\n", header, F.array_join(lines, "\n")).alias("text"))


def xbrl_documents(facts: DataFrame) -> DataFrame:
    """``(rssd_id, quarter_date, member, xml)``. Each report also carries a prior-period fact, a
    foreign element, and an earlier duplicate that must lose."""
    period = F.concat_ws("-", F.substring("quarter_date", 1, 4), F.substring("quarter_date", 5, 2), F.substring("quarter_date", 7, 2))
    element = F.concat(
        F.lit('<u:'), F.col("code"), F.lit(' contextRef="C_'), F.col("rssd_id"), F.lit("_"), period,
        F.lit('">'), F.col("value_raw"), F.lit("</u:"), F.col("code"), F.lit(">"),
    )
    body = F.transform(F.sort_array(F.collect_list(F.struct("code", element.alias("xml")))), lambda r: r["xml"])
    docs = facts.groupBy("rssd_id", "quarter_date").agg(body.alias("body"))
    context = F.concat(F.lit('contextRef="C_'), F.col("rssd_id"), F.lit("_"), period, F.lit('"'))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?><xbrl xmlns:u="http://example.org/ratios" xmlns:o="http://example.org/other">'),
        F.lit("<o:Entity "), context, F.lit(">7</o:Entity>"),
        F.lit('<u:UBPRE013 contextRef="C_'), F.col("rssd_id"), F.lit('_1990-03-31">999</u:UBPRE013>'),
        F.lit("<u:UBPR2170 "), context, F.lit(">first duplicate</u:UBPR2170>"),
        F.lit("<u:UBPRZ999 "), context, F.lit(">  </u:UBPRZ999>"),
        F.array_join("body", ""), F.lit("</xbrl>"),
    )
    member = F.concat(F.lit("FI "), F.col("rssd_id"), F.lit("(ID RSSD) "), F.col("quarter_date"), F.lit(".xml"))
    return docs.select("rssd_id", "quarter_date", member.alias("member"), xml.alias("xml"))


def archives(documents: DataFrame) -> DataFrame:
    """ZIP archives ``(path, content, quarter_date)``, each from a bounded id range of one quarter."""
    slot = F.floor(F.col("rssd_id").cast("bigint") / MEMBERS_PER_ARCHIVE)

    def pack(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        quarter, number = key
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
            for member, xml in sorted(zip(docs["member"], docs["xml"])):
                out.writestr(member, xml)
            out.writestr("README.txt", "not a report")
            out.writestr("summary.xml", "<none/>")
        return pd.DataFrame([(f"{quarter}-{number:06d}.zip", buffer.getvalue(), quarter)],
                            columns=["path", "content", "quarter_date"])

    return (
        documents.withColumn("slot", slot)
        .groupBy("quarter_date", "slot")
        .applyInPandas(pack, "path string, content binary, quarter_date string")
    )


def write_archives(frame: DataFrame, folder: str) -> int:
    """Write each archive as a file of ``folder`` from the executors; returns how many."""

    def save(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"path": batch["path"]})

    return frame.mapInPandas(save, "path string").count()
