"""Semicolon-delimited filing payloads: decoding and line-item parsing, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finfacts.functions.text import normalize_schedule

FIELDS = [
    "call_date", "bank_rssd", "item_code", "value", "last_update", "description", "schedule",
    "line_number",
]
# One delimited field: quoted (doubled quotes inside, may span lines), quoted and never closed (it goes on
# to the end of the text, as CSV readers have it), plain, or empty. Every byte of a text is matched by one
# of these, so nothing is skipped. Possessive quantifiers keep the scan linear.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_QUOTED}"[^;\n]*+|{_QUOTED}\z|[^;\n"][^;\n]*+|)'
_RECORD = rf"(?!\z)({_FIELD}(?:;{_FIELD})*+)(?:\n|\z)"
_BLANKS = " \t\n\x0b\f\r"


def decode_payload(c: Column | str) -> Column:
    """Response text to filing text: unwrap a JSON string, then strict base64 (UTF-8, else Latin-1);
    anything that is neither passes through."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    # A JSON text that is a string literal; other JSON values stay as they are.
    is_json_string = text.rlike(r'^"[^"\\]*+(?:\\.[^"\\]*+)*+"$')
    unwrapped = F.trim(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"])
    inner = F.when(is_json_string, F.coalesce(unwrapped, text)).otherwise(text)
    # Strict base64: whole groups of four from the standard alphabet, padding only at the end.
    strict = inner.rlike("^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.when(strict, F.try_to_binary(inner, F.lit("base64")))
    decoded = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )
    return F.when(raw.isNotNull(), decoded).otherwise(inner)


def parse_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per data record of each filing text, other columns of ``docs`` kept.

    Adds the eight trimmed fields (missing trailing ones are empty), ``section``, ``columns`` with every
    field of the record (eight at least), ``raw`` with all of them joined, and ``source_line_number`` (the header is record 1 and is dropped; a blank line
    is a record of empty fields).
    """
    body = F.regexp_replace(F.col(text), "\r\n?", "\n")
    body = F.when(body.endswith("\n") | (body == ""), body).otherwise(F.concat(body, F.lit("\n")))
    records = F.regexp_extract_all(body, F.lit(_RECORD), F.lit(1))
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(records).alias("pos", "record")).where("pos > 0")
    # A separator in front gives every field a first character, so empty ones are matched as well.
    fields = F.regexp_extract_all(F.concat(F.lit(";"), "record"), F.lit(f";({_FIELD})"), F.lit(1))
    cells = F.transform(fields, lambda f: F.btrim(_unquoted(f), F.lit(_BLANKS)))
    missing = F.greatest(F.lit(len(FIELDS)) - F.size(cells), F.lit(0))
    return (
        rows.withColumn("columns", F.concat(cells, F.array_repeat(F.lit(""), missing)))
        .select(
            *others, (F.col("pos") + 1).alias("source_line_number"),
            *[F.element_at("columns", i).alias(n) for i, n in enumerate(FIELDS, 1)], "columns",
        )
        .withColumn("section", normalize_schedule("schedule"))
        .withColumn("raw", F.array_join("columns", ";"))
    )


def _unquoted(field: Column) -> Column:
    """A quoted field without its quotes, doubled ones once; text after the closing quote stays."""
    inner = F.regexp_extract(field, rf'(?s)^{_QUOTED[:1]}([^"]*+(?:""[^"]*+)*+)', 1)
    rest = F.regexp_replace(field, rf'(?s)^{_QUOTED}"?', "")
    return F.when(field.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(field)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Filing files, one row per file: ``path, text``. A filing is one document by nature."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def to_items(parsed: DataFrame) -> DataFrame:
    """Parsed records under the line-item column names, ordered by source line."""
    return parsed.select(
        F.col("bank_rssd").alias("rssd_id"), F.col("call_date").alias("reporting_period"),
        F.col("source_line_number").alias("ord"), "item_code", F.col("value").alias("value_raw"),
        "last_update", "description", "schedule", "section", "line_number",
    )
