"""Secret scans: strong patterns alone, weak credential parts only where complementary parts co-occur.

Strong spans (assign, access, hex) need no partner. A weak part is a short assigned value, a free-standing mixed
token or an endpoint: common in clean text by itself. Each text is cut into scopes of ``scope`` code points; an
interval join asks, for every weak part, whether a complementary kind starts within ``scope`` of it:

* ``weak`` (a mixed token of 16+ characters, without a name= before it) counts beside an access identifier or a login name;
* ``login`` (a login or client identifier) counts beside a secret, weak or strong;
* ``endpoint`` (an address with a scheme for stores or queues, or a host and port) counts beside a login or secret.

Per scope only the first and the last start of each kind are joined, which decides "within ``scope``" exactly and
keeps the join linear: one row for each part and at most three rows of its document's scopes.

Positions come from the matches and the gaps between them: ``split`` and ``regexp_extract_all`` walk the same
leftmost non-overlapping matches. Everything is DataFrame functions.

Null and empty texts have no span. Repeated rows get the same spans each; a null doc_id is a value like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, stored, table

#: Kinds in the order of the digests; the first three are the base.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak", "login", "endpoint")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
# A run below the length can hold no longer match, so these two need no test afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Group 2 is the span: behind a name and its '=' if what follows is a token by itself, else the whole run.
WEAK = (r"(?<![A-Za-z0-9+/_=-])([A-Za-z_][A-Za-z0-9_-]*=+)?"
        r"((?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{16,})")
LOGIN = r"""(?i:(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{2,})"""
# Printable ASCII without the space, quotation marks, backticks and angle brackets.
_URL = r"[!#-;=?-_a-~]"
ENDPOINT = (rf"(?i:(?:s3|amqps?|postgres(?:ql)?|mysql|mongodb|redis|ftps?|sftp|jdbc:[a-z]+)://{_URL}{{3,}}"
            rf"|(?<![A-Za-z0-9._-])(?:[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z][A-Za-z0-9-]*|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|localhost)"
            rf":[0-9]{{2,5}}(?![A-Za-z0-9])(?:/{_URL}*)?)")
#: Cheap tests that a text must pass before the full pattern is tried; each is implied by its pattern.
HINTS = {
    "assign": r"(?i:pass|secret|token|api)", "login": r"(?i:user|login|client|account|access)",
    "endpoint": r"://|:[0-9]{2}", "access": "AKIA",
}
PARTNERS = {
    "weak": ("access", "login"),
    "login": ("assign", "access", "hex", "weak"),
    "endpoint": ("assign", "access", "hex", "login"),
}
SCOPE = 400
MIN_ASSIGN = 6
MASK = "[SECRET]"

_HITS = "array<struct<gap:int,len:int,value:int>>"


def _hits(kind: str, text: Column, pattern: str) -> Column:
    """Every match as (length of the text since the last one, its length, length of group 2)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    lens = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x)) if kind in ("assign", "weak") else lens
    # There is one gap more than matches: the zip's last entry has a null length and goes later.
    zipped = F.arrays_zip(gaps.alias("gap"), lens.alias("len"), values.alias("value")).cast(_HITS)
    likely = text.contains(HINTS[kind]) if kind == "access" else text.rlike(HINTS[kind]) if kind in HINTS else F.lit(True)
    return F.when(likely & text.rlike(pattern), zipped).otherwise(F.array().cast(_HITS))


def matches(documents: DataFrame) -> DataFrame:
    """doc_id, key and each kind's matches; one pass over the texts, kept in the scratch folder."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key("doc_id", "text").alias("key"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak": WEAK, "login": LOGIN, "endpoint": ENDPOINT}
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), _hits(k, F.col("text"), p).alias("hits")) for k, p in patterns.items()))
    return stored(rows.select("doc_id", "key", F.filter(kinds, lambda k: F.size(k["hits"]) > 0).alias("kinds")), "matches")


def spans_of(found: DataFrame) -> DataFrame:
    """key, kind, start, end of every base span and every candidate, once for rows with the same key."""
    each = found.select("key", F.explode("kinds").alias("k")).select("key", "k.kind", "k.hits").dropDuplicates(["key", "kind"])
    rows = each.select("key", "kind", F.posexplode("hits").alias("i", "h")).where("h.len is not null")
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("h.gap") + F.col("h.len")).over(upto)
    placed = rows.select("key", "kind", F.col("h.value").alias("value"), F.col("h.len").alias("len"), end.alias("end"))
    return placed.where((F.col("kind") != "assign") | (F.col("value") >= MIN_ASSIGN)).select(
        "key", "kind", (F.col("end") - F.when(F.col("kind") == "weak", F.col("value")).otherwise(F.col("len"))).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that have a complementary part within ``scope``; spans inside stronger ones are no parts."""
    before = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    base = F.col("kind").isin(*BASE)

    def covered(stronger: Column) -> Column:
        return (F.coalesce(F.max(F.when(stronger, F.col("end"))).over(before) > F.col("start"), F.lit(False))
                | F.coalesce(F.min(F.when(stronger, F.col("start"))).over(after) < F.col("end"), F.lit(False)))

    rows = spans.withColumns({"in_base": covered(base), "in_named": covered(F.col("kind") != "weak"),
                              "bin": F.floor(F.col("start") / scope)})
    rows = rows.where(base | (F.when(F.col("kind") == "weak", ~F.col("in_named")).otherwise(~F.col("in_base"))))
    edges = rows.groupBy("key", "bin", "kind").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    scopes = edges.groupBy("key", "bin").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", F.struct("first", "last")))).alias("kinds"))
    weak = rows.where(~base).select("key", "kind", "start", "end", F.col("bin").alias("own"))
    near = weak.withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))

    def close(kind: str) -> Column:
        edge = F.col("kinds")[kind]
        reach = (F.when(F.col("bin") == F.col("own"), F.lit(True))
                 .when(F.col("bin") < F.col("own"), edge["last"] >= F.col("start") - scope)
                 .otherwise(edge["first"] <= F.col("start") + scope))
        return edge.isNotNull() & reach

    beside = F.lit(False)
    for kind, others in PARTNERS.items():
        beside = beside | ((F.col("kind") == kind) & reduce(Column.__or__, map(close, others)))
    return near.join(scopes, ["key", "bin"]).where(beside).select("key", "kind", "start", "end").distinct()


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"])))
    ordered = ordered.cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def reported(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key and ``all``, the array of its base and linked spans; keys without any are left out."""
    spans = spans_of(found)
    rows = spans.where(F.col("kind").isin(*BASE)).unionByName(linked(spans, scope))
    return rows.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("all"))


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document with its counts, the digest of its base spans and all its spans."""
    found = matches(documents)
    out = found.select("doc_id", "key").join(reported(found, scope), "key", "left").withColumn(
        "all", F.coalesce("all", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("all", lambda s: s["kind"].isin(*BASE))
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("all")).alias("spans"))


def redact(documents: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """The documents with every reported span masked (overlapping ones together); all rows and columns stay."""
    # The columns travel as one, so their names may be any.
    packed = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document")
    keyed = documents.select(packed, row_key("doc_id", "text").alias("key"))
    spans = reported(matches(documents), scope).select("key", F.array_sort(
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("spans"))
    text = F.col("document.text")
    cut = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(mask))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    masked = F.when(F.col("spans").isNull(), text).otherwise(cut)
    return keyed.join(spans, "key", "left").select(F.col("document").withField("text", masked).alias("document")).select("document.*")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
