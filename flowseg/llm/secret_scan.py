"""Secrets in texts: strong patterns on their own, weak ones where complementary parts occur together.

Strong spans (assignments of passwords and tokens, access identifiers, long
hexadecimal strings) are reported wherever they are. Parts that mean little by
themselves are kinds of their own: a 40-character key, and an endpoint (a URL
or a host of a cloud service). A scope is ``SCOPE`` code points: a key is reported
if an access identifier lies within a scope of it; an endpoint if both an
identifier and a secret (an assignment, hexadecimal or a key that is reported)
do. Parts meet in an interval join: by text and by piece of the scope's length,
their own and the neighbouring ones, with the distance verified after.

A join needs no pairs, only whether the nearest part is within reach. So the
parts of each piece are reduced to their first and last positions before it,
and a text full of parts costs no more than their number.

Offsets are code points, ends exclusive. They come from the lengths of what
lies between the matches of a pattern, in one pass, so no position is searched for.

Edge cases: a NULL text is empty and has no spans. Spans depend on the text
only: equal texts are linked once. A text without complementary parts doesn't
enter the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.functions.tables import materialize
from flowseg.llm.common import fresh, text_key

SCOPE = 256
MASK = "[SECRET]"

# The patterns; group 2 of an assignment is its value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-][a-z0-9.-]*[.](?:amazonaws|azure|googleapis)[.]com"""  # where no two dots are next to each other
KINDS = ["assign", "access", "hex", "key", "endpoint"]
_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def _spans(text: Column, pattern: str, kind: int, least_value: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end); with ``least_value`` those whose group 2 is as long."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length),
        F.transform(matches, F.length),
        lambda gap, own: F.struct(gap.alias("gap"), F.coalesce(own, F.lit(0)).alias("own")),
    )
    # cumulative: each match starts after all gaps and matches before it
    placed = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["own"]).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("s"), F.lit(kind).alias("k"), (a["at"] + x["gap"] + x["own"]).alias("e"))).alias("out"),
        ),
        lambda a: F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1),
    )
    if least_value:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        placed = F.filter(
            F.transform(F.arrays_zip(placed.alias("span"), values.alias("value")), lambda z: F.when(F.length(z["value"]) >= least_value, z["span"])),
            lambda s: s.isNotNull(),
        )
    return placed


def find_parts(docs: DataFrame, text: str, base: str, weak: str) -> DataFrame:
    """Adds the strong spans as ``base`` and the weak ones as ``weak``; only texts with a match of a pattern pay for its spans."""
    words = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPAN)

    def some(pattern: str, kind: int, least: int = 0, on: Column = words) -> Column:
        return F.when(on.rlike(pattern), _spans(on, pattern, kind, least)).otherwise(none)

    # a host's labels are never empty: two dots end it, as capital letters do, which keeps its pattern free of groups that repeat
    whole = F.replace(words, F.lit(".."), F.lit("AA"))
    return docs.withColumn(base, F.array_sort(F.concat(some(ASSIGN, 0, 6), some(ACCESS, 1), some(HEX, 2)))).withColumn(
        # an identifier makes weak parts worth finding: neither kind is reported without one
        weak,
        F.when(F.exists(base, lambda s: s["k"] == 1), F.array_sort(F.concat(some(KEY, 3), some(ENDPOINT, 4, on=whole)))).otherwise(none),
    )


def _near(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``spans`` (key, s, k, e) with one of ``others`` within ``SCOPE``: an interval join by pieces.

    Others are filed under every piece they touch, a span asks its own pieces and
    one more on either side. In its own pieces whatever is there is near; in the
    outer ones the last end or the first start decides. A span that covers the
    other, or lies far inside it, is met as well.
    """
    piece = lambda at: F.floor(at / SCOPE).cast("long")
    touched = F.sequence(piece(F.col("s")), piece(F.col("e")))
    filed = others.select("key", "s", "e", F.explode(touched).alias("p")).groupBy("key", "p").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    asked = spans.select("*", F.explode(F.sequence(piece(F.col("s")) - 1, piece(F.col("e")) + 1)).alias("p"))
    hit = asked.join(filed, ["key", "p"]).filter(((F.col("s") - F.col("last")) <= SCOPE) & ((F.col("first") - F.col("e")) <= SCOPE))
    return hit.select("key", "s", "k", "e").distinct()


def link(parts: DataFrame, base: str, weak: str, key: str) -> DataFrame:
    """``key`` and ``linked``: the weak spans of a text that complementary parts make credible. Not for texts without any."""
    rows = parts.filter(F.size(weak) > 0).select(F.col(key).alias("key"), F.concat(base, weak).alias("all")).dropDuplicates(["key"])
    spans = materialize(rows.select("key", F.explode("all").alias("x")).select("key", "x.*"))
    identifiers = spans.filter("k = 1").select("key", "s", "e")
    keys = _near(spans.filter("k = 3"), identifiers)
    secrets = spans.filter("k IN (0, 2)").select("key", "s", "e").unionByName(keys.select("key", "s", "e"))
    endpoints = _near(_near(spans.filter("k = 4"), identifiers), secrets)
    return keys.unionByName(endpoints).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("linked")).withColumnRenamed("key", key)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    parts = find_parts(docs.select("doc_id", "text").withColumn("key", text_key(F.col("text"))), "text", "base", "weak")
    parts = materialize(parts.drop("text"))
    linked = materialize(link(parts, "base", "weak", "key"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    return parts.join(linked, "key", "left").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``MASK``.

    Spans must be sorted. What lies between is cut out of the text's own pieces.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def put(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int"))
        return (
            F.when(x["e"] <= a["at"], a)
            .when(x["s"] < a["at"], F.struct(x["e"].alias("at"), a["out"].alias("out")))
            .otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], gap, F.lit(MASK)).alias("out")))
        )

    return F.aggregate(spans, start, put, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All documents, with secrets in ``text`` masked and ``n_chars``, if there is one, adjusted. NULL texts stay NULL."""
    key, base, weak, linked = fresh(docs, "_key", "_base", "_weak", "linked")
    parts = find_parts(docs.withColumn(key, text_key(F.col("text"))), "text", base, weak)
    links = materialize(link(parts, base, weak, key)).withColumnRenamed("linked", linked)
    spans = F.array_sort(F.concat(base, F.coalesce(linked, F.array().cast(_SPAN))))
    joined = parts.join(links, key, "left") if not links.isEmpty() else parts.withColumn(linked, F.array().cast(_SPAN))
    out = joined.withColumn("text", F.when(F.size(base) > 0, masked(F.col("text"), spans)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(base) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*[quoted(c) for c in docs.columns])
