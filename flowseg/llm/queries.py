"""Registered queries of the corpus operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseg.llm import (
    byte_bpe,
    decontaminate,
    divergence,
    exact_topk,
    hard_negatives,
    katz,
    language_id,
    licences,
    secret_scan,
    sharding,
    simhash,
    stable_search,
    warc,
)
from flowseg.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of benchmark items in documents."""
    return decontaminate.passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, folder, "documents"), 40)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(table(spark, folder, "documents"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded and decoded."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "bpe.*")


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences named in documents."""
    return licences.scan(table(spark, folder, "documents"))


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best vectors for every 50th."""
    vectors = exact_topk.integer_vectors(table(spark, folder, "embeddings"))
    return exact_topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in documents."""
    return secret_scan.scan(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of documents."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document."""
    return katz.score_documents(table(spark, folder, "documents"))


def op11_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th."""
    vectors = stable_search.usable_vectors(table(spark, folder, "embeddings"))
    return stable_search.nearest(stable_search.build_index(vectors), vectors.filter("vec_id % 20 = 0"), 20)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every 50th vector's positives; every 7th label is one too high."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.labelled_vectors(table(spark, folder, "embeddings"), label)
    return hard_negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of sources and of their terms."""
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = [
    op1_decontamination,
    op2_warc,
    op3_sharding,
    op4_language_id,
    op5_byte_bpe,
    op6_licences,
    op7_exact_topk,
    op8_secrets,
    op9_simhash,
    op10_katz,
    op11_ann,
    op12_hard_negatives,
    op13_divergence,
]

#: A pattern whose letters match in either case.
_ANY_CASE = re.compile("[a-z]")
_ASSIGN = _ANY_CASE.sub(lambda m: f"[{m[0]}{m[0].upper()}]", "(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: RE2 can't look behind: runs of the characters that a host consists of are taken whole, with what of an endpoint is in them.
_RUN = r"""([a-z0-9-]+(?:[.][a-z0-9-]+)*[.](?:amazonaws|azure|googleapis)[.]com)|[A-Za-z0-9.-]*?(https?://[^ \t\n\x0B\f\r"''<>]+)|[A-Za-z0-9.-]+"""


def _placed(source: str, pattern: str) -> str:
    """SQL: the matches of a pattern in ``source`` (r, t), with their number and their end."""
    return f"""(SELECT r, i, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
                SELECT r, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g FROM (
                SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM {source})))"""


def _linked(span: str, other: str) -> str:
    """SQL: whether a span of ``other`` lies within the scope."""
    return f"EXISTS (SELECT 1 FROM {other} o WHERE o.r = {span}.r AND {span}.s - o.e <= 256 AND o.s - {span}.e <= 256)"


#: crc32 of a number's digits: eight steps of one bit for each of them.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, _: xor(y >> 1, 3988292384 * (y & 1)))))"""


def _discounts(counts: str) -> str:
    """SQL: one row with the factors ``f`` of counts 1 to 5, from a table with counts ``c``."""
    kinds = ", ".join(f"count(*) FILTER (c = {r}) AS n{r}" for r in range(1, 7))
    good = ", ".join(f"({r + 1} * n{r + 1} / nullif({r} * n{r}, 0) - a) / nullif(1 - a, 0)" for r in range(1, 6))
    return f"""(SELECT CASE WHEN coalesce(list_bool_and([g > 0 AND g < 1 for g in good]), FALSE) AND len([g for g in good if g IS NULL]) = 0
                            THEN good ELSE [0.5, 1.5 / 2, 2.5 / 3, 3.5 / 4, 4.5 / 5] END AS f
                FROM (SELECT [{good}] AS good FROM (SELECT *, CAST(6 * n6 AS DOUBLE) / nullif(n1, 0) AS a FROM (SELECT {kinds} FROM {counts}))))"""


def _licences_sql() -> str:
    """SQL of query 6, from the same sentences, names and rules. RE2 can't look around: what must stay is put back or marked by _."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def texts(values) -> str:
        return "[" + ", ".join(text(v) for v in values) + "]"

    known, letters = licences.known_units(), licences.characters()
    blank, led = r"[ \t\n\x0B\f\r]", licences.LED.replace("(?=", "(")
    steps, names = [], []
    for k, (name, ids) in enumerate(licences.RULES):
        pattern = "".join(f"([^{letters[i]}]*){letters[i]}" for i in ids)
        kept = "".join(rf"\{g}" for g in range(1, len(ids) + 1))
        steps.append(f"regexp_replace(s{k}, {text(pattern)}, {text(kept)}, 'g') AS s{k + 1}")
        names.append(f"CASE WHEN length(s{k + 1}) < length(s{k}) THEN {text(name)} END")
    single = {letters[i]: name for i, name in licences.NAMED.items()}

    def listed(head: str, start: str) -> str:
        rest = f"regexp_replace(u, {text(start)}, '')"
        rest = rf"regexp_replace({rest}, ' (or|and|with) ((?:any )?later)\b', ' \1_\2', 'g')"
        rest = rf"regexp_replace({rest}, ' (or|and|with) the ((?:any )?later)\b', ' \1 the_\2', 'g')"
        return f"[{text(head)} || trim(replace(x, '_', ' ')) for x in string_split_regex({rest}, ' (?:or|and|with) (?:the )?| at your option$')]"

    heads = " ".join(f"WHEN starts_with(u, {text(h)}) THEN {listed(h, start)}" for h, start in licences.LISTS.items())
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents),
        m AS (SELECT * FROM d WHERE {" OR ".join(f"contains(t, {text(w)})" for w in licences.MARKERS)}),
        cut AS (SELECT r, 1 AS kind, string_split_regex(regexp_replace(t, '\\bv[.]({blank}+[0-9])', 'v \\1', 'g'), {text(rf"""[.!?:;]["')\]]*{blank}|\n[ \t\r]*\n""")}) AS us FROM m
                UNION ALL SELECT r, 2, string_split_regex(t, '[\\r\\n]+') FROM m),
        plain AS (SELECT r, kind, [regexp_replace(regexp_replace(trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g')), {text(licences.UNDER)}, 'under '), {text(led)}, '\\1\\2') for u in us] AS us FROM cut),
        one AS (SELECT r, kind, flatten([CASE {heads} ELSE [u] END for u in us]) AS us FROM plain),
        known AS (SELECT r, kind, [{texts(known.values())}[list_position({texts(known)}, u)] for u in us if list_contains({texts(known)}, u)] AS ids FROM one),
        fold AS (SELECT r, kind, ids, array_to_string([chr(CAST(255 + list_position({texts(letters)}, i) AS INTEGER)) for i in ids], '') AS s0, {", ".join(steps)} FROM known),
        found AS (SELECT r, kind, ids, list_concat([{", ".join(names)}], [{texts(single.values())}[list_position({texts(single)}, c)] for c in string_split(s{len(steps)}, '') if list_contains({texts(single)}, c)]) AS names FROM fold),
        a AS (SELECT r, flatten(list(names)) AS names, max(len(ids)) AS n, any_value(ids) FILTER (kind = 1) AS si, any_value(ids) FILTER (kind = 2) AS li FROM found GROUP BY r)
        SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct([x for x in names if x IS NOT NULL])), ','), '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences,
               coalesce(array_to_string(si, ','), '') AS sentence_ids, coalesce(array_to_string(li, ','), '') AS line_ids
        FROM d LEFT JOIN a USING (r)"""


#: SQL: what a context's n-grams have in all, what they leave, and what the shorter context gives others.
_BACK = """sum(c) + CASE WHEN min(c) <= 5 THEN 0 ELSE 0.5 END AS total,
                        CASE WHEN min(c) <= 5 THEN sum(c * (1 - kept)) ELSE 0.5 END AS mass, 1 - sum(p) AS free"""

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(d, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)
                   for i in range(32)], '') AS payload_digest,
               CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, TRUE AS verified
        FROM p JOIN f USING (d)""",
    "op6_licences": _licences_sql(),
    "op7_exact_topk": """
        WITH x AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        v AS (SELECT vec_id, [CAST(floor(256 * c) AS BIGINT) for c in e] AS vec FROM x WHERE len([c for c in e if c IS NULL OR NOT isfinite(c)]) = 0),
        s AS (SELECT q.vec_id AS query_id, o.vec_id, CAST(list_sum([z[1] * z[2] for z in list_zip(q.vec, o.vec)]) AS BIGINT) AS score
              FROM v q JOIN v o ON q.vec_id % 50 = 0 AND q.vec_id <> o.vec_id AND len(q.vec) = len(o.vec)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # ' ' stands for the end and '  ' for the start, which no word can be
    "op10_katz": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC32} % 5 = 1, FALSE) AS held_out,
                          list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws
                   FROM documents),
        t AS (SELECT r, held_out, unnest(ws) AS w, unnest(list_prepend('  ', ws[1:len(ws) - 1])) AS a,
                     unnest(list_prepend('  ', list_prepend('  ', ws))[1:len(ws)]) AS b FROM d),
        uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
        bi AS (SELECT a, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY a, w),
        tri AS (SELECT b, a, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY b, a, w),
        f1 AS {_discounts("uni")},
        f2 AS {_discounts("bi")},
        f3 AS {_discounts("tri")},
        n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v, coalesce(sum(c * (1 - coalesce(f[c], 1))), 0) AS spare FROM uni, f1),
        u AS (SELECT *, n + CASE WHEN spare > 0 THEN 0 ELSE 0.5 END AS size FROM n),
        p AS (SELECT w, c, c * coalesce(f[c], 1) / size AS p FROM uni, f1, u),
        unknown AS (SELECT CASE WHEN n = 0 THEN 1 WHEN spare > 0 THEN spare / size ELSE 0.5 / size END AS p0 FROM u),
        seen AS (SELECT bi.a, bi.w, bi.c, coalesce(f[bi.c], 1) AS kept, p.p FROM bi JOIN p USING (w), f2),
        back AS (SELECT a, {_BACK} FROM seen GROUP BY a),
        p2 AS (SELECT a, w, c * kept / total AS p FROM seen JOIN back USING (a)),
        seen3 AS (SELECT tri.b, tri.a, tri.w, tri.c, coalesce(f[tri.c], 1) AS kept, p2.p FROM tri JOIN p2 USING (a, w), f3),
        back3 AS (SELECT b, a, {_BACK} FROM seen3 GROUP BY b, a),
        p3 AS (SELECT b, a, w, c * kept / total AS p FROM seen3 JOIN back3 USING (b, a)),
        s AS (SELECT t.r, coalesce(p.c, 0) AS c,
                     CASE WHEN p3.p IS NOT NULL THEN log10(p3.p)
                          ELSE coalesce(log10(back3.mass / back3.total / back3.free), 0)
                               + CASE WHEN p2.p IS NOT NULL THEN log10(p2.p) ELSE coalesce(log10(back.mass / back.total / back.free), 0) + log10(coalesce(p.p, p0)) END END AS l
              FROM t LEFT JOIN p ON t.w = p.w LEFT JOIN back ON t.a = back.a LEFT JOIN p2 ON t.a = p2.a AND t.w = p2.w
                   LEFT JOIN back3 ON t.b = back3.b AND t.a = back3.a LEFT JOIN p3 ON t.b = p3.b AND t.a = p3.a AND t.w = p3.w, unknown)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
               sum(log10((c + 0.5) / (n + 0.5 * (v + 1)))) AS base_score, sum(l) AS score
        FROM s JOIN d USING (r), n GROUP BY r, doc_id, held_out""",
    "op12_hard_negatives": """
        WITH x AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
        v AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * c) AS BIGINT) for c in e] AS vec
              FROM x WHERE len([c for c in e if c IS NULL OR NOT isfinite(c)]) = 0),
        s AS (SELECT a.r, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_sum([z[1] * z[2] for z in list_zip(a.vec, o.vec)]) AS BIGINT) AS score
              FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id AND len(a.vec) = len(o.vec)),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
        w AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
        size AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(size.n, 0) + v.v)::HUGEINT AS p,
                     1 + (1000000000 * (k.n + 1)::HUGEINT) // (v.n + v.v)::HUGEINT AS whole
              FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
              LEFT JOIN size ON size.lang = g.lang AND size.source = g.source),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, CAST((p - whole) * (p - whole) // whole AS BIGINT) FROM p WHERE n > 0 AND p > whole),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""".replace("\\\\", "\\"),
    "op8_secrets": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        assigned AS (SELECT * FROM {_placed("docs", _ASSIGN)}),
        value AS (SELECT r, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v FROM (SELECT r, regexp_extract_all(t, '{_ASSIGN}', 2) AS vs FROM docs)),
        strong AS (
            SELECT r, 0 AS k, e - length(m) AS s, e FROM assigned JOIN value USING (r, i) WHERE length(v) >= 6
            UNION ALL SELECT r, 1, e - length(m), e FROM {_placed("docs", "AKIA[A-Z0-9]+")} WHERE length(m) >= 20
            UNION ALL SELECT r, 2, e - length(m), e FROM {_placed("docs", "[0-9a-f]+")} WHERE length(m) >= 24),
        candidate AS (SELECT r, t FROM docs WHERE r IN (SELECT r FROM strong WHERE k = 1)),
        identifier AS (SELECT * FROM strong WHERE k = 1),
        lone AS (SELECT r, 3 AS k, e - length(m) AS s, e FROM {_placed("candidate", "[A-Za-z0-9/+=]+")} WHERE length(m) = 40 AND NOT contains(m, '=')),
        keys AS (SELECT * FROM lone x WHERE {_linked("x", "identifier")}),
        run AS (SELECT r, e, coalesce(nullif(regexp_extract(m, '{_RUN}', 1), ''), regexp_extract(m, '{_RUN}', 2)) AS m FROM {_placed("candidate", _RUN)}),
        place AS (SELECT r, 4 AS k, e - length(m) AS s, e FROM run WHERE m <> ''),
        secret AS (SELECT * FROM strong WHERE k <> 1 UNION ALL SELECT * FROM keys),
        endpoint AS (SELECT * FROM place x WHERE {_linked("x", "identifier")} AND {_linked("x", "secret")}),
        spans AS (SELECT *, ['assign', 'access', 'hex', 'key', 'endpoint'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x
                  FROM (SELECT * FROM strong UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM endpoint)),
        digest AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                   string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN digest USING (r)""",
}
