"""WARC archives, sharding, exact search, secrets, SimHash and the pipeline on small tables."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from flowseg.llm import components, exact_topk, queries, secret_scan, sharding, simhash, warc

DOCS = "doc_id long, text string"


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 6])
def test_warc_round_trip(spark, least):
    pages = [(1, "http://a/ ä\r\nx", "equal"), (2, None, "equal"), (3, "u", "equal page"), (9, "v", "equal page"), (4, "", None), (5, "w", ""), (6, "x", "ü" * 400_000)]
    pages += [(7, "y", "own\r\n\r\nlines"), (None, "z", "equal page"), (None, "z", "nobody"), (8, "t", "tie tie"), (8, "t", "tie tie"), (10, "t", "tie tie")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1)).repartition(3)
    got = warc.round_trip(df, least).collect()
    first = {}
    for p, _, h in pages:
        data = (h or "").encode()
        if p is not None and len(data) >= least:
            first[data] = min(p, first.get(data, p))
    want = Counter()
    for p, _, h in pages:
        data = (h or "").encode()
        to = first.get(data) if len(data) >= least else None
        to = None if to == p else to
        want[p, len(data), base32(data), "response" if to is None else "revisit", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(r["verified"] for r in got)
    assert warc.round_trip(df.limit(0)).count() == 0


class Drip(io.BytesIO):
    """Gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(3)


def test_warc_reader_notices_damage():
    good = warc.record(1, "http://a", b"payload" * 50, None, False) + warc.record(2, None, b"payload" * 50, 1, True)
    read = lambda data, kind=io.BytesIO: list(warc.read_records(kind(data)))
    assert read(good) == read(good, Drip) and len(read(good)) == 2 and all(r[4] for r in read(good))
    plain = zlib.decompress(warc.record(1, "http://a", b"payload", None, False), wbits=31)
    packed = lambda data: zlib.compress(data, wbits=31)
    assert [r[4] for r in read(packed(plain.replace(b"payload\r\n", b"paxload\r\n")))] == [False]
    for bad in (good[:-9], packed(plain[:-2]), packed(plain + b"more"), packed(b"HTTP/1.1\r\n\r\n"), b"not gzip at all"):
        with pytest.raises(warc.BadArchive):
            read(bad)


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even_and_gapless(spark, hot):
    rng = random.Random(1)
    rows = [(1 if hot and i % 3 == 0 else i, "x" * int(rng.expovariate(1 / 200)) + "é") for i in range(3000)] + [(None, None), (None, "a"), (None, "a"), (5000, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit(1)).repartition(16)
    got = sharding.shard_documents(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    loads, places = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    mean = sum(loads.values()) / 8
    assert sorted(loads) == list(range(8)) and max(loads.values()) - min(loads.values()) < 0.03 * mean
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["copies", "nulls"])
def test_one_hot_id_in_few_parts(spark, kind):
    """A third of the rows under one id, equal or without an id, read in one part and in five: even, and the same pieces."""
    rng = random.Random(3)
    rows = [(7 if kind == "copies" else None, "x" * (200 if kind == "copies" else rng.randint(1, 400))) if i % 3 == 0 else (i, "x" * rng.randint(1, 400)) for i in range(6000)]
    docs, found = spark.createDataFrame(rows, DOCS), []
    for parts in (1, 5):
        df = docs.coalesce(1) if parts == 1 else docs.repartition(5, "text")
        got = sharding.shard_documents(df, 40).collect()
        loads, places = Counter(), {}
        for r in got:
            loads[r["shard"]] += r["size"]
            places.setdefault(r["shard"], []).append(r["slot"])
        mean = sum(loads.values()) / 40
        assert len(got) == 6000 and len(loads) == 40 and max(abs(x - mean) for x in loads.values()) < 0.03 * mean
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        found.append(Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got))
    assert found[0] == found[1]


def test_a_kept_map_is_edited(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(1, 400)) for i in range(3000)]
    path, docs = f"{tmp_path}/map", spark.createDataFrame(rows, DOCS)
    first = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 8, path).collect()}
    more = docs.unionByName(spark.createDataFrame([(5000 + i, "y" * rng.randint(1, 400)) for i in range(60)], DOCS))
    again = sharding.shard_documents(more, 8, path).collect()
    assert {r["map_version"] for r in again} == {2} and {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2}
    assert sum(first[r["doc_id"]] != r["shard"] for r in again if r["doc_id"] in first) < 0.1 * len(rows)


def test_rebalancing_moves_little(spark):
    rng = random.Random(2)
    units = spark.createDataFrame([(i, 0, rng.randint(1, 1000)) for i in range(500)], "virtual_slot int, sub int, bytes long")
    first = sharding.slot_map(units, 8)
    grown = sharding.slot_map(units, 9, first, version=2)
    both = first.select("virtual_slot", F.col("shard").alias("old")).join(grown, "virtual_slot").join(units.select("virtual_slot", "bytes"), "virtual_slot").collect()
    loads = Counter()
    for r in both:
        loads[r["shard"]] += r["bytes"]
    assert max(loads.values()) < 1.1 * min(loads.values()) and {r["version"] for r in both} == {2}
    assert sum(r["bytes"] for r in both if r["old"] != r["shard"]) < 0.15 * sum(loads.values())


@pytest.mark.parametrize("block, large", [(4096, None), (8, None), (4096, 20), (4096, 36)])
def test_exact_topk(spark, block, large):
    """``large``: two opposite vectors with a component of that power of two, so scores pass 2**53, or 2**64."""
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(i, vectors[5][1]) for i in range(300, 340)] + [(50, vectors[50][1]), (400, None), (450, [1.0, None]), (500, [float("nan")] * 6), (550, [1.0, 2.0]), (600, [0.5, -2.0]), (650, []), (700, []), (None, vectors[1][1])]
    if large:
        vectors += [(1000, [2.0**large, 0.25, 1.0, 0.0, 0.0, 3.0]), (1001, [-(2.0**large), 0.0, 1.0, 0.0, 0.0, 5.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit(0)).repartition(4)
    ready = exact_topk.integer_vectors(table)
    got = exact_topk.top_k(ready, ready.filter("vec_id % 50 = 0"), 5, block).collect()
    good = {(i, tuple(np.floor(256 * np.array(v, dtype=np.float64)).astype(int).tolist())) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in good if i != q and len(u) == len(v))
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_topk.top_k(ready.limit(0), ready.limit(0)).count() == 0


def test_topk_of_many_ties_and_of_what_is_too_large(spark):
    rows = [(i, [1.0, i % 40 / 1000]) for i in range(400)]
    ready = exact_topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = exact_topk.top_k(ready, ready.filter("vec_id = 0"), 5).orderBy("rank").collect()
    best = sorted((-65536, i) for i in range(1, 400))[:5]  # the query's second component is 0, so all scores tie
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    beyond = exact_topk.integer_vectors(spark.createDataFrame([(1, [2.0**60])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large for exact scores"):
        beyond.collect()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text):
    base = base_spans(text)
    gap = lambda a, b: max(a[0] - b[2], b[0] - a[2])
    near = lambda a, kinds, spans: any(x[1] in kinds and gap(a, x) <= secret_scan.SCOPE for x in spans)
    keys = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.KEY, text)]
    keys = [k for k in keys if near(k, (1,), base)]
    ends = [(m.start(), 4, m.end()) for m in re.finditer(secret_scan.ENDPOINT, text)]
    return sorted(base + keys + [e for e in ends if near(e, (1,), base) and near(e, (0, 2, 3), base + keys)])


def joined(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_texts():
    rng = random.Random(4)
    key, access, hexes = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AKIA" + "Q2" * 8, "0123456789abcdef" * 2
    parts = [key, access, hexes, "https://s3.example.com/x", "bucket.amazonaws.com", "password = 'hunter22'", "token: abc", "secret=token\"=abcdefgh", "API_KEY:\"a.b-c_d\"", "AKIA12", "é日𝄞 text\n", " " * 200, " word" * 60, "PASSWD=x", "apikey=" + "0f" * 15]
    texts = [None, "", key, access, access + " " + key, key + "." * 300 + access, f"{access} {key} https://a.b/c"] + ["".join(x + rng.choice(["", " ", "\n"]) for x in rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    # a span far inside a long one, and long ones that only touch at a scope's distance
    url = "https://s3.example.com/" + "a/" * 700 + access + "/b" * 700
    texts += [url, url + " password = hunter22", "secret=" + "x/" * 600 + ".azure.com " + access, "secret=" + "q-" * 500 + " " + access + "/https://h.example/" + "z" * 900]
    texts += [url + " " * n + "token: abcdefgh" for n in (255, 256, 257, 700)] + [access + " " * n + key + " foo.azure.comhttp://x" for n in (255, 256, 257, 511, 512)]
    return texts


def test_secrets(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] * 2, DOCS).withColumn("key", F.lit(0)).withColumn("base", F.lit(0)).repartition(3)
    want = Counter()
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        kinds = Counter(k for _, k, _ in base)
        want[i if i % 7 else None, kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(t or ""))] += 2
    assert Counter(tuple(r) for r in secret_scan.scan(docs).collect()) == want
    assert sum("key:" in w[5] for w in want) > 10 and sum("endpoint:" in w[5] for w in want) > 10
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_sql_finds_the_same_secrets(spark):
    """The given tables hold no weak part near an identifier, so the SQL is compared on made texts as well."""
    frame = pd.DataFrame({"doc_id": range(len(secret_texts())), "text": secret_texts()})
    with duckdb.connect() as con:
        con.register("documents", frame)
        got = con.sql(queries.ORACLES["op8_secrets"]).select("doc_id, n_assign, n_access, n_hex, base_sha256, spans").fetchall()
    docs = spark.createDataFrame(list(frame.itertuples(index=False, name=None)), DOCS)
    assert Counter(got) == Counter(tuple(r) for r in secret_scan.scan(docs).collect())


@pytest.mark.parametrize("name", ["op2_warc", "op7_exact_topk", "op8_secrets"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{folder}/{t}.parquet')")
        want = con.sql(queries.ORACLES[name])
        columns = sorted(want.columns)
        want = Counter(want.select(", ".join(columns)).fetchall())
    got = next(q for q in queries.QUERIES if q.__name__ == name)(spark, folder)
    assert sorted(got.columns) == columns
    assert Counter(tuple(r) for r in got.select(columns).collect()) == want


def test_long_dotted_names_are_scanned(spark):
    """100,000 labels beside an identifier, with and without an end that is known, and empty labels."""
    key, dotted = "AKIA" + "Q" * 16, "a." * 100_000
    tails = ["com", "s3.amazonaws.com", "x.azure.com..b.azure.com", ".googleapis.com"]
    docs = spark.createDataFrame([(i, f"{key} token=abcdef {dotted}{t} https://u.v/{dotted}") for i, t in enumerate(tails)], DOCS)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()}
    for i, t in enumerate(tails):
        text = f"{key} token=abcdef {dotted}{t} https://u.v/{dotted}"
        at, end = len(key) + 14, {0: 0, 1: len(tails[1]), 2: len("x.azure.com"), 3: 0}[i]
        want = f"access:0:20,assign:21:33" + (f",endpoint:{at}:{at + len(dotted) + end}" if end else "")
        assert text[34:36] == "a." and at == 34 and got[i] == want
    plain = secret_scan.scan(docs.withColumn("text", F.expr("replace(text, '..', '.a.')"))).filter("doc_id = 3").first()
    assert "endpoint:34:" in plain["spans"]


def test_secrets_are_masked(spark):
    texts = secret_texts()
    docs = spark.createDataFrame([(i, t, -1, "s") for i, t in enumerate(texts)], DOCS + ", n_chars long, linked string").repartition(3)
    got = {r["doc_id"]: r for r in secret_scan.mask_secrets(docs).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s, _, e in all_spans(t or "") if base_spans(t or "") else []:
            if s >= at:
                out += t[at:s] + secret_scan.MASK
            at = max(at, e)
        want = t if not base_spans(t or "") else out + t[at:]
        assert got[i]["text"] == want and got[i]["linked"] == "s"
        assert got[i]["n_chars"] == (-1 if want == t else len(want))


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    prints, root = sorted(set(prints)), {}
    for p in prints:
        if p not in root:
            todo, root[p] = [p], p
            while todo:
                x = todo.pop()
                for y in prints:
                    if y not in root and (x ^ y).bit_count() <= 2:
                        root[y] = p
                        todo.append(y)
    return root


@pytest.mark.parametrize("file_rows", [64, 2])
def test_links_connect_what_is_near(spark, file_rows):
    rng = random.Random(7)
    prints = [0]
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 15)):
            prints.append(p)
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.choice([0, 15, 16, 31, 32, 47, 48, 62, 63, rng.randrange(64)])
    signed = sorted({p - (1 << 64 if p >> 63 else 0) for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "f long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(simhash.links(df, file_rows)).collect()}
    want = slow_roots(prints)
    groups = lambda roots: {frozenset(k for k in want if roots.get(k, k) == r) for r in {roots.get(k, k) for k in want}}
    assert groups(got) == groups(want)


def near_texts():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "one", "One\x0btwo", "ÀB cd", "x y z", "x y z"]
    for _ in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = "Other"
    return texts


def test_simhash_classes(spark):
    texts = near_texts()
    rows = [(100 - i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("f", F.lit(1)).repartition(3)).collect()
    root = slow_roots([slow_fingerprint(t) for t in texts])
    least = {}
    for d, t in rows:
        if d is not None:
            r = root[slow_fingerprint(t)]
            least[r] = min(d, least.get(r, d))
    assert Counter(tuple(r) for r in got) == Counter((d, f"{slow_fingerprint(t):016x}", least.get(root[slow_fingerprint(t)])) for d, t in rows)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] * 2 + [(3, texts[-1])]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_key", F.lit("own")).repartition(3)
    kept = simhash.keep_first(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    roots = slow_roots([slow_fingerprint(t) for t in texts])
    of = lambda t: roots[slow_fingerprint(t)]
    assert Counter(of(r["text"]) for r in got) == Counter(set(roots.values()))
    for r in got:
        assert r["doc_id"] == min((d for d, t in rows if of(t) == of(r["text"]) and d is not None), default=None)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(100, 400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)} | {1000: 100}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    say = {"en": "the of and ing tion".split(), "fr": "le de que ment eau é".split()}
    prose = lambda lang: " ".join("".join(rng.choices(say[lang], k=3)) + str(rng.randrange(9)) for _ in range(80))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["en", "fr"] * 60)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows[4] = (4, rows[4][1] + " " + item, "en")
    rows[5] = (5, rows[5][1] + " password=abcdef123", "fr")
    rows += [(200, rows[0][1], "en"), (201, None, "en"), (202, "123", "en"), (203, "", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("score", F.lit(1)).withColumn("n_tokens", F.lit("own")).withColumn("a.`b", F.lit("odd name"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "a.`b" in out.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(range(120)) - {4}
    assert got[5]["text"].endswith("[SECRET]") and got[5]["n_tokens"] == "own"
    assert got[6]["_n_tokens"] > 0 and got[6]["decoded_sha256"] == hashlib.sha256(got[6]["text"].encode()).hexdigest()
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0

