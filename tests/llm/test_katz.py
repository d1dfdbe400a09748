"""The language model against a plain version over dictionaries that shares no code with it."""

import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from flowseg.functions.tables import SHUFFLE_CLEANUP, scratch_path
from flowseg.llm import katz, queries


DEPTH = 5


def good_turing(counts):
    """r -> what is left of a count of r, and whether it is Katz's form of Good-Turing's formula."""
    n = Counter(counts)
    halves = {r: (r - 0.5) / r for r in range(1, DEPTH + 1)}
    if not all(n[r] for r in range(1, DEPTH + 1)):
        return halves, False
    a = (DEPTH + 1) * n[DEPTH + 1] / n[1]
    if a == 1:
        return halves, False
    d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, DEPTH + 1)}
    return (d, True) if all(0 < x < 1 for x in d.values()) else (halves, False)


def brute(rows, order=3):
    """Scores (held_out, n_tokens, n_known, N, base, score), sums of probabilities after contexts, whether the top order has the formula's discounts."""
    split = [(d, zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False, (t or "").encode().lower().split() + [None]) for d, t in rows]
    train = [w for _, h, w in split if not h]
    uni = Counter(x for w in train for x in w)
    n, v = sum(uni.values()), len(uni)

    def histories(w, length):
        padded = [b"<s>"] * length + w
        return [tuple(padded[i : i + length]) for i in range(len(w))]

    after = [defaultdict(Counter) for _ in range(order)]  # by length of the context
    for w in train:
        for k in range(1, order):
            for h, x in zip(histories(w, k), w):
                after[k][h][x] += 1
    d1, formula = good_turing(uni.values())
    ds = [d1]
    for k in range(1, order):
        d, formula = good_turing(c for own in after[k].values() for c in own.values())
        ds.append(d)
    left = sum(c * (1 - d1.get(c, 1)) for c in uni.values())
    size = n if left > 0 else n + 0.5
    unknown = (left if left > 0 else 0.5) / size if n else 1.0
    weights = {}

    def p(h, w):
        if not h:
            return uni[w] * d1.get(uni[w], 1) / size if w in uni else unknown
        own = after[len(h)].get(h)
        if not own:
            return p(h[1:], w)
        total = sum(own.values())
        aside = 0.0 if any(c <= DEPTH for c in own.values()) else 0.5
        d = ds[len(h)]
        if w in own:
            return own[w] * d.get(own[w], 1) / (total + aside)
        if h not in weights:
            mass = (aside or sum(c * (1 - d.get(c, 1)) for c in own.values())) / (total + aside)
            weights[h] = mass / (1 - sum(p(h[1:], x) for x in own))
        return weights[h] * p(h[1:], w)

    out = []
    for d, h, w in split:
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        logs = sum(math.log10(p(a, x)) for a, x in zip(histories(w, order - 1), w))
        out.append((d, h, len(w), sum(uni[x] > 0 for x in w), n, base, logs))
    sums = [sum(p(h, b) for b in uni) + p(h, b"never seen") for k in range(1, order) for h in list(after[k])[:30]]
    return out, sums, formula


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(n)]
    rows += [(None, "w1 W2  w3"), (n, None), (n, ""), (n + 1, "ÄB äb new words"), (3, rows[3][1])]
    return rows + [(n + 2 + i, "always the same words") for i in range(40)]


def _order(row):
    return (row[0] is None, row[0] or 0, row[2])


def same(got, want, abs_=1e-9):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=_order), sorted(want, key=_order)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=abs_)


@pytest.mark.parametrize("texts, order, by_formula", [(120, 2, True), (120, 3, True), (8, 3, False), (120, 4, None), (120, 1, None)])
def test_scores(spark, texts, order, by_formula):
    """Discounts by the formula, and halves for 8 texts."""
    rows = made(texts, 1)
    want, sums, formula = brute(rows, order)
    assert all(abs(s - 1) < 1e-9 for s in sums) and (by_formula is None or formula == by_formula)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in katz.score_documents(docs, order).collect()], want)


def test_stored_model_scores_another_table(spark, tmp_path):
    """Tables written by one call score other texts, read back."""
    rows, others = made(120, 1), made(30, 2)
    path = f"{tmp_path}/model"
    katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), path=path).count()
    model = katz.load(spark, path)
    assert (model.grams[2].columns, model.weights[1].columns) == (["w1", "w2", "w3", "count", "p", "last_count"], ["w1", "w2", "total", "weight"])
    held = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 5 == 1)
    texts = sorted({t or "" for _, t in others})
    want = {t: brute([*rows, (held, t)])[0][-1] for t in texts}  # held out, so the model stays the same
    encoded = katz.encode(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    for r in encoded.join(katz.score(encoded, model), "row").collect():
        assert r["n_known"] == want[r["text"]][3] and r["score"] == pytest.approx(want[r["text"]][6], abs=1e-9)


def test_one_text_over_and_over_and_a_very_long_one(spark):
    """Contexts that leave nothing, one n-gram with nearly all rows, other columns under names of the operator's own."""
    rows = [(i, "same words here") for i in range(300)] + [(1000, "long " * 60_000), (1001, "ab  cd\u00a0ef\x0b\x1fG"), (1001, "ab  cd\u00a0ef\x0b\x1fG")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, `w1.p` string").repartition(5)
    same([tuple(r) for r in katz.score_documents(docs).collect()], brute(rows)[0], 1e-6)


@pytest.mark.parametrize("rows", [made(120, 1), made(8, 1), [(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]])
def test_sql_equals_the_plain_version(rows):
    """With the formula's discounts, without, and without training texts, where all scores are 0."""
    frame = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], dtype="Int64"), "text": [t for _, t in rows]})
    with duckdb.connect() as con:
        con.register("documents", frame)
        got = con.sql(queries.ORACLES["op10_katz"]).fetchall()
    want = [(d, True, 3, 0, 0, 0.0, 0.0) for d, _ in rows] if all(t == "a b" for _, t in rows) else brute(rows)[0]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=_order), sorted(want, key=_order)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS FROM read_parquet('{folder}/documents.parquet')")
        relation = con.sql(queries.ORACLES["op10_katz"])
        names, want = relation.columns, relation.fetchall()
    frame = queries.op10_katz(spark, folder)
    assert sorted(frame.columns) == sorted(names)
    got = [tuple(r) for r in frame.select(*names).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=_order), sorted(want, key=_order)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-11)


def test_without_training_and_without_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert {tuple(r)[1:] for r in katz.score_documents(docs).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}
    assert katz.score_documents(docs.limit(0)).count() == 0


def test_discounts_without_kinds():
    assert katz.discounts({}).tolist() == [0, 0.5, 0.75, pytest.approx(2.5 / 3), 0.875, 0.9]


def test_only_the_model_and_small_tables_are_left_on_disk(spark, tmp_path):
    """Encoded texts, counts, asked n-grams and shuffle files go while the job runs; the session's setting stays as it was."""

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    scratch = os.path.dirname(scratch_path(spark))
    os.makedirs(scratch, exist_ok=True)
    before, tables, setting = shuffled(), set(os.listdir(scratch)), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = made(120, 1)
    scored = katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), path=f"{tmp_path}/model")
    assert {t.rsplit("-", 1)[0] for t in set(os.listdir(scratch)) - tables} <= {"katz-scores", "katz-scored"}
    until = time.time() + 20  # files are deleted in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    same([tuple(r) for r in scored.collect()], brute(rows)[0])


def test_missed_ngrams_of_a_text_that_repeats_itself(spark, tmp_path):
    """Many times the same n-gram, found, missed, and with its context missed too, in one text."""
    held = next(i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [*made(120, 1), (held, "w1 w2 w3 " * 50 + "w9 w8 new " * 40), (held, "new " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order in (2, 3, 4):
        same([tuple(r) for r in katz.score_documents(docs, order).collect()], brute(rows, order)[0])


def _by_hash(text):
    return [katz.xxhash.xxh64_intdigest(w, seed=42) - (1 << 64) * (katz.xxhash.xxh64_intdigest(w, seed=42) >> 63) for w in (text or "").encode().lower().split()] + [1]


@pytest.mark.parametrize("bucket_tokens, order", [(60, 3), (400, 2), (400, 4), (10**6, 3)])
def test_stored_tables_add_up_with_many_buckets_and_hot_words(spark, tmp_path, bucket_tokens, order):
    """Counts are those of the texts; what a context leaves is its weight; each n-gram and each context is there once."""
    rows, path = made(120, 1), f"{tmp_path}/model"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in katz.score_documents(docs, order, path, bucket_tokens).collect()], brute(rows, order)[0])
    model = katz.load(spark, path)
    assert len(model.hots[0]) > 5 and (model.buckets > 5) == (bucket_tokens < 10**6)
    p = [{}]
    for n, grams in enumerate(model.grams, 1):
        want = Counter()
        for d, t in rows:
            if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
                words = [0] * (n - 1) + _by_hash(t)
                want.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        got = [(tuple(r[f"w{k}"] for k in range(1, n + 1)), r) for r in grams.collect()]
        assert len(got) == len(want) and {k: r["count"] for k, r in got} == want
        p.append({k: r["p"] for k, r in got})
    for n, weights in enumerate(model.weights, 2):
        seen, lower = Counter(), Counter()
        for k, x in p[n].items():
            seen[k[:-1]] += x
            lower[k[:-1]] += p[n - 1][k[1:]]
        got = {tuple(r[f"w{k}"] for k in range(1, n)): r["weight"] for r in weights.collect()}
        assert got.keys() == seen.keys() and weights.count() == len(got)
        assert all(1 - seen[c] == pytest.approx(w * (1 - lower[c]), abs=1e-9) for c, w in got.items())


def test_model_takes_few_bytes(spark, tmp_path):
    """Under 8 bytes a token of model."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(300))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tokens = sum(r["n_tokens"] for r in katz.score_documents(docs, path=f"{tmp_path}/model").collect())
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{tmp_path}/model") for f in files if f.endswith(".parquet"))
    assert held < 8 * tokens
