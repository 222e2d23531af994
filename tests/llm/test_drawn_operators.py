"""Importance resampling, spot-signature fingerprints and fill-in-middle against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens.llm import infill, queries, resampling, spotsigs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "und", "la"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgäéÉ漢") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(0, 90)) for _ in range(60)]
    odd = [None, "", " \n\t ", "Ä", "one", "x " * 4000, "漢字" * 300, "no <S> here " * 9, "a<P>", "end <M", "👍🏽 é \x00 b", "the the the of", base[0], base[0], base[0] + " tail"]
    out = [(i, t) for i, t in enumerate(base + odd)]
    return out + [out[3], out[3], (7, base[9]), (None, base[1]), (None, base[1]), (None, "without an id " * 12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("id", "n", "form", "row", "bucket", "gain", "rank", "part", "edge", "print", "units", "word")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# ---- 11 -----------------------------------------------------------------------------------------------------


def slow_resampling(rows, target, ngrams=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        words = WORD.findall(lower(text))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: percent * len(able) // 100]
    ranked = [(*r[:4], k) for k, r in enumerate(drawn, 1)]
    for r in drawn:
        out.remove(r)
    return sorted([*ranked, *((*r[:4], None) for r in out)], key=repr)


@pytest.mark.parametrize("options", [{}, {"ngrams": 3, "buckets": 50, "percent": 60, "seed": 5}, {"least_words": 0, "percent": 100}])
def test_importance_sample(spark, docs, rows, options):
    target = ["the abc of ad", None, "", prose(random.Random(2), 50)]
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    found = resampling.importance_sample(docs, wanted, **options).select("id", "n_features", "weight", "score", "rank")
    slow = {"least_words": "least"}
    assert as_rows(found) == slow_resampling(rows, target, **{slow.get(k, k): v for k, v in options.items()})


def test_importance_sample_of_nothing(spark, docs, rows, empty):
    assert resampling.importance_sample(empty, docs).count() == 0
    found = resampling.importance_sample(docs, empty).select("id", "n_features", "weight", "score", "rank")
    assert as_rows(found) == slow_resampling(rows, [])


def test_places_in_many_partitions_with_equal_keys(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id").alias("k"), F.lit(3).alias("score"), (F.col("id") % 3 == 0).alias("even"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = resampling.numbered_in_order(df, [F.col("score"), F.col("k").desc()], F.col("even")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r["place"], r["k"]) for r in found) == [(i + 1, 4999 - i) for i in range(5000)]
    assert {r["of"] for r in found} == {1667}


# ---- 12 -----------------------------------------------------------------------------------------------------


def slow_signatures(text, anchors):
    words = [w.encode() for w in WORD.findall(lower(text))]
    out = set()
    for i in range(-1, len(words)):
        if i < 0 or words[i] in anchors:
            chain = [w for w in words[i + 1 :] if w not in anchors][:2]
            if chain:
                out.add((b"" if i < 0 else words[i], *chain))
    return out or {text}


def slow_likeness(a, b):
    return len(a & b) / len(a | b)


def test_compared_with_next(docs, rows):
    found = spotsigs.compared_with_next(docs, common=0.02).collect()
    words = Counter(w for _, t in rows for w in WORD.findall(lower(t)))
    anchors = {w.encode() for w, n in words.items() if n >= 0.02 * sum(words.values())}
    assert anchors == spotsigs.anchor_words(docs, common=0.02) and {b"the", b"la"} <= anchors
    assert len(found) == len(rows)
    # the order of rows with equal ids is that of a hash, so a successor of theirs is any of the group's
    ids = sorted({i for i, _ in rows if i is not None}) + [None]
    texts = {i: [t or "" for k, t in rows if k == i] for i in ids}
    after = {i: texts[ids[(k + 1) % len(ids)]] + (texts[i] if len(texts[i]) > 1 else []) for k, i in enumerate(ids)}
    for r in found:
        fits = []
        for text in texts[r["id"]]:
            for then in after[r["id"]]:
                half = len(text) // 2
                edited = text[: len(text) - half] + then[:half]
                if (len(text), hashlib.sha256(edited.encode()).hexdigest()) == (r["n_chars"], r["edited_sha256"]):
                    sets = [slow_signatures(x, anchors) for x in (text, edited, then)]
                    fits.append((slow_likeness(sets[0], sets[1]), slow_likeness(sets[0], sets[2])))
        assert (r["near_edited"], r["near_next"]) in fits
    prints = {}
    for i in ids:
        for r in found:
            if r["id"] == i and len(texts[i]) == 1:
                assert prints.setdefault(texts[i][0], r["fingerprint"]) == r["fingerprint"]
    whole = [r for r in found if r["n_chars"] > 150 and r["id"] is not None]
    assert sum(r["near_edited"] for r in whole) > 5 * sum(r["near_next"] for r in whole if r["near_next"] < 1)


def test_next_of_few_documents(spark, empty):
    assert spotsigs.compared_with_next(empty).count() == 0
    one = spark.createDataFrame([(5, "abcdef ghi")], "doc_id bigint, text string")
    r = spotsigs.compared_with_next(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdeabcde").hexdigest() and r["near_next"] == 1.0
    two = spark.createDataFrame([(2, "b" * 10), (1, None)], "doc_id bigint, text string").repartition(2)
    found = {r["id"]: r for r in spotsigs.compared_with_next(two).collect()}
    assert found[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and found[2]["edited_sha256"] == hashlib.sha256(b"bbbbb").hexdigest()


# ---- 13 -----------------------------------------------------------------------------------------------------


def slow_fill(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, None, text)
    if h[3] % 100 < 20:
        return (i, len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (i, len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_fill_in_middle(spark, docs, rows, empty):
    written = infill.fill_in_middle(docs)
    assert as_rows(written) == sorted((slow_fill(i, t) for i, t in rows), key=repr)
    back = written.select("id", infill.restored(F.col("output"), F.col("form")).alias("text"))
    assert as_rows(back) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r["form"] for r in written.collect()}
    assert infill.fill_in_middle(empty).count() == 0


def test_restored_needs_the_sentinels_of_the_form(spark):
    odd = [("<P>a<S>c<M>b", "psm"), ("<P>a<S>c<M>b", "spm"), ("<S>c<P>a<M>b", "spm"), ("x<P>a<S>c<M>b", "psm"), ("<P>a<S>c", "psm"), ("<P><S><M>", "psm"), ("abc", "psm"), ("abc", "plain"), (None, "psm")]
    df = spark.createDataFrame(odd, "output string, form string")
    assert [r[0] for r in df.select(infill.restored(F.col("output"), F.col("form"))).collect()] == ["abc", None, "abc", None, None, "", None, "abc", None]


def test_no_python_on_the_native_paths(docs):
    for frame in (infill.fill_in_middle(docs), resampling.importance_sample(docs, docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_fill_in_middle"])
def test_statements(spark, docs, rows, tmp_path, name):
    """The statements in DuckDB's SQL on a table with odd texts and repeated and null ids; without equal rows that differ in rank."""
    table = docs.select("doc_id", "text").distinct()
    table.write.parquet(f"{tmp_path}/documents.parquet")
    table.limit(9).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = queries.QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert as_rows(ours) == sorted(theirs, key=repr)


@pytest.mark.parametrize("at_least", [0.8, 0.5])
def test_similar_documents(spark, empty, at_least):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(12)]
    for text in list(texts):
        words = text.split(" ")
        for changes in (0, 1, 2, 4, 9, 20):
            for k in rng.sample(range(len(words)), min(changes, len(words))):
                words[k] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(words[: rng.randint(len(words) * 3 // 4, len(words))]))
    rows = [(i, t) for i, t in enumerate([*texts, None, "", "the the"])] + [(None, texts[0]), (3, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    anchors = spotsigs.anchor_words(docs)
    sets = [spotsigs.signatures((t or "").encode(), anchors) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if spotsigs.likeness(sets[i], sets[j]) >= at_least:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    want = sorted(((k, least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)
    assert as_rows(spotsigs.similar_documents(docs, at_least)) == want
    assert 12 <= len(set(least.values())) < len(rows) - 20
    assert spotsigs.similar_documents(empty, at_least).count() == 0


def test_very_long_words_and_runs_of_anchors():
    import time

    anchors = frozenset([b"ab", b"1"])
    began = time.perf_counter()
    mixed = (b"ab " * 500_000) + b"x" * 2_000_000 + b" 1" * 500_000 + b" end"
    assert len(spotsigs.signatures(mixed, anchors)) == 3 and len(spotsigs.signatures(mixed + b" y" * 300_000, anchors)) == 3
    assert time.perf_counter() - began < 20  # some seconds; hours if each anchor copied the long word


def test_pruned_likeness_and_size_classes():
    import numpy as np

    a, b = np.arange(10, dtype=np.uint32), np.arange(2, 30, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == 8 / 30 and spotsigs.likeness(a, b, 0.5) == 0 and spotsigs.likeness(a[:0], b) == 0
    for t in (0.5, 0.8, 0.95, 1.0):
        bounds = spotsigs.size_classes(t, 5000)
        of = lambda n: sum(x <= n for x in bounds)  # noqa: B023,E731
        for n in range(1, 3000, 7):
            assert of(int(n / t)) - of(n) <= 1
