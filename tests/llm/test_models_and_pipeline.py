"""Toxicity, URL filters, the registered queries and the pipeline."""

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from riskspark.llm import simhash, toxicity, url_filter
from riskspark.llm.queries import URL_RULES

sys.path.insert(0, os.path.dirname(__file__))

from test_dedup_operators import plain_contained, roots  # noqa: E402

BAD = ["grumpf", "wretchy", "vilest"]


def prose(rng, n):
    return [f"word{int(abs(rng.gauss(0, 60)))}" for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        words, bad = prose(rng, rng.randint(5, 120)), rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(BAD).upper() + "!"
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), 0.5))
        if i % 5:
            labels.append((i, int(bad), 1))
    docs += [(1000, None, "en", 0.0), (1001, "", None, 0.0), (1002, " ".join(prose(rng, 20_000)), "en", 0.0), (None, "x", "en", 0.0),
             (1003, "twice", "en", 0.0), (1003, "twice", "en", 0.0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int"), docs)


def test_toxicity_finds_held_out_rows(labelled):
    docs, labels, rows = labelled
    got = {r.doc_id: r for r in toxicity.toxic_scores(docs, labels).collect()}
    right = 0
    held = [(i, t) for i, t, *_ in rows if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 3 == 1]
    for i, t in held:
        assert got[i].held_out
        right += got[i].predicted == any(b in t.lower() for b in BAD)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[1000].score == got[1001].score


def test_toxicity_ignores_labels_of_held_out_rows(labelled):
    docs, labels, _ = labelled
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(toxicity.learns(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxic_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.toxic_scores(docs, turned).collect()}


def test_toxicity_stage_and_edge_tables(labelled):
    docs, labels, rows = labelled
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    clean = {i for i, t, *_ in rows if not any(b in (t or "").lower() for b in BAD)}
    assert len(clean - left) <= 0.02 * len(clean) and len(left - clean) <= 0.05 * len(rows)
    assert toxicity.toxic_scores(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxic_scores(docs, labels.limit(0)).collect()} == {0}


def test_toxic_stage_goes_by_id_and_text(spark, labelled):
    docs, labels, _ = labelled
    clean = max(r.text for r in toxicity.drop_toxic(docs, labels).collect() if r.doc_id and r.doc_id < 600)
    both = docs.unionByName(spark.createDataFrame(
        [(5000, clean + " grumpf" * 5, "en", 0.0), (5000, clean, "en", 0.0)], docs.schema))
    kept = [r.text for r in toxicity.drop_toxic(both, labels).collect() if r.doc_id == 5000]
    assert kept == [clean]


def test_fit_takes_one_bounded_row_of_each_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, *_: seen.extend(texts))
    monkeypatch.setattr(toxicity, "calibrate", lambda net, texts, *_: seen.extend(texts))
    docs = spark.createDataFrame([(i, "a " * 50_000, "en") for i in range(30) for _ in range(4)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    toxicity.fit(docs, labels)
    assert len(seen) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30))
    assert {len(t) for t in seen} == {toxicity.FIT_CHARS}


def test_fit_learns_from_rows_beyond_the_sample(spark, labelled, monkeypatch):
    docs, labels, rows = labelled
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    few = toxicity.fit(docs, labels, fit_rows=120)
    taught = [t.lower().replace("!", "").split() for i, t, *_ in rows
              if i is not None and i < 600 and i % 5 and zlib.crc32(str(i).encode()) % 3 != 1 and not toxicity.calibrates(i)]
    times = Counter(w for words in taught for w in set(words))
    assert few.rows.tolist() == sorted(toxicity.bucket(w) for w, n in times.items() if n > 1)
    wide = [t for i, t, *_ in rows if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 3 == 1]
    truth = np.array([any(b in t.lower() for b in BAD) for t in wide])
    found = few.scores(wide) >= 0.5
    assert (found & truth).sum() >= 0.9 * truth.sum() and (found & ~truth).sum() <= 0.05 * len(wide)
    assert set(few.thresholds) <= {"", "de", "en"} and few.thresholds


def test_fit_reads_the_end_of_long_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 8)) + " pad" * 40 + (" grumpf" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    short, toxicity.FIT_CHARS = toxicity.FIT_CHARS, 100
    try:
        net = toxicity.fit(docs, labels)
    finally:
        toxicity.FIT_CHARS = short
    assert toxicity.bucket("grumpf") in net.rows.tolist()
    right = (net.scores([t for _, t in rows]) >= 0.5) == np.array([i % 2 == 1 for i, _ in rows])
    assert right.mean() > 0.9


def test_network_windows_end_with_their_text():
    net = toxicity.train(["bad one two", "good one two"] * 30, np.array([1.0, 0.0] * 30))
    alone = [net.logits([t])[0] for t in ("bad", "one two", "")]
    assert np.allclose(alone, net.logits(["bad", "one two", ""]), atol=1e-5)


URLS = [
    (1, "http://a.example.org/es/x?q=1"), (2, "https://EXAMPLE.org/en/12#top"), (3, "http://b.org/"), (4, "http://b.org"),
    (5, "http://c.com/de/1"), (6, "http://c.com/fr/1?a=b"), (7, "no scheme"), (8, None), (9, "ftp://org/x"), (10, "x://notorg/y"),
    (11, "http://example.organic/es/"), (12, "http://a.example.org/en/2"), (12, "http://a.example.org/en/2"), (None, "http://z.net/?"),
    (13, "http://h.com\nx/de/1"), (14, "http://example.org/es"),
]


def plain_judgement(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:]
    for c in "?#":
        path = path.split(c, 1)[0]
    fits = [r for r in URL_RULES if (host == r.rule.split("/", 1)[0] or host.endswith("." + r.rule.split("/", 1)[0]))
            and path.startswith("/" + r.rule.split("/", 1)[1])]
    return host, path, max(fits, key=lambda r: len(r.rule), default=None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in URLS], "page_id long, url string, html string, score int")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(URLS)
    for i, u in URLS:
        host, path, rule = plain_judgement(u)
        for r in (r for r in got if r.page_id == i):
            assert (r.host, r.path, r.rule) == (host, path, rule.rule if rule else None), u
            assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    only = url_filter.judge_urls(pages, [url_filter.Rule("block", "org/")]).collect()
    assert {r.verdict for r in only} == {"block"}


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(3)
    rows, rules = [], [url_filter.Rule("block", "spam.test/"), url_filter.Rule("allow", "good.test/")]
    for i in range(400):
        bad, host = rng.random() < 0.5, rng.choice(["spam", "good", "other"])
        bad = {"spam": True, "good": False}.get(host, bad)
        tail = "".join(rng.choice("0123456789") for _ in range(12)) + "?a=1&b=2&c=3" if bad else "about"
        rows.append((i, f"http://{host}.test/{tail}", bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    rest = [(i, bad) for i, u, bad in rows if got[i].rule is None]
    assert sum((got[i].verdict == "block") == bad for i, bad in rest) >= 0.95 * len(rest)


def test_registered_queries_cover_every_operator():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and {"op4_exact_dedup", "op6_decontamination"} <= set(entry.oracle_sql())


def plain_runs(text):
    """Distinct runs of five words, of all words where there are fewer."""
    words = text.encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pipeline(rows, items):
    """Ids that the stages after toxicity leave, by brute force."""
    best = {}
    for r in rows:
        if r.doc_id is not None:
            best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id is None or best[r.text or ""] == r.doc_id]
    sets = {r.doc_id: plain_runs(r.text or "") for r in rows if r.doc_id is not None}
    near = [(a, b) for a in sets for b in sets if a > b and (
        sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)]
    root = roots(sets, near)
    rows = [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id]
    leaked = {i for i, _ in plain_contained([(r.doc_id, r.text) for r in rows], items)}
    return {r.doc_id for r in rows if r.doc_id not in leaked}


def test_pipeline_stages_drop_what_they_should(spark, labelled, tmp_path):
    _, labels, _ = labelled
    rng = random.Random(21)
    item = " ".join(f"item{k}" for k in range(30))
    text = " ".join(prose(rng, 200))
    rows = [(i, " ".join(prose(rng, rng.randint(60, 200)))) for i in range(2000, 2020)]
    # a near copy that no fingerprint of radius 4 links, and one just below the threshold
    words = text.split()
    far = " ".join(words[:100] + ["changed"] + words[101:180] + ["other"] * 2 + words[182:])
    rows += [(7, far), (8, " ".join(words[:150] + [f"new{k}" for k in range(60)]))]
    rows += [(1, text), (2, text), (3, text + " more"), (4, " ".join(prose(rng, 40)) + " " + item), (5, None), (6, ""), (None, "kept")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    train, _, _ = labelled
    both = docs.unionByName(train.selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "'t' AS source", "1L AS n_chars"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.selectExpr("doc_id + 10000 AS doc_id", "toxic", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1, 4} & out == set() and len({2, 3, 7} & out) == 1 and 8 in out
    assert out == plain_pipeline(corpus_pipeline.reject_toxic(spark, both, str(tmp_path)).collect(), [(1, item)])
    assert {None, *range(2000, 2020)} <= out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


def test_stages_take_any_column_names(spark, labelled, tmp_path):
    """Columns of the names that stages use themselves, in both cases."""
    train, labels, _ = labelled
    labels.select("doc_id", "toxic", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_id", "_s", "_gone", "_C", "_score", "c", "score", "node", "kept", "keep_id", "component_id"]
    docs = train.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    docs = docs.unionByName(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r["_gone"] for r in out.collect()} == {2}
    assert simhash.drop_near_copies(docs).columns == docs.columns
