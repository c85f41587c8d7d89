import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import ranking
from riskspark.operators import agreement, metrics as M, splits, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pred(spark, cells):
    rows = []
    for (y, p), n in cells.items():
        rows += [(str(len(rows) + i), y, p) for i in range(n)]
    return frame(spark, rows, "id string, label int, predicted int")


def test_published_confusion_gives_published_metrics(spark):
    m = M.classification_metrics(pred(spark, {(1, 1): 65, (0, 1): 1, (0, 0): 91, (1, 0): 11})).first()
    expected = dict(precision=.9848, recall=.8553, f1=.9155, mcc=.8605, accuracy=.9286, false_positive_rate=.0109,
                    false_negative_rate=.1447)
    for name, value in expected.items():
        assert m[name] == pytest.approx(value, abs=5e-5)


def test_one_class_only(spark):
    m = M.classification_metrics(pred(spark, {(0, 0): 3})).first()
    assert (m["precision"], m["recall"], m["f1"], m["mcc"], m["accuracy"]) == (0, 0, 0, 0, 1)
    scored = frame(spark, [("a", 0, .1), ("b", 0, .2)], "id string, label int, risk double")
    assert M.roc_auc(scored).first()[0] is None


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.choice([0.0, 1.0, .1, .25, .25000001, .9, .99999, rng.random()])) for _ in range(300)]
    scored = frame(spark, rows, "label int, risk double")
    assert M.roc_auc(scored).first()[0] == pytest.approx(brute_auc(rows))
    constant = frame(spark, [(0, .5), (1, .5)], "label int, risk double")
    assert M.roc_auc(constant).first()[0] == 0.5
    points = M.roc_curve(scored).orderBy("fpr", "tpr").collect()
    assert (points[0]["fpr"], points[0]["tpr"], points[-1]["fpr"], points[-1]["tpr"]) == (0, 0, 1, 1)


def test_threshold_matches_a_scan(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < s), s) for s in (round(rng.random(), 5) for _ in range(400))]
    scored = frame(spark, rows, "label int, risk double")
    best, best_thr = -1, .5
    for thr in sorted({round(s, 3) for _, s in rows} | {.5}):
        tp = sum(s >= thr and y for y, s in rows)
        fp = sum(s >= thr and not y for y, s in rows)
        fn = sum(s < thr and y for y, s in rows)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0
        if f1 > best + 1e-12:
            best, best_thr = f1, thr
    out = M.tune_threshold(scored).first()
    assert (out["threshold"], out["metric"]) == (pytest.approx(best_thr), pytest.approx(best))
    capped = M.tune_threshold(scored, "min_fp", .05).first()
    fpr = sum(s >= capped["threshold"] and not y for y, s in rows) / sum(not y for y, _ in rows)
    assert fpr <= .05


def test_ranks_equal_the_plain_window(spark):
    rows = frame(spark, [(i % 3, i) for i in range(1000)], "g int, v int").withColumn("h", F.md5(F.col("v").cast("string")))
    out = ranking.ranked(rows, ["g"], ranking.hash_bucket(F.col("h")), [F.col("h")]).collect()
    for g in range(3):
        mine = sorted((r["h"], r["rank"]) for r in out if r["g"] == g)
        assert [k for _, k in mine] == list(range(1, len(mine) + 1))


def test_latency_summary(spark):
    import statistics

    rows = [(k, float(k % 37) + r) for k in range(101) for r in range(3)]
    out = M.latency_summary(frame(spark, rows, "k int, ms double"), "k", "ms").first()
    best = sorted(float(k % 37) for k in range(101))
    assert out["median_ms"] == statistics.median(best) and out["p95_ms"] == best[95] and out["p99_ms"] == best[99]
    assert out["stdev_ms"] == pytest.approx(statistics.pstdev(best))


def test_wilson(spark):
    out = stats.wilson_interval(frame(spark, [(0, 20), (0, 0), (19, 22)], "k int, n int"), "k", "n").collect()
    assert out[0]["wilson_high"] == pytest.approx(.161, abs=1e-3)
    assert (out[1]["wilson_point"], out[1]["wilson_low"], out[1]["wilson_high"]) == (0, 0, 1)
    assert (out[2]["wilson_low"], out[2]["wilson_high"]) == (pytest.approx(.667, abs=1e-3), pytest.approx(.953, abs=1e-3))


@pytest.mark.parametrize("b, c, p, better", [(75, 1, 2.04e-21, "A"), (0, 0, 1.0, "tie"), (0, 5, .0625, "B"), (4, 4, 1.0, "tie")])
def test_mcnemar(spark, b, c, p, better):
    counts = frame(spark, [(b, c, 0, 0)], "a_correct_b_wrong long, b_correct_a_wrong long, both_correct long, both_wrong long")
    out = stats.mcnemar_from_counts(counts).first()
    assert out["p_value"] == pytest.approx(p, rel=5e-3) and out["better"] == better


def test_mcnemar_on_large_counts(spark):
    counts = frame(spark, [(50_000_000, 49_990_000, 0, 0)],
                   "a_correct_b_wrong long, b_correct_a_wrong long, both_correct long, both_wrong long")
    z = (10_000 - 1) / math.sqrt(99_990_000)
    assert stats.mcnemar_from_counts(counts).first()["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_binomial_draws_follow_the_distribution(spark):
    params = frame(spark, [("a", 40, .3), ("b", 1000, 1.0), ("c", 7, 0.0)], "g string, n long, p double")
    points = frame(spark, [(g, i, (i + .5) / 4000) for g in "abc" for i in range(4000)], "g string, b int, u double")
    out = stats.binomial_draws(params, points, ["g"])
    got = {r["draw"]: r["count"] for r in out.filter("g = 'a'").groupBy("draw").count().collect()}
    for k in range(5, 20):
        want = math.comb(40, k) * .3 ** k * .7 ** (40 - k)
        assert got.get(k, 0) / 4000 == pytest.approx(want, abs=1 / 2000)
    assert out.filter("g = 'b'").agg(F.min("draw"), F.max("draw")).first() == (1000, 1000)
    assert out.filter("g = 'c'").agg(F.min("draw"), F.max("draw")).first() == (0, 0)
    each = points.join(params, "g").withColumn("draw", stats.binomial_quantile(F.col("n"), F.col("p"), F.col("u")))
    assert each.join(out.withColumnRenamed("draw", "d2"), ["g", "b"]).filter("draw <> d2").count() == 0


def test_bootstrap_matches_row_resampling(spark):
    cells = {(1, 1): 65, (0, 1): 1, (0, 0): 91, (1, 0): 11}
    out = {r["metric"]: r for r in stats.bootstrap_ci(pred(spark, cells), n_boot=2000).collect()}
    rng = random.Random(1)
    f1 = []
    for _ in range(2000):
        tp = sum(rng.random() < 65 / 76 for _ in range(76))
        fp = sum(rng.random() < 1 / 92 for _ in range(92))
        f1.append(2 * tp / (2 * tp + fp + 76 - tp))
    f1.sort()
    assert out["f1"]["point"] == pytest.approx(.9155, abs=1e-4)
    assert out["f1"]["ci_low"] == pytest.approx(f1[50], abs=.01) and out["f1"]["ci_high"] == pytest.approx(f1[1950], abs=.01)


def test_cluster_interval_is_wider_when_clusters_agree(spark):
    rows = [(f"{t}-{i}", f"t{t}", t % 2, t % 2 if t % 5 else 1 - t % 2) for t in range(20) for i in range(8)]
    p = frame(spark, rows, "id string, template string, label int, predicted int")
    out = {r["metric"]: r for r in stats.naive_vs_cluster(p, n_boot=400).collect()}
    assert out["recall"]["width_ratio"] > 1.5


def test_calibration(spark):
    rows = [(i, 1 if i % 10 < 3 else 0, .3) for i in range(100)]
    scored = frame(spark, rows, "id int, label int, risk double")
    assert stats.expected_calibration_error(scored).first()[0] == pytest.approx(0.0)
    bins = stats.reliability_bins(scored).collect()
    assert len(bins) == 10 and sum(b["n"] for b in bins) == 100
    edge = frame(spark, [(0, 1, 0.0), (1, 1, 1.0), (2, 0, .1)], "id int, label int, risk double")
    assert {b["bin"]: b["n"] for b in stats.reliability_bins(edge).collect() if b["n"]} == {0: 2, 9: 1}
    train = frame(spark, [(i, int(i % 7 < 3), (i % 50) / 50) for i in range(200)], "id int, label int, risk double")
    iso = [r["isotonic"] for r in stats.isotonic_calibrate(train, train).orderBy("risk").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(iso, iso[1:]))
    platt = stats.platt_calibrate(train, train).agg(F.min("platt"), F.max("platt")).first()
    assert 0 < platt[0] <= platt[1] < 1


def plain_pools(points):
    """Level sets of the isotonic fit over (x, y), by the textbook's one pass."""
    pools = []
    for x in sorted({x for x, _ in points}):
        ys = [y for at, y in points if at == x]
        pools.append([x, x, len(ys), sum(ys)])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return [(lo, hi, s / n) for lo, hi, n, s in pools]


@pytest.mark.parametrize("block, rising", [(2, 0.0), (3, 0.3), (5, -0.6), (4096, 0.3), (4, 1.0)])
def test_isotonic_blocks_merge_to_the_plain_fit(spark, block, rising):
    rng = random.Random(block)
    xs = [round(rng.random(), 2) for _ in range(400)]
    points = [(x, int(rng.random() < 0.5 + rising * (x - 0.5))) for x in xs]
    train = frame(spark, points, "risk double, label int")
    got = sorted((r.low, r.high, r.value) for r in stats.isotonic_pools(train, block=block).collect())
    want = plain_pools(points)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
    # between, on and outside the fitted scores
    asked = [0.0, 1.0, 0.005, 0.5, 0.505, 0.999] + [x for x, _ in points[:30]]
    test = frame(spark, [(i, x) for i, x in enumerate(asked)], "i int, risk double")
    knots = [(x, v) for lo, hi, v in want for x in {lo, hi}]
    wanted = np.interp(asked, *zip(*sorted(knots)))
    out = {r.i: r.isotonic for r in stats.isotonic_calibrate(train, test, block=block).collect()}
    assert [out[i] for i in range(len(asked))] == pytest.approx(list(wanted))


def test_isotonic_without_rows(spark):
    train = frame(spark, [], "risk double, label int")
    test = frame(spark, [(1, 0.5), (2, None)], "i int, risk double")
    assert [r.isotonic for r in stats.isotonic_calibrate(train, test).collect()] == [None, None]
    train = frame(spark, [(0.25, 1)], "risk double, label int")
    assert {r.i: r.isotonic for r in stats.isotonic_calibrate(train, test.filter("i = 1")).collect()} == {1: 1.0}


def test_platt_fit_is_stationary(spark):
    rng = random.Random(8)
    points = [(x, int(rng.random() < 1 / (1 + math.exp(3 - 8 * x)))) for x in (rng.random() for _ in range(300))]
    a, b = stats.platt_fit(frame(spark, points, "risk double, label int"))
    p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in points]
    assert abs(sum(q - y for q, (_, y) in zip(p, points))) < 1e-6
    assert abs(sum((q - y) * x for q, (x, y) in zip(p, points)) + a) < 1e-6
    # separable scores settle through the penalty, no rows mean the middle
    a, _ = stats.platt_fit(frame(spark, [(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "risk double, label int"))
    assert 0 < a < 10
    assert stats.platt_fit(frame(spark, [], "risk double, label int")) == (0.0, 0.0)


def test_binomial_quantile_equals_the_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 7, 60, 5000]), rng.choice([0.0, 1e-4, 0.3, 0.5, 0.99, 1.0]), rng.random()) for i in range(300)]
    rows += [(901, 5, 0.5, 2.0**-53)]
    df = frame(spark, rows, "b long, n long, p double, u double")
    got = {r.b: r.k for r in df.select("b", stats.binomial_quantile(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()}
    for b, n, p, u in rows:
        total, k = 0.0, -1
        while k < n and (k < 0 or total < u):
            k += 1
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k) if n < 1000 else math.exp(
                math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) if 0 < p < 1 else float(k == n * p)
        assert got[b] == k, (n, p, u)
    tail = frame(spark, [(1000, 0.001, 1 - 2.0**-51)], "n long, p double, u double")
    assert tail.select(stats.binomial_quantile(F.col("n"), F.col("p"), F.col("u"))).first()[0] > 14


def test_area_replicates_draw_multinomials(spark):
    """Means and spreads of the draws, one class only, and one score only."""
    rows = [(i / 10, y) for i, (pos, neg) in enumerate([(1, 9), (3, 5), (4, 4), (8, 2)]) for y, k in ((1, pos), (0, neg)) for _ in range(k)]
    df = frame(spark, rows, "risk double, label int")
    got = [r.roc_auc for r in stats.area_replicates(df, 800).collect()]
    rng = np.random.default_rng(1)
    plain = []
    for _ in range(4000):
        pos, neg = (rng.multinomial(sum(c), np.array(c) / sum(c)) for c in ((1, 3, 4, 8), (9, 5, 4, 2)))
        plain.append(sum(n * (pos[i + 1:].sum() + pos[i] / 2) for i, n in enumerate(neg)) / 16 / 20)
    assert len(got) == 800
    assert np.mean(got) == pytest.approx(np.mean(plain), abs=0.01) and np.std(got) == pytest.approx(np.std(plain), abs=0.01)
    one = stats.area_replicates(frame(spark, [(0.1, 1), (0.5, 1)], "risk double, label int"), 10).collect()
    assert len(one) == 10 and all(r.roc_auc is None and r.pr_auc is None for r in one)
    same = stats.area_replicates(frame(spark, [(0.5, 1), (0.5, 0)], "risk double, label int"), 10).collect()
    assert all(r.roc_auc == 0.5 for r in same)
    assert stats.area_replicates(df.filter("false"), 10).count() == 0


def test_kappa(spark):
    def both(a, b):
        return (frame(spark, [(i, x) for i, x in enumerate(a)], "id int, label int"),
                frame(spark, [(i, x) for i, x in enumerate(b)], "id int, label int"))
    k = lambda a, b: agreement.cohen_kappa(*both(a, b)).first()["kappa"]
    assert k([1, 1, 1], [1, 1, 1]) == 1.0
    assert k([1, 1], [0, 0]) == 0.0
    assert k([1, 1, 1, 0, 0, 0, 1, 0, 1, 0], [1, 1, 0, 0, 0, 1, 1, 0, 1, 0]) == pytest.approx(.6)
    a = frame(spark, [("x", 1), ("y", 0), ("z", 1)], "id string, label int")
    b = frame(spark, [("y", 1), ("z", 1), ("w", 0)], "id string, label int")
    r = agreement.agreement_report(a, b).first()
    assert (r["n_scored"], r["n_disagreements"], r["n_only_a"], r["n_only_b"]) == (2, 1, 1, 1)
    assert {(x["id"], x["kind"]) for x in agreement.agreement_rows(a, b).collect()} == {
        ("x", "only_a"), ("w", "only_b"), ("y", "disagreement")}


@pytest.mark.parametrize("kappa, band", [(-.1, "worse than chance"), (0.0, "slight"), (.2, "fair"), (.59, "moderate"),
                                         (.6, "substantial"), (.8, "almost perfect")])
def test_kappa_band(spark, kappa, band):
    assert spark.range(1).select(agreement.kappa_band(F.lit(kappa))).first()[0] == band


def test_splits_and_folds(spark):
    rows = [(f"r{i}", f"c{i % 3}", int(i % 5 == 0), f"t{i % 17}") for i in range(600)] + [("lone", "c9", 1, "t0")]
    df = frame(spark, rows, "id string, category string, label int, template string")
    marked = splits.stratified_split(df)
    assert marked.count() == 601 and marked.filter("id = 'lone'").first()["split"] == "train"
    for r in marked.groupBy("category", "label").agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).collect():
        if r["n"] > 1:
            assert r["t"] == max(1, round(r["n"] * .4))
    again = splits.stratified_split(df.repartition(13))
    assert sorted(map(tuple, again.select("id", "split").collect())) == sorted(map(tuple, marked.select("id", "split").collect()))
    folds = splits.stratified_folds(df).groupBy("fold").agg(F.sum("label").alias("p")).collect()
    assert len(folds) == 5 and max(f["p"] for f in folds) - min(f["p"] for f in folds) <= 1
    grouped = splits.grouped_folds(df)
    assert grouped.groupBy("template").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    sizes = [r["count"] for r in grouped.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 2 * min(sizes)


def test_findings(spark):
    corpus = frame(spark, [("a",), ("b",), ("c",)], "id string")
    findings = frame(spark, [("a", "warning"), ("a", "info"), ("b", "style")], "id string, level string")
    out = {r["id"]: (r["flag"], r["flag_error"], r["n_findings"]) for r in M.findings_to_decision(corpus, findings).collect()}
    assert out == {"a": (True, False, 2), "b": (False, False, 1), "c": (False, False, 0)}
