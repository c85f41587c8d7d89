"""Folders that a manifest may stand beside, and the prompt of collected replies."""

import json
import os

import numpy as np
import pytest

from riskspark.operators import scoring, stats
from riskspark.sources.corpus import conversations_to_corpus, read_corpus, write_results


@pytest.mark.parametrize("name", ["data/v1/data", "b+c", "with blank", "a%20b"])
def test_bodies_by_path_below_the_base(spark, tmp_path, name):
    base = f"{tmp_path}/{name}"
    os.makedirs(f"{base}/sub/data/x y+z")
    with open(f"{base}/sub/data/x y+z/s 1.sh", "w") as f:
        f.write("ls")
    rows = [{"id": "1", "category": "c", "label": 0, "path": "sub/data/x y+z/s 1.sh"}]
    lost = [{"id": "2", "category": "c", "label": 0, "path": "none.sh"}]
    for file, content in (("good", rows), ("bad", rows + lost)):
        with open(f"{tmp_path}/{file}.jsonl", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in content)
    assert [r.script for r in read_corpus(spark, f"{tmp_path}/good.jsonl", base).collect()] == ["ls"]
    lenient = read_corpus(spark, f"{tmp_path}/bad.jsonl", base, strict=False)
    assert [(r.id, r.script) for r in lenient.collect()] == [("1", "ls")]
    with pytest.raises(Exception, match="no script at none.sh"):
        read_corpus(spark, f"{tmp_path}/bad.jsonl", base).collect()


def test_replies_know_their_prompt(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "first?"), (1, 1, "assistant", "#!/bin/sh\nls"), (1, 2, "user", "again?"),
         (1, 3, "assistant", "#!/bin/sh\npwd"), (2, 0, "assistant", "#!/bin/sh\nid")],
        "conv_id long, turn long, role string, text string")
    got = {r.id: r.prompt for r in conversations_to_corpus(conv).collect()}
    assert got == {"llm_local_001_0": "first?", "llm_local_001_1": "again?", "llm_local_002_0": None}


def test_area_intervals_follow_a_plain_bootstrap(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 300)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * label, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(str(i), float(s), int(y)) for i, (s, y) in enumerate(zip(score, label))],
                               "id string, risk double, label int")
    got = {r.metric: r for r in stats.bootstrap_auc_ci(df).collect()}

    def roc(s, y):
        p, n = s[y == 1], s[y == 0]
        return ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)

    draws = []
    for _ in range(1000):
        pick = np.concatenate([rng.choice(np.flatnonzero(label == k), (label == k).sum()) for k in (0, 1)])
        draws.append(roc(score[pick], label[pick]))
    assert got["roc_auc"].n_boot == 2000
    assert got["roc_auc"].point == pytest.approx(roc(score, label))
    assert got["roc_auc"].ci_low == pytest.approx(np.quantile(draws, 0.025), abs=0.01)
    assert got["roc_auc"].ci_high == pytest.approx(np.quantile(draws, 0.975), abs=0.01)
    assert got["pr_auc"].ci_low < got["pr_auc"].point < got["pr_auc"].ci_high


def test_tails_of_rare_events_are_not_cut(spark):
    params = spark.createDataFrame([("a", 1000, 0.001)], "cls string, n long, p double")
    points = spark.createDataFrame([("a", 0, 1 - 2.0**-51)], "cls string, b long, u double")
    (row,) = stats.binomial_draws(params, points, ["cls"]).collect()
    assert row.draw > 14


def test_results_are_written_compressed(spark, scripts, tmp_path):
    path = str(tmp_path / "results")
    write_results(scoring.analyze(scripts("ls -la /srv/x\n" * 50, "sudo rm -rf /")), path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".txt.gz") for f in files)
    assert spark.read.json(path).count() == 2
