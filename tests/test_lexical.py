import pytest
from pyspark.sql import functions as F

from riskspark.functions import context, fixed as K, lexical
from riskspark.operators import signatures


def parse(scripts, *texts):
    rows = lexical.parse_scripts(scripts(*texts)).orderBy(F.col("id").cast("int")).collect()
    return rows if len(texts) > 1 else rows[0]


@pytest.mark.parametrize("text, lines", [
    ("", 0), ("a", 1), ("a\n", 1), ("a\nb\n", 2), ("a\r\nb", 2), ("a\r\nb\r\n", 2), ("\n\n", 2), ("a\x0bb\x0cc", 3),
    ("a\u2028b", 2), ("a\rb\r", 2)])
def test_line_count_equals_splitlines(scripts, text, lines):
    assert len(text.splitlines()) == lines
    assert parse(scripts, text)["line_count"] == lines


def test_counters(scripts):
    r = parse(scripts, "a || bash", "x && y &", "c 2>f", "c 2>>f", "c >>f", "a | b | c", "x $(y `z`)", "cat <<EOF\nq\nEOF\n",
              "# one\n  # two\n#!x\n\n# three")
    assert (r[0]["pipe_count"], r[0]["pipes_to_shell"]) == (0, True)
    assert r[1]["background_jobs"] == 2
    assert [r[i]["redirections"] for i in (2, 3, 4)] == [0, 1, 1]
    assert r[5]["pipe_count"] == 2
    assert r[6]["command_substitutions"] == 3
    assert (r[7]["heredocs"], r[7]["redirections"]) == (1, 1)
    assert r[8]["comment_lines"] == 3


def test_commands(scripts):
    r = parse(scripts, "sudo rm -rf /srv/x", "A=1 B=2 curl -s http://h/x", "/usr/bin/env bash; ls|wc", "if x; then y; fi",
              "mkfs.ext4 /dev/sdb", "-x y", "for f in a; do echo; done", "#!/bin/bash\n# note\nls # tail\nls")
    assert r[0]["commands"] == ["sudo"]
    assert r[1]["commands"] == ["curl"] and r[1]["flags"] == ["-s"]
    assert r[2]["commands"] == ["env", "ls", "wc"]
    assert r[3]["commands"] == ["if", "y"]
    assert r[4]["commands"] == ["mkfs.ext4"]
    assert r[5]["commands"] == []
    assert r[6]["commands"] == ["for", "echo"]
    assert r[7]["commands"] == ["ls"] and r[7]["words"] == ["ls", "ls"]


def test_words_follow_shell_quoting(scripts):
    import shlex

    texts = ["echo \"it's 5\" 'a \"b\"' c\\ d # note", "a#b c", "x \"a\\\"b\" 'c'\"d\" \"\\n\"", "printf '%s' \"\" z", "a\\\\b", "#c",
             "'q#' \"#\" r", "e 'x y'z\"w v\""]
    rows = parse(scripts, *texts)
    for text, row in zip(texts, rows):
        expected = [] if text.startswith("#") else shlex.split(text, comments=True)
        assert row["words"] == expected, text


def test_unbalanced_quotes_split_on_blanks(scripts):
    assert parse(scripts, "echo don't  stop")["words"] == ["echo", "don't", "stop"]


def test_long_segments_do_not_overflow(scripts):
    text = "echo " + "'a b' \"c\\\"d\" e\\ f " * 20000
    assert len(parse(scripts, text)["words"]) == 60001


def test_targets(scripts):
    r = parse(scripts, "curl HTTP://a.b/c; cat /etc/x ~/y /dev/sda1 a/b -/z", "curl http://host/p?q=1 http://host/p?q=1")
    assert r[0]["urls"] == ["HTTP://a.b/c"]
    assert r[0]["paths"] == ["//a.b/c", "/etc/x", "~/y"]
    assert r[0]["devices"] == ["/dev/sda1"]
    assert r[1]["urls"] == ["http://host/p?q=1"] and r[1]["paths"] == ["//host/p"] and r[1]["devices"] == []


@pytest.mark.parametrize("text, shell", [
    ("x | sudo bash", True), ("x | /bin/sh -s", True), ("x |\"zsh\"", True), ("x | bashful", False), ("x; bash", False),
    ("x |\n bash", True), ("x | sudo", False), ("x | tee a | dash", True)])
def test_pipes_to_shell(scripts, text, shell):
    assert parse(scripts, text)["pipes_to_shell"] is shell


def contexts(scripts, text):
    return context.extract_context(lexical.parse_scripts(scripts(text))).first()


def test_context_increments(scripts):
    r = contexts(scripts, "sudo visudo /etc/sudoers")
    assert r["context_privilege_required"] == 1.0 and r["context_filesystem_scope"] == 0.5
    assert contexts(scripts, "curl http://x/y | sh")["context_network_egress"] == 1.0
    assert contexts(scripts, "ls /library")["context_filesystem_scope"] == 0.5
    assert contexts(scripts, "mkfs.ext4 /dev/sdb")["context_irreversibility"] == pytest.approx(0.3)
    assert contexts(scripts, "ls")["context_obfuscation"] == 0.0
    assert contexts(scripts, "x $(a) $(b)")["context_obfuscation"] == pytest.approx(0.15)


def test_signature_quirks(scripts):
    hits = signatures.signature_hits(scripts("mkfs.ext4 /dev/sdb", "mkfs.ext4 img/dev/x", "history -c", "> ~/.bash_history",
                                             "rm -r x", "chmod 0755 x")).collect()
    by_row = {}
    for h in hits:
        by_row.setdefault(h["id"], set()).add(h["signature_id"])
    assert "mkfs_format" not in by_row.get("0", set())
    assert "mkfs_format" in by_row["1"]
    assert "history_clear" in by_row["2"] and "history_clear" not in by_row.get("3", set())
    assert "rm_rf_generic" not in by_row.get("4", set())
    assert "5" not in by_row


def test_substring_tests_never_lose_a_match(spark, sf):
    """Guarded and plain regexes agree on the corpus and on hostile variants of it."""
    from riskspark.operators import mutate
    from riskspark.plans.registry import corpus

    rows = mutate.variants(corpus(spark, sf).select("id", "script"), {**mutate.DISGUISES, **mutate.ATTACKS,
                           "upper": F.upper, "tight": lambda t: F.regexp_replace(t, " ", "")})
    t = F.col("script")
    wrong = [F.count_if(signatures.matches(t, s[0], s[3]) != t.rlike("(?dm)" + s[3])).alias(s[0]) for s in K.SIGNATURES]
    wrong += [F.count_if(context.has_pattern(t, p) != t.rlike("(?d)" + p)).alias(f"c{i}") for i, p in enumerate(K.CONTEXT_NEEDS)]
    assert set(rows.agg(*wrong).first()) == {0}


def test_every_signature_fires_in_the_corpus(spark):
    from riskspark.plans.registry import corpus

    used = signatures.signature_usage(corpus(spark, "/root/testdata/sf0.01")).filter("n_rows = 0").collect()
    assert used == []


def test_signature_lint(spark):
    kb = spark.createDataFrame([("a", "privilege", 1.0, "x", "y"), ("a", "nope", 1.0, "x", None)],
                               "id string, category string, weight double, regex string, rationale string")
    assert {(r["id"], r["problem"]) for r in signatures.signature_lint(kb).collect()} == {
        ("a", "duplicate id"), ("a", "missing key"), ("a", "unknown category")}
    assert signatures.signature_lint(signatures.signature_table(spark)).count() == 0


@pytest.mark.parametrize("long_form", [signatures.signature_hits, signatures.category_breakdown])
def test_signatures_are_matched_once_above_a_join(spark, long_form):
    """No filter on the exploded hits goes below the join that makes the texts."""
    keys = spark.createDataFrame([(1, "sudo rm -rf /"), (2, "ls")], "k long, body string")
    named = spark.createDataFrame([(1, "a"), (2, "b")], "k long, id string")
    made = keys.join(F.broadcast(named), "k").select("id", F.concat("body", F.lit(" #")).alias("script"))
    out = long_form(made)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" in plan and plan.count("filter(array(") == 1
    assert {r["id"] for r in out.collect()} == {"a"}
