"""Spelling groups against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskspark.llm import spelling


def plain_counts(rows, misspelt=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if misspelt and h % misspelt == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(rows, misspelt=97):
    counts, forms, out = plain_counts(rows, misspelt), {}, {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, vs in near.items():
        best = min(((-counts[v], v) for v in vs), default=None)
        if best and -best[0] >= 2 * counts[w]:
            forms[w] = best[1]
    for w in counts:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, counts[w], len(near[w]), counts.get(forms.get(w)))
    return out


def found(docs, **options):
    rows = spelling.spelling_groups(docs, **options).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(8)]
    words = []
    for _ in range(1500):
        word = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + rng.choice("ab") + word[i:], word[:i] + word[i + 1:], word[:i] + rng.choice("ab") + word[i + 1:]])
        words.append(word)
    # a form that has a form itself
    words += ["ladder"] * 30 + ["laddex"] * 9 + ["laddyx"] * 4
    return [(i, " ".join(words[i * 15:i * 15 + 15])) for i in range(103)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    wanted = plain_groups(rows)
    assert any(root != form for form, root, *_ in wanted.values() if form) and max(v[3] for v in wanted.values()) > 5
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted


def test_edges_of_the_contract(spark):
    long = "x" * 3000
    rows = [(None, "Hello HELLO hello Hallo hallo"), (1, None), (2, ""), (3, " 1 2 "), (4, "hello-hello_hello HALLO"),
            # words inside words, one longer, repeated letters, and a very long pair
            *((i, "aaaaa aaaaaa aaaaaaa baaaa aaaab aaaa") for i in range(10, 14)), (14, "aaaaa " * 20),
            *((i, f"{long} {long[:1500]}y{long[:1499]} {long}x") for i in range(20, 24)),
            # capitals beyond A-Z stay, repeated rows count each
            (30, "Éclair éclair ÉCLAIR " * 3), (31, "Éclair"), (31, "Éclair")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, node string")
    assert found(docs) == plain_groups(rows)
    assert found(docs, misspelt=None) == plain_groups(rows, None)
    assert found(docs.where("false")) == {}


def test_shared_prefixes_of_many_words(spark):
    """One long prefix that a group of words shares, differing late, early and by length."""
    rng = random.Random(9)
    words = ["prefixprefix" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    words += [w[::-1] for w in words] + [rng.choice("pqr") + w[1:] for w in words]
    rows = [(i, " ".join(words)) for i in range(3)] + [(9, " ".join(words[::3]) * 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == plain_groups(rows)
