"""BPE, token counts, LM scores and PII against plain forms of the same thing."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from riskspark.llm import bpe, ngram_lm, pii, token_count
from riskspark.llm.common import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Library.from_file(VOCABULARY)

# Nulls, blanks, a special token, contractions, other scripts, very long runs, repeated
# rows, and columns that operators use themselves.
TEXTS = [
    (1, "The thing's done; we'll see. They're it's 'tis"), (2, None), (3, ""), (4, "  \n\n \t x  y\n z  "),
    (5, "a<|endoftext|>b<|endoftext|>"), (6, "naïve café 漢字 😀 ²³ ٣٤ \x1c\x85 end"), (7, "ab" * 4000 + " " + "=-" * 700),
    (8, "the same row"), (8, "the same row"), (9, "the same row"), (None, "no id at all"), (10, "word " * 3000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1.0, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, key string")


def by_id(df):
    found = collections.defaultdict(list)
    for r in df.collect():
        found[r.doc_id].append(r)
    return found


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(docs):
    rows = by_id(bpe.round_trip(docs, VOCABULARY))
    assert sum(map(len, rows.values())) == len(TEXTS)
    for i, text in TEXTS:
        for r in rows[i]:
            assert list(r.ids) == library_ids(text)
            assert r.decoded == (text or "")
    digest = by_id(bpe.digests(bpe.round_trip(docs, VOCABULARY)))[6][0]
    ids = library_ids(TEXTS[5][1])
    assert digest.n_tokens == len(ids)
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_bpe_round_trip_is_one_step(docs):
    """Encoding and decoding share the workers and their tables."""
    coded = bpe.round_trip(docs, VOCABULARY)
    assert coded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = by_id(bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY))
    assert by_id(coded) == apart


def test_bpe_short_and_long_words_merge_alike():
    own, rng = bpe.Tokenizer(VOCABULARY), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("theandionr") for _ in range(rng.randint(1, 60))).encode()
        assert own.encode_word(word) == own._encode_long([own.byte_ids[b] for b in word])


def test_word_patterns_agree_where_the_common_one_is_used():
    own = bpe.Tokenizer(VOCABULARY)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000 or own.odd.search(chr(c)):
            continue
        text = f"a{chr(c)}1{chr(c)} {chr(c)}'s_"
        assert own.pattern.findall(text) == bpe.COMMON_PATTERN.findall(text)


def test_token_counts_equal_the_library(docs):
    rows = by_id(token_count.token_counts(docs, VOCABULARY, limit=100))
    for i, text in TEXTS:
        for r in rows[i]:
            n = len(library_ids(text))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text or "").encode()), n > 100)


def test_token_counts_of_random_strings():
    compiled, rng = token_count.machine(VOCABULARY), random.Random(1)
    texts = ["".join(rng.choice("ab cde'stmdrvle THR\n\t12.,é　\x85ß漢") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert token_count.count_tokens(texts, compiled).tolist() == [len(library_ids(t)) for t in texts]


def test_merge_machine_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(token_count, "MAX_STATES", 50)
    compiled = token_count.MergeMachine(bpe.Tokenizer(VOCABULARY))
    for text in ("the quick brown foxes", "jumped over lazy dogs", "again and again"):
        assert token_count.count_tokens([text], compiled)[0] == len(library_ids(text))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.round_trip(none, VOCABULARY).count() == 0
    assert token_count.token_counts(none, VOCABULARY).count() == 0
    assert pii.find_identifiers(none).count() == 0
    assert ngram_lm.lm_scores(none).count() == 0


def plain_model(texts):
    """The bigram model of some token lists, with dictionaries."""
    words, pairs = collections.Counter(), collections.Counter()
    for t in texts:
        words.update(t)
        pairs.update(zip([None] + t, t))

    def discount(counts):
        return ngram_lm.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])

    before = collections.Counter(w for _, w in pairs)
    d2, d1 = discount(list(pairs.values())), discount(list(before.values()))
    total, rest = collections.Counter(), collections.Counter()
    for (h, _), n in pairs.items():
        total[h] += n
        rest[h] += d2[min(n, 3)]
    uniform = sum(d1[min(c, 3)] for c in before.values()) / len(pairs) / (len(words) + 1)

    def p(h, w):
        low = (before[w] - d1[min(before[w], 3)]) / len(pairs) + uniform
        if not total[h]:
            return low
        n = pairs[h, w]
        return (n - d2[min(n, 3)] + rest[h] * low) / total[h]

    return words, p


def test_lm_scores_equal_a_plain_model(spark, docs):
    rng = random.Random(4)
    words = ["the", "of", "and"] * 5 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(100, 220)] + TEXTS
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    lists = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    known, p = plain_model([t for (i, _), t, h in zip(rows, lists, held) if i is not None and not h])
    n, v = sum(known.values()), len(known)
    got = by_id(ngram_lm.lm_scores(df))
    for (i, _), t, h in zip(rows, lists, held):
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (h, len(t), n, sum(known[w] > 0 for w in t))
            assert r.base_score == pytest.approx(sum(math.log10((known[w] + 1) / (n + v + 1)) for w in t))
            assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None] + t, t)))
    some = sorted(known)[0]
    assert sum(p(some, w) for w in known) + p(some, b"never seen") == pytest.approx(1)


def test_lm_counts_above_a_byte_and_hot_contexts(spark):
    df = spark.createDataFrame([(i, "again " * 700) for i in range(1, 6)], "doc_id long, text string")
    scratch = Scratch(spark, "lm")
    model = ngram_lm.fit(df, scratch, 4)
    words = ngram_lm.Words(model.vocabulary)
    context, number, _, _ = ngram_lm.pair_keys([[b"again", b"again", b""]], words)
    assert model.pair_counts(context, number).tolist() == [5, 5 * 699, 5]


def test_lm_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = ngram_lm.lm_scores(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in p.finditer(text) if good(k, m[0])] for k, p in PLAIN.items()}


def test_base_spans_of_random_strings():
    rng = random.Random(3)
    pieces = ["a", "b@", "@", ".", "1", "23", "+4", "-", " ", "x.y", "255", "300", ".1", "(", ")", "٣", "4111 1111 1111 1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text, kind, found", [
    ("write john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("mail jane at mail dot example dot org", "email", "jane at mail dot example dot org"),
    ("ｕser＠ｅxample．com ok", "email", "ｕser＠ｅxample．com"),
    ("call plus four nine one five two three four five six", "phone", "plus four nine one five two three four five six"),
    ("host 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ("n ٤١١١١١١١١١١١١١١١", "card", "٤١١١١١١١١١١١١١١١"),
])
def test_disguised_identifiers(text, kind, found):
    base = pii.base_spans(text)
    added = pii.added_spans("ß — " + text, pii.base_spans("ß — " + text))
    assert base[kind] == []
    assert [("ß — " + text)[a:b] for a, b in added[kind]] == [found]


@pytest.mark.parametrize("text", ["we met at noon", "dot com at last", "one two three", "İstanbul at home", ""])
def test_plain_prose_adds_nothing(text):
    assert not any(pii.added_spans(text, pii.base_spans(text)).values())


def test_pii_rows(spark, docs):
    mail = "x a.b@c.de, 10.0.0.1 and +49 151 2345678 or 4111-1111-1111-1111"
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, mail)], "doc_id long, text string"))
    rows = by_id(pii.find_identifiers(df))
    r = rows[77][0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 1, 1, 0)
    want = ",".join(f"{k}:{a}:{b}" for k, s in plain_spans(mail).items() for a, b in s)
    assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert rows[2][0].spans == "" and rows[2][0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(rows[8]) == 2


def test_identifiers_in_very_long_texts(spark):
    """A megabyte of one letter, blanks or digits beside disguises, and huge numbers."""
    texts = ["x dot y " + "a" * 1_000_000, "a dot b [" + " " * 1_000_000 + "]", "0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1",
             "a@" * 200_000, "joe at mail dot com " + "one " * 200_000 + "ann (at) x [dot] org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_identifiers(docs).collect()}
    assert got[2].n_ip == 1 and got[3].n_ip == 0
    assert [got[i].spans for i in (0, 1, 4)] == ["", "", ""]
    last = len(texts[5])
    assert got[5].spans.startswith("email:0:19,") and f"email:{last - 20}:{last}" in got[5].spans


def test_addresses_side_by_side():
    """A name is no end of the domain before it."""
    for text, spans in (("a@b dot c@d dot e@f dot g", [(0, 9), (16, 25)]), ("a at b dot c at d dot e", [(0, 12)]),
                        ("@b dot c", []), ("x [at] y [dot] z", [(0, 16)])):
        assert pii.added_spans(text, pii.base_spans(text))["email"] == spans, text
