"""Exact and near dedup, repeats and decontamination against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, exact_dedup, repeats, similar, simhash
from riskspark.llm.common import Scratch

ROWS = [
    (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon"), (5, "one"),
    (6, "one"), (6, "one"), (None, "one"), (None, "alone"), (7, "x " * 5000), (8, "Alpha beta gamma delta epsilon"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "h", 2, "c") for i, t in ROWS],
                                 "doc_id long, text string, _h string, key int, component_id string")


def rows_by(df, *keys):
    return collections.Counter(tuple(r[k] for k in keys) for r in df.collect())


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(docs, keep, collide):
    # with one hash for all texts only the bytes tell groups apart
    digest = (lambda t: F.lit(b"0" * 16)) if collide else exact_dedup.content_hash
    got = rows_by(exact_dedup.text_groups(docs, keep, digest=digest), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = collections.Counter()
    for i, t in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        want[i, best, len(groups[t or ""]), i == best, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_exact_stage_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs, keep="max")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 6, 7, 8, None}
    assert exact_dedup.text_groups(docs.limit(0)).count() == 0


def test_exact_stage_moves_a_text_once(docs):
    plan = exact_dedup.drop_copies(docs, keep="max")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def plain_fingerprint(text, size=4):
    words = text.encode().lower().split()
    k = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << p for p in range(64) if 2 * sum(h >> p & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_groups(spark, docs):
    rng, rows = random.Random(1), list(ROWS)
    base = [f"t{i}" for i in range(80)]
    for i in range(100, 160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 30])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_groups(df, blocks=6, bucket_rows=5).collect()
    assert len(got) == len(rows)
    fps = {i: plain_fingerprint(t or "") for i, t in rows if i is not None}
    linked = [(a, b) for a in fps for b in fps if a > b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    want = roots(fps, linked)
    assert len(set(want.values())) < len(want)
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == sorted([want[5], None], key=str)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert simhash.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 300).astype(np.uint64)
    for i in range(1, 300, 2):
        fps[i] = fps[i - 1]
        for p in rng.choice(64, rng.integers(0, 9), replace=False):
            fps[i] ^= np.uint64(1) << np.uint64(p)
    planes = simhash.bit_planes(fps)
    for d in (1, 2, 63, 64, 65, 200):
        lanes = np.zeros(300, bool)
        lanes[:-d] = True
        got = set(simhash.within_radius(planes, d, simhash.lane_words(lanes), radius).tolist())
        assert got == {i for i in range(300 - d) if bin(int(fps[i]) ^ int(fps[i + d])).count("1") <= radius}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 140)] + [(300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component_id for r in simhash.components(df, Scratch(spark, "t")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)


def plain_repeats(texts, length):
    count = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                hit[p:p + length] = b"\1" * length
        kept = bytes(b for b, x in zip(t, hit) if not x)
        runs = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, hot", [(12, 4, 256), (12, 12, 1), (7, 3, 2), (40, 9, 256)])
def test_repeats_equal_brute_force(spark, length, gram, hot):
    rng = random.Random(length + hot)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(8, 60))) for _ in range(6)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.4 else "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30)))
                     for _ in range(rng.randint(0, 5))) for _ in range(50)]
    texts += ["", "a" * 300, "ab" * 90, "same row, long enough to be repeated as a whole"]
    rows = list(enumerate(texts)) + [(len(texts) - 1, texts[-1]), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = collections.Counter(tuple(r) for r in repeats.remove_repeats(df, length, gram, hot).collect())
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain_repeats([(t or "").encode() for _, t in rows], length)))
    assert got == want


def plain_keep_first(rows, length):
    """(spans, kept) by text: the first start of every string, by id, then place, stays."""
    first, out = {}, {}
    for i, t in sorted(set(rows)):
        hit = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first.setdefault(t[p:p + length], (i, p)) != (i, p):
                hit[p:p + length] = b"\1" * length
        edges = [p for p in range(len(t) + 1) if (p and hit[p - 1]) != (p < len(t) and hit[p])]
        out[i] = (list(zip(edges[::2], edges[1::2])), bytes(b for b, x in zip(t, hit) if not x))
    return out


@pytest.mark.parametrize("length, gram, bucket", [(12, 4, 256), (12, 5, 1), (90, 6, 2)])
def test_repeats_keep_first_and_text(spark, length, gram, bucket):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(length + length // 2))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) + passage[rng.randint(0, 9):rng.choice((length + 3, 999))]
             + "".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) for _ in range(60)]
    texts += ["", "xyz" * 80, passage + "-" + passage]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for first in (True, False):
        got = repeats.remove_repeats(df, length, gram, bucket, keep_first=first, with_text=True).collect()
        assert len(got) == len(rows)
        plain = plain_keep_first([(i, t.encode()) for i, t in rows], length)
        whole = plain_repeats([t.encode() for _, t in rows], length)
        for r in got:
            spans = [(s.lo, s.hi) for s in r.spans]
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
            assert (len(spans), sum(b - a for a, b in spans)) == (r.n_spans, r.n_removed)
            if first:
                assert (spans, bytes(r.kept)) == plain[r.doc_id]
            else:
                assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == whole[r.doc_id]


def test_factor_lengths_equal_brute_force():
    rng = np.random.default_rng(5)
    for length in (5, 12, 40):
        data = np.frombuffer(bytes(rng.choice(list(b"ab"), 160).astype(np.uint8)) * 2, np.uint8)
        starts = np.sort(rng.choice(len(data) - length + 1, 120, replace=False))
        raw = data.tobytes()

        def common(a, b):
            return next((k for k in range(length) if raw[a + k] != raw[b + k]), length)

        for back in (False, True):
            want = [max((common(a, b) for b in starts if (b > a if back else b < a)), default=0) for a in starts]
            assert repeats.longest_previous_factors(data, starts, length, back).tolist() == want


def test_repeats_in_pieces_and_empty_tables(monkeypatch, docs):
    data = np.frombuffer(("".join(random.Random(1).choice("abc") for _ in range(3000))).encode(), np.uint8)
    whole = repeats.anchors(data, 50, 8)
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.anchors(data, 50, 8)
    assert [s for _, _, a, b in pieces for s in range(a, b + 1)] == [s for _, _, a, b in whole for s in range(a, b + 1)]
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_previous_factors():
    data = np.frombuffer(b"abcdefghij-abcdefghij-xabcdefghi", np.uint8)
    starts = np.arange(len(data) - 9)
    earlier, later = repeats.previous_factors(data, starts, 10)
    assert np.flatnonzero(earlier).tolist() == [11, 12]
    assert np.flatnonzero(later).tolist() == [0, 1]


def plain_contained(docs, items, size=5, threshold=0.8):
    import regex

    def words(t):
        return regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower())

    def shingles(w, k):
        return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}

    out = {}
    for j, t in items:
        w = words(t)
        if not w or j is None:
            continue
        k = min(size, len(w))
        mine = shingles(w, k)
        for i, d in docs:
            shared = len(mine & shingles(words(d), k))
            if i is not None and shared / len(mine) >= threshold - 1e-12:
                out[i, j] = (len(mine), shared)
    return out


def test_contained_items(spark):
    rng = random.Random(8)
    item = [[f"q{j}x{i}" for i in range(n)] for j, n in enumerate((1, 3, 5, 6, 9, 24, 60))]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300))]
        for it in rng.sample(item, 2):
            piece = list(it)
            for _ in range(rng.choice([0, 0, 1, 2])):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = piece
        rows.append((i, "  ".join(words).upper() if i % 3 else ", ".join(words)))
    rows += [(90, None), (91, ""), (92, "!!"), (93, rows[0][1]), (93, rows[0][1]), (None, rows[0][1])]
    items = [(j, " ".join(w)) for j, w in enumerate(item)] + [(50, None), (51, "?"), (52, " ".join(item[5])), (None, "q1x0")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(j, t, 5) for j, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.contained_items(docs, bench).collect()}
    want = plain_contained(rows, items)
    assert got == want and want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def plain_shingles(text, size=5):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_similar(rows):
    """Component of every row number, by Jaccard of all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return roots(range(len(rows)), near)


def test_similar_stage_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in ROWS if i is not None] + [(900, " "), (901, "a b c d e f"), (902, "A b c d  e f")]
    common = [f"c{i}" for i in range(60)]
    for g in range(25):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 150]))] + (common if g % 2 else [])
        for _ in range(4):
            words = list(base)
            # a changed word changes five runs, so this lies on both sides of 0.8
            for _ in range(rng.randint(0, 1 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(words)))
    rows.append((1000, "shares its id with another text"))
    group = plain_similar(rows)
    fps = [plain_fingerprint(t or "", 5) for _, t in rows]
    far = [(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j] and (fps[i] ^ fps[j]).bit_count() > 4]
    assert far and len(set(group.values())) > 25
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, node int")
    best = {}
    for n, (i, t) in enumerate(rows):
        key = (i, hashlib.md5((t or "").encode()).digest())
        best[group[n]] = min(best.get(group[n], key), key)
    kept = similar.drop_similar(df.unionByName(spark.createDataFrame([(None, "one", -1)], df.schema)))
    assert kept.columns == df.columns
    want = collections.Counter(i for n, (i, t) in enumerate(rows) if best[group[n]] == (i, hashlib.md5((t or "").encode()).digest()))
    assert collections.Counter(r.doc_id for r in kept.collect()) == want + collections.Counter([None])
    assert similar.drop_similar(df.limit(0)).count() == 0
    # keys of more than two sets are dealt to several tasks
    dealt = similar.drop_similar(df, key_rows=2)
    assert collections.Counter(r.doc_id for r in dealt.collect()) == want


def test_stages_count_rows_by_id_and_text(spark):
    item = "one two three four five six seven"
    rows = [(5, "A"), (5, "B"), (9, "A"), (9, "A"), (None, "A"), (7, f"so {item} it"), (7, "clean"), (8, "C"), (8, "C")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = exact_dedup.drop_copies(docs, keep="max")
    assert rows_by(kept, "doc_id", "text") == collections.Counter(
        [(5, "B"), (9, "A"), (None, "A"), (7, f"so {item} it"), (7, "clean"), (8, "C")])
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert rows_by(left, "doc_id", "text") == collections.Counter(r for r in rows if item not in r[1])


def test_near_dedup_rounds_broadcast_nothing(spark, monkeypatch):
    """Each broadcast leaves a thread and its memory in the driver.  Sets keep theirs: their
    keys stay in place; so do buckets of links, for the few that are cut."""
    plans, store = [], Scratch.store

    def watched(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(self, df, name)

    monkeypatch.setattr(Scratch, "store", watched)
    texts = [" ".join(f"w{j}" for j in range(60)) + f" tail{i % 3}" for i in range(12)] + [f"other text {i} of its own" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert similar.drop_similar(df).count() == 6
    assert {name for name, plan in plans if "BroadcastExchange" in plan} <= {"rows-of", "shared", "rows", "first-pairs"}
    assert any("star" in name for name, _ in plans)


def far_copies(rng, groups=2, copies=120):
    """Texts with up to eight words of one text changed, left out or cut off, most of them
    too far from each other; some have a line of their own group in common."""
    texts = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(140)]
        line = [f"g{g}line{i}" for i in range(12)]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(words))
                words[at:at + 1] = [] if rng.random() < 0.2 else [f"z{rng.randrange(10**6)}" if rng.random() < 0.8 else base[at // 2]]
            if rng.random() < 0.2:
                words = words[:rng.randint(100, 140)]
            texts.append(" ".join(words + line * (c % 4 == 0)))
    return [(i, t) for i, t in enumerate(dict.fromkeys(texts))]


@pytest.mark.parametrize("pair_rows", [4, 32])
def test_many_far_copies_equal_brute_force(spark, pair_rows):
    rows = far_copies(random.Random(8))
    # links that SimHash finds would hide what the prefix search misses
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), radius=0, blocks=1, pair_rows=pair_rows)
    found, group = {r.doc_id: r.component_id for r in got.collect()}, plain_similar(rows)
    assert len(set(group.values())) > 20
    assert len(found) == len(rows) and len(set(zip(found.values(), (group[i] for i in found)))) == len(
        set(found.values())) == len(set(group.values()))


def test_far_copies_do_not_meet_in_pairs(spark, monkeypatch):
    """Copies of one text share most runs with all others, but meet by what they change.
    Met by every run of their prefixes, these 271 sets made 96,667 rows."""
    counts, meetings = [], similar._meetings

    def watched(*args):
        out = meetings(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(similar, "_meetings", watched)
    rows = far_copies(random.Random(9), 1, 300)
    similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(rows) == 271 and len(counts) == 2 and sum(counts) < 20_000
