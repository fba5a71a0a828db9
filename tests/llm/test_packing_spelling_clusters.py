"""Packing, spelling variants and centroid clustering against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jetloom.llm import centroids, packing, spelling

EXTRA = "length int, item int, cell int, word string, n int, node int, x int, cluster int, key string, bin int"
EXTRA_ROW = (1, 2, 3, "w", 4, 5, 6, 7, "k", 8)


# --- packing ------------------------------------------------------------------------------------


def reference_ids(text, plan):
    tokenizer = packing._load(plan.tokenizer)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [plan.end_id]


def check_packing(rows, packed, plan):
    """Every piece once with the right ids, sequences gapless and within capacity."""
    want = Counter()
    for doc_id, text in rows:
        ids = reference_ids(text, plan)
        for piece, start in enumerate(range(0, len(ids), plan.capacity)):
            run = np.array(ids[start : start + plan.capacity], "<u4")
            want[(doc_id, piece, start, len(run), zlib.crc32(run.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= plan.capacity
    return bins


@pytest.mark.parametrize("cell_items, fan", [(10_000, 8), (12, 2), (5, 3)])
def test_packing_against_plain_ids(spark, cell_items, fan):
    rng = random.Random(cell_items)
    words = ["Alpha", "beta", "gamma's", "dé", "12", "!?", "日本", "\n", "<|endoftext|>"]
    texts = [None, "", "  ", "one"] + [" ".join(rng.choices(words, k=int(rng.paretovariate(0.8)) % 400)) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, "no id"), (None, "no id")]
    plan = packing.PackingPlan(capacity=64, cell_items=cell_items, fan=fan, slack=0)
    table = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(5)
    bins = check_packing(rows, packing.pack(table, plan).collect(), plan)
    used = [sum(length for _, length in places) for places in bins.values()]
    assert sum(u <= plan.capacity // 2 for u in used) <= 1  # merged down to the last small bin
    one_cell, _, fills = packing.best_fit(sorted((n for p in bins.values() for _, n in p), reverse=True), plan.capacity)
    assert len(bins) <= len(fills) * 1.04 + 1


def test_words_of_the_documents_have_the_ids_of_the_texts(spark, sf_dir):
    tokenizer = packing._load(packing.PackingPlan().tokenizer)
    by_words = packing.WordIds(tokenizer)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text, whole in zip(texts, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(by_words.of(text or ""), "<u4").tolist() == whole.ids


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")).collect() == []


def test_long_text_in_parts_has_the_same_ids(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdéΣ日.'1", k=rng.randint(1, 9))) for _ in range(4000))
    plan = packing.PackingPlan()
    tokenizer = packing._load(plan.tokenizer)
    cuts = packing.parts(text, 700)
    assert len(cuts) > 20 and "".join(cuts) == text
    for held in (50, 200_000):
        by_words = packing.WordIds(tokenizer, held=held, longest=6)
        for sample in (text, text[:500], "", " ", "<|endoftext|>a \u0301b\u00a0c\td\x1fe\r\n 's I'LL \u2009x", "A" * 50):
            assert np.frombuffer(by_words.of(sample), "<u4").tolist() == tokenizer.encode(sample, add_special_tokens=False).ids
    assert packing.parts("a" * 2000, 700) == ["a" * 2000]
    long = packing.pack(spark.createDataFrame([(1, text * 40)], "doc_id long, text string"), plan).collect()
    check_packing([(1, text * 40)], long, plan)


def plain_best_fit(lengths, capacity):
    used = []
    for length in lengths:
        fits = [u for u in used if u + length <= capacity]
        if fits:
            used[used.index(max(fits))] += length
        else:
            used.append(length)
    return sorted(used)


@given(st.lists(st.integers(1, 30), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_best_fit(lengths):
    bins, offsets, used = packing.best_fit(lengths, 30)
    assert sorted(used) == plain_best_fit(lengths, 30)
    small = [u for u in used if u <= 15]
    assert len(small) <= 1 and all(a + b > 30 for k, a in enumerate(used) for b in used[:k])
    fills = Counter()
    for length, number, offset in zip(lengths, bins, offsets):
        assert offset == fills[number]
        fills[number] += length


def test_surplus_bins_change_no_merge():
    """A node that sees only what its children carry packs as one that sees all their bins."""
    rng = random.Random(5)
    for _ in range(50):
        fan, capacity = 3, 40
        children = [packing.best_fit(sorted(rng.choices([21, 25, 27, rng.randint(1, 12)], k=60), reverse=True), capacity)[2] for _ in range(fan)]
        kept = [[u for u, up in zip(c, packing.carried(c, capacity, 0, fan)) if up] for c in children]
        rest = [[u for u, up in zip(c, packing.carried(c, capacity, 0, fan)) if not up] for c in children]
        everything = packing.best_fit(sorted((u for c in children for u in c), reverse=True), capacity)[2]
        bounded = packing.best_fit(sorted((u for c in kept for u in c), reverse=True), capacity)[2]
        assert sorted(everything) == sorted(bounded + [u for c in rest for u in c])


# --- spelling variants --------------------------------------------------------------------------


def damaged_words(rows, plan):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(f"{plan.letters}+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if plan.damage:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % plan.damage == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= plan.least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= plan.least_count}


def one_edit_pairs(words):
    by_gap = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            by_gap[(k, w[:k], w[k + 1 :])].add(w)  # replaced at k
            by_gap[(-1, w, "")].add(w)
        for k in range(len(w)):
            by_gap[(-1, w[:k] + w[k + 1 :], "")].add(w)
    out = set()
    for (k, _, _), group in by_gap.items():
        for a in group:
            for b in group:
                if a != b and (abs(len(a) - len(b)) == 1 if k < 0 else len(a) == len(b)):
                    out.add((a, b))
    return {(a, b) for a, b in out if one_edit(a, b)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def expected_variants(rows, plan):
    counts = damaged_words(rows, plan)
    near = defaultdict(list)
    for a, b in one_edit_pairs(counts):
        near[a].append(b)
    form = {}
    for w in counts:
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= plan.ratio * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("damage, least_count, letters", [(0, 1, "ab"), (7, 2, "abÀ"), (3, 1, "aé")])
def test_variants_against_brute_force(spark, damage, least_count, letters):
    rng = random.Random(damage)
    rows = [(k, " ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(40))) for k in range(12)]
    rows += [(3, rows[3][1]), (None, "ababab " * 60 + "ABABAB Ababaa"), (9, None), (10, ""), (11, "1 2 ,")]
    plan = spelling.SpellingPlan(least_length=3, least_count=least_count, damage=damage)
    table = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    got = [tuple(r) for r in spelling.variants(table, plan).collect()]
    want = expected_variants(rows, plan)
    assert len(got) == len(want) and set(got) == want


def test_variants_of_the_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.variants(table, spelling.QUERY_PLAN).collect()}
    assert got == expected_variants(rows, spelling.QUERY_PLAN) and len(got) > 100


def test_crowded_nodes_may_be_joined_either_way(spark, monkeypatch):
    rng = random.Random(8)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(300)}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for share, limit in ((1e-3, 100_000), (0.2, 100_000), (1e-3, 0)):
        monkeypatch.setattr(spelling, "TOP_SHARE", share)
        monkeypatch.setattr(spelling, "TOP_EDGES", limit)
        got = {tuple(r) for r in spelling.near_pairs(table).collect()}
        assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_of_many_letters_and_nested_words(spark):
    """Labels hold runs of letters, so a word of 100,000 letters costs no more levels than its branches."""
    rng = random.Random(1)
    long = "".join(rng.choices("abcd", k=100_000))
    words = [long, long[:5] + "z" + long[6:], long + "z", long[:70_000] + long[70_001:], long[1:], "a" * 30, "a" * 31, "a" * 32, "a" * 33 + "b"]
    got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_variants_of_nothing(spark):
    schema = f"doc_id long, text string, {EXTRA}"
    assert spelling.variants(spark.createDataFrame([], schema)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, *EXTRA_ROW), (2, "a b", *EXTRA_ROW)], schema)).collect() == []


# --- centroids ----------------------------------------------------------------------------------


def expected_clusters(rows, plan):
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != plan.dims or any(v is None or not np.isfinite(v) for v in vector):
            continue
        x = [max(-plan.limit, min(plan.limit, int(np.floor(plan.scale * float(v))) if abs(v) < 1e300 else (1 if v > 0 else -1) * plan.limit)) for v in vector]
        kept.append((vec_id, x))
    key = lambda r: (hashlib.sha256(f"{plan.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [list(x) for _, x in sorted(kept, key=key)[: plan.clusters]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(plan.rounds):
        where = assign()
        for c in range(len(cents)):
            members = [x for (_, x), (w, _) in zip(kept, where) if w == c]
            if members:
                cents[c] = [sum(col) // len(members) for col in zip(*members)]
    where = assign()
    inertia = Counter()
    for c, d in where:
        inertia[c] += d
    total = sum(inertia.values())
    name = lambda c: hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return Counter((vec_id, c, d, inertia[c], total, name(c)) for (vec_id, _), (c, d) in zip(kept, where))


@pytest.mark.parametrize("count, spread", [(200, 2.0), (60, 0.01), (5, 1.0)])
def test_clusters_against_plain_distances(spark, count, spread):
    plan = centroids.CentroidPlan(clusters=7, dims=3, rounds=4)
    rng = np.random.default_rng(count)
    rows = [(k, [float(v) for v in rng.normal(0, spread, 3)]) for k in range(count)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, [0.5, 0.5, 0.5]), (None, [1e300, -1e300, 0.1])]
    rows += [(90, None), (91, []), (92, [1.0, 2.0]), (93, [1.0, None, 2.0]), (94, [float("nan"), 0.0, 0.0]), (95, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame([(*r, *EXTRA_ROW) for r in rows], f"vec_id long, embedding array<double>, {EXTRA}").repartition(4)
    got = Counter(tuple(r) for r in centroids.cluster(table, plan=plan).collect())
    assert got == expected_clusters(rows, plan)


def test_clusters_of_nothing(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.cluster(table).collect() == []
    assert centroids.cluster(table.filter("false")).collect() == []


@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 2), min_size=1, max_size=8), st.lists(st.tuples(*[st.integers(-4, 4)] * 2), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_bisector_tournament_keeps_the_smaller_number_on_ties(cents, points):
    cents, points = np.array(cents, np.int64), np.array(points, np.int64)
    gaps = ((points[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2)
    tests = centroids.Bisectors(cents)
    winner = tests.nearest(points)
    assert (winner == gaps.argmin(axis=1)).all()
    assert (tests.distances(points, winner) == gaps.min(axis=1)).all()
