"""Corpus operators against brute force, and on awkward tables."""

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

from jetloom.llm import block_labeller, compression_toxicity, cuckoo, decontaminate, factorization, lyndon, mixing, odd_sketch, repeats, semimarkov, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, id long, layout int, digest string, size int, key string, word string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """NULLs, empty, blank, short, long, repeated and nearly equal texts; extra columns whose names the operators use themselves."""
    rng = random.Random(4)
    texts = [None, "", "  \t", "a b", "A  b", words(rng, 3000)]
    passage = words(rng, 120)
    for k in range(12):
        base = words(rng, 80)
        texts += [base, base, base.replace(" ", "\n", 3), base.upper()]
        near = base.split(" ")
        near[rng.randrange(80)] = "zzz"
        texts += [" ".join(near), words(rng, 30) + " " + passage + " " + words(rng, 20)]
    out = [(k, t, ["x", "y", None, "ä"][k % 4], 7, 1, "d", 5, "k", "w") for k, t in enumerate(texts)]
    return out + [out[6], out[0]] + [(None, "no id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    got = cuckoo.exact_groups(docs).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        known = [i for i in by_hash[r.text_sha256] if i is not None]
        assert r.group_size == len(by_hash[r.text_sha256])
        assert r.keep_id == (min(known) if known else None) and r.kept == (r.doc_id is not None and r.doc_id == min(known))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=400))
def test_cuckoo_index_like_a_dictionary(moves):
    index, model = cuckoo.CuckooIndex(4), Counter()
    for add, k in moves:
        digest = hashlib.sha256(str(k).encode()).digest()
        if add or not model[k]:
            index.add(digest, k, 1)
            model[k] += 1
        else:
            assert index.remove(digest, 1) == (model[k] == 1)
            model[k] -= 1
    assert sorted((s, c) for _, s, c in index.entries()) == sorted((k, n) for k, n in model.items() if n)


def test_cuckoo_index_grows():
    index = cuckoo.CuckooIndex(4)
    for k in range(3000):
        index.add(hashlib.sha256(str(k).encode()).digest(), k, 1)
    assert index.resizes > 0 and index.size == 3000
    assert all(index.get(hashlib.sha256(str(k).encode()).digest()) == [k, 1] for k in range(3000))


def test_index_update(spark):
    d = [hashlib.sha256(bytes([k])).digest() for k in range(3)]
    index = cuckoo.build_index(spark.createDataFrame([(d[0], 5), (d[0], 3), (d[1], 9)], "digest binary, doc_id long"), 2)
    added = spark.createDataFrame([(d[2], 1), (d[1], 4)], "digest binary, doc_id long")
    removed = spark.createDataFrame([(d[0], 2), (d[1], 1)], "digest binary, copies long")
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in cuckoo.update_index(index, added, removed, 2).collect()}
    assert got == {d[1]: (4, 1), d[2]: (1, 1)}


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(lower)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def near_truth(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_components(docs, rows):
    truth = near_truth({r[0]: r[1] for r in rows if r[0] is not None})
    got = odd_sketch.near_components(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == truth[r.doc_id] for r in got if r.doc_id is not None)


def test_near_components_of_a_torn_bucket(spark, monkeypatch):
    """Many variants of one text around the threshold: links that no pivot has, blocks of two members."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 2)
    rng = random.Random(1)
    base = words(rng, 150).split(" ")
    texts = {}
    for k in range(40):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(150)] = f"q{rng.randrange(30)}"
        texts[k] = " ".join(own)
    got = odd_sketch.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == near_truth(texts)


def test_pipeline_drops_near_copies_at_80_percent(spark):
    """Pairs between 0.80 and 0.85 go, the nearest pair below 0.80 stays."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for changed in (14, 15, 16, 17, 18, 19):
        base = words(rng, 164).split(" ")
        # A changed word at the end takes one shingle each: 160 - n of 160 + n are shared.
        near = base[: 164 - changed] + [f"q{k}" for k in range(changed)]
        texts += [" ".join(base), " ".join(near)]
    sets = [shingle_set(t) for t in texts]
    truth = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert not any(100 * len(a & b) >= 85 * len(a | b) for a, b in zip(sets[::2], sets[1::2])) and truth.count(False) == 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {2 * k for k in range(6)} | {2 * k + 1 for k in range(6) if not truth[k]}


def test_band_miss_rate():
    """A pair at exactly 0.8 is missed no more often than one at 0.85 was by 32 bands of 6."""
    assert (1 - 0.8**odd_sketch.ROWS) ** odd_sketch.BANDS <= (1 - 0.85**6) ** 32
    assert all(odd_sketch.SAMPLES % bins == 0 for _, bins in odd_sketch.CLASSES)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    table = np.stack([odd_sketch.minhash(np.sort(np.concatenate((common, x))), 4) for x in (a, b)])
    sketch = odd_sketch.odd_sketch(table)
    assert abs(odd_sketch.estimated_similarity(sketch[0], sketch[1]) - 0.9) < 0.08


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    order = lyndon.suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    lcp = lyndon.common_prefixes(symbols, order)
    for k in range(1, len(order)):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == same


def removed_truth(rows, length):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for r, raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((-1 if r[0] is None else r[0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "members"), [(400, 2000), (60, 2000), (60, 2)])
def test_repeats(docs, rows, length, members, monkeypatch):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    got = repeats.repeats(docs, repeats.RepeatPlan(length)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == removed_truth(rows, length)


def test_repeats_inside_one_periodic_text(spark):
    rows = [(1, "abcdefg " * 100), (2, "x" * 399), (3, "x" * 400), (4, "y" * 401)]
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == removed_truth(rows, 400)


def test_leaks(spark):
    rng = random.Random(3)
    items = [(k, words(rng, n)) for k, n in enumerate([40, 30, 20, 5, 3])] + [(9, None), (10, ""), (None, "x y z")]
    changed = items[0][1].split(" ")
    changed[6] = changed[15] = changed[26] = "other"
    texts = [
        (0, words(rng, 50) + " " + items[0][1] + " " + words(rng, 9)), (1, "x " + " ".join(changed)), (2, items[1][1].upper().replace(" ", ", ")),
        (3, words(rng, 100)), (4, " ".join(items[2][1].split(" ")[:9]) + " " + words(rng, 20)), (5, "so " + items[3][1] + " so"), (6, "so " + items[4][1] + " so"),
        (7, None), (8, ""),
    ]
    docs = spark.createDataFrame([(*t, 1, "s") for t in texts], "doc_id long, text string, item_id long, seed string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.words, r.equal_words) for r in got} == {(0, 0): (40, 40), (1, 0): (40, 37), (2, 1): (30, 30), (5, 3): (5, 5), (6, 4): (3, 3)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == [3, 4, 7, 8]


def test_seed_masks_hit_every_accepted_overlap():
    """Enumeration of the substitution patterns that escape all masks: none of them is an overlap by the rule.

    31 tokens suffice: of a longer overlap one half has share 0.8 and, with 16 tokens or more, 13 equal ones.
    """
    plan = decontaminate.LeakPlan()
    ones = [(len(m), int(m, 2)) for m in plan.masks]

    def escaping(history, n, equal):
        """Unhit patterns that begin with the given one; the last token is the lowest bit."""
        if any(n >= size and history & mask == mask for size, mask in ones):
            return
        if equal >= plan.least_words and equal >= plan.share * n:
            yield format(history, f"0{n}b")
        if n < 31:
            yield from escaping(history << 1 | 1, n + 1, equal + 1)
            if n + 1 - equal <= 31 // 5:
                yield from escaping(history << 1, n + 1, equal)

    assert list(escaping(1, 1, 1)) == []


def test_leaks_with_spread_substitutions(spark):
    """Every 5th token of a long passage, the 6th and 11th of a short one; an item between a seed and the least overlap."""
    rng = random.Random(5)
    items = [(0, words(rng, 59)), (1, words(rng, 15)), (2, words(rng, 12))]
    texts = []
    for item, places in zip(items, (range(4, 59, 5), (5, 10), ()), strict=True):
        own = item[1].split(" ")
        for at in places:
            own[at] = f"q{at}"
        texts.append((item[0], words(rng, 20) + " " + " ".join(own) + " " + words(rng, 20)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.equal_words for r in got} == {(0, 0): 48, (1, 1): 13, (2, 2): 12}


def overlap_truth(equal, least, num, den):
    """The best of all runs: most equal tokens, then shortest, then first."""
    runs = [(-sum(equal[i:j]), j - i, i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)]
    best = min((r for r in runs if -r[0] >= least and -r[0] * den >= num * r[1]), default=None)
    return best and (best[2], best[2] + best[1], -best[0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([True, True, True, False]), min_size=1, max_size=70), st.integers(-3, 3), st.sampled_from([4, 13]))
def test_overlap_like_all_runs(equal, shift, least):
    item = np.arange(1, len(equal) + 1, dtype=np.uint64)
    doc = np.where(equal, item, 0).astype(np.uint64)
    if shift > 0:
        doc = np.concatenate((np.zeros(shift, np.uint64), doc))
    else:
        item, doc, equal = item, doc[-shift:], [False] * min(-shift, len(equal)) + equal[-shift:]
    truth = overlap_truth(equal, min(least, len(item)), 4, 5)
    assert decontaminate.overlap(doc, item, shift, decontaminate.LeakPlan(least_words=least)) == truth


def test_overlap_before_weak_matches():
    """20 equal tokens, then 42 in which every third differs: the whole scores higher and fails the share."""
    item = np.arange(1, 63, dtype=np.uint64)
    doc = item.copy()
    doc[22::3] = 0
    assert decontaminate.overlap(doc, item, 0, decontaminate.LeakPlan()) == overlap_truth((doc == item).tolist(), 13, 4, 5)
    assert decontaminate.overlap(doc, item, 0, decontaminate.LeakPlan()) is not None


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        open_ = [s for s in order if s not in full]
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    target |= {s: 3 * size[s] for s in full}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    for s in order:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, chance, coin = rng.integers(1, 900, 5000), np.full(5000, 0.37), rng.random(5000)
    after = mixing.fly(size, mixing.fly_long(size, chance, coin, 50), coin)
    assert after.sum() == pytest.approx(chance.sum()) and (after * size).sum() == pytest.approx((chance * size).sum())
    assert ((after > 1e-9) & (after < 1 - 1e-9)).sum() <= 2


def labelled(spark, rng, n=900):
    rows, labels = [], []
    for k in range(n):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        own = [rng.choice(["the", "of", "river", "stone", "walk", "house", "light", "green", "paper", "song"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 120))]
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["idiotic", "moronish", "scumbag"])
        text = " ".join(own)
        rows.append((k, text.upper().replace(" ", "!! ") if poor else text, "s"))
        labels.append((k, int(not poor), int(toxic)))
    return spark.createDataFrame([*rows, (n, None, "s"), (n + 1, "", "s")], "doc_id long, text string, score string"), spark.createDataFrame(
        [*labels, (5, None, None)], "doc_id long, quality int, toxic int"
    )


@pytest.mark.parametrize("module,parts,part,label", [(compression_toxicity, 4, 2, "toxic"), (factorization, 5, 0, "quality")])
def test_classifiers_on_held_out_rows(spark, module, parts, part, label):
    docs, labels = labelled(spark, random.Random(8))
    got = {r.doc_id: r for r in module.score(docs, module.fit_on(docs, labels)).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    unseen = [k for k in truth if zlib.crc32(str(k).encode()) % parts == part]
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[k].predicted == truth[k] for k in unseen]) > 0.95


def test_factor_sum_of_squares_is_the_pair_sum():
    x = factorization.Sparse(np.array([0, 3, 5]), np.array([1.0, 2.0, -1.0]), np.array([0, 3]))
    rng = np.random.default_rng(0)
    model = factorization.FactorizationMachine(0.5, rng.normal(size=6), rng.normal(size=(6, 4)), 0, 0.3)
    pairs = sum(model.factor[a] @ model.factor[b] * va * vb for (a, va), (b, vb) in [((0, 1), (3, 2)), ((0, 1), (5, -1)), ((3, 2), (5, -1))])
    assert model.margin(x)[0][0] == pytest.approx(0.5 + model.weight[[0, 3, 5]] @ x.value + pairs)


def test_block_lstm_gradient():
    model = block_labeller.BlockLabeller.fresh(1)
    rng = np.random.default_rng(0)
    x, mask = block_labeller.padded([rng.normal(size=(n, block_labeller.INPUT)) for n in (4, 2)])
    y = (rng.random(mask.shape) > 0.5).astype(float)

    def loss():
        p = model.chances(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for name, g in model.gradients(x, mask, y).items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        value = model.parameters[name]
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)
        value[at] += 1e-5


def test_extract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = block_labeller.fit_on(pages, plan=block_labeller.LabellerPlan(fit_pages=40))
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p>never closed <b>x"), (-4, None, "<div class='a>b' <")], "page_id long, url string, html string")
    got = {r.page_id: r for r in block_labeller.extract(pages.unionByName(odd).withColumn("text", F.lit(1)), model).collect()}
    assert got[-1].text == got[-2].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    right = 0
    for r in pages.collect():
        article = "\n".join(b.text for b in block_labeller.blocks_of(r.html) if any(p.split(" ")[0] == "article" for p in b.path))
        right += got[r.page_id].text == article
    assert right >= 0.95 * pages.count()


def test_blocks():
    got = block_labeller.blocks_of("<body><p>a&amp;b<br> c<p>d <b>e</b>\n f<script>x('</p>')</script><!-- y --><ul><li>g<li>h</ul>")
    assert [(b.text, b.path[-1]) for b in got] == [("a&b c", "p"), ("d e f", "p"), ("g", "li"), ("h", "li")]


def test_personal_data(spark):
    rows = [
        (1, "mail a.b@c-d.org, x@y or 1.2.3.4 and 300.1.1.1"), (2, "card 4111 1111 1111 1111 or 4111111111111112 +1 (017) 555-7713."), (3, None), (4, ""),
        (5, "é +1 (826) 555-4081 190.137.2.9"), (6, "Version 2.0 of 4.0."),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    field = semimarkov.fit([f"ring +1 ({a}) 555-{1000 + a} or a{a}@mail.org at 10.0.{a % 250}.7, key 9a{a}b7, v {a}.0." for a in range(100, 160)])
    got = {r.doc_id: r for r in semimarkov.find(docs, field).collect()}
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for _, r in sorted(got.items())] == [(1, 1, 0, 0), (0, 0, 1, 1), (0,) * 4, (0,) * 4, (0, 1, 0, 0), (0,) * 4]
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:16,ip:25:32").hexdigest() and got[3].spans == "" == got[6].spans
    assert "phone:2:19" in got[5].spans and "ip:20:31" in got[5].spans


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x &amp; y</p><script>z</script>", 1), (2, None, None, 2), (1, "http://a", "", 3)], "page_id long, url string, html string, block int")
    made = warc.derive(warc.responses(pages))
    warc.write_records(made, str(tmp_path / "w"))
    want = sorted((r.record_id, r.refers_to, r.block) for r in made.collect())
    got = sorted((r.headers["WARC-Record-ID"], r.headers["WARC-Refers-To"], r.block) for r in warc.read_records(spark, str(tmp_path / "w")).collect())
    assert got == want and [b for _, _, b in want if b == "x & y"] == ["x & y"]


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        cuckoo.exact_groups(nothing), odd_sketch.near_components(nothing), repeats.repeats(nothing), mixing.mix(nothing), decontaminate.leaks(nothing, items),
        compression_toxicity.score(nothing, compression_toxicity.fit_on(nothing, labels)), factorization.score(nothing, factorization.fit_on(nothing, labels)),
        semimarkov.find(nothing, semimarkov.fit_on(nothing)), warc.derive(warc.responses(pages)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
