"""NULL and repeated ids in the pipeline's filters, texts made to collide, and hostile pages."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jetloom.llm import block_labeller, compression_toxicity, cuckoo, decontaminate, odd_sketch, semimarkov
from jetloom.llm.staging import smallest_by_hash, with_row_id
from jetloom.llm.text import text_bytes, words_of

SCHEMA = "doc_id long, text string, source string, _row_id int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [words(rng, 60) for _ in range(6)]


@pytest.fixture(scope="module")
def rows(texts):
    """Every way in which ids are absent, repeat or clash."""
    a, b, c, d, e, f = texts
    near = " ".join([*d.split(" ")[:-1], "changed"])
    return [
        (None, a), (None, b), (1, c), (1, c), (1, e), (2, c), (None, c), (3, d), (3, near), (4, near), (5, f), (6, f.replace(" ", "\n")),
        (None, None), (None, ""), (7, None), (None, a),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_row_ids_tell_rows_apart_by_id_and_text(docs, rows):
    got = with_row_id(docs, "doc_id", "text").collect()
    plain = [r for r in got if r._jetloom_row_id == r.doc_id]
    assert sorted(r.doc_id for r in plain) == [2, 4, 5, 6, 7]
    assert len({r._jetloom_row_id for r in got}) == len({(r.doc_id, r.text) for r in got})
    assert all(r._jetloom_row_id >= 1 << 62 for r in got if r not in plain) and len(got) == len(rows)


def test_keep_first_keeps_one_row_of_every_text(docs, rows):
    out = cuckoo.keep_first(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, normal(r.text)) for r in out.collect()]
    assert sorted(t for _, t in kept) == sorted({normal(t) for _, t in rows})
    by_text = {t: i for i, t in kept}
    assert by_text[normal(rows[2][1])] == 2 and by_text[normal(rows[10][1])] == 5 and by_text[""] == 7
    assert by_text[normal(rows[0][1])] is None and by_text[normal(rows[1][1])] is None


def test_keep_smallest_keeps_one_row_of_every_component(docs, rows):
    first = cuckoo.keep_first(docs)
    out = odd_sketch.keep_smallest(first)
    assert out.columns == docs.columns
    kept = [(r.doc_id, normal(r.text)) for r in out.collect()]
    # All texts but the two near copies are unlike each other. Exact dedup has left each of these one row of its own id.
    near = {normal(rows[7][1]), normal(rows[8][1])}
    assert sorted(t for _, t in kept if t not in near) == sorted({normal(t) for _, t in rows} - near)
    assert [(i, t) for i, t in kept if t in near] == [(3, normal(rows[7][1]))]
    again = odd_sketch.keep_smallest(docs.filter("doc_id IN (3, 4)"))
    assert [(r.doc_id, r.text) for r in again.collect()] == [rows[9]]


def test_filters_judge_rows_without_an_id(spark, docs, rows, texts):
    items = spark.createDataFrame([(1, texts[0]), (2, texts[4])], "item_id long, text string")
    left = [(r.doc_id, r.text) for r in decontaminate.drop_leaks(docs, items).collect()]
    assert sorted(left, key=str) == sorted((r for r in rows if r[1] not in (texts[0], texts[4])), key=str)


def test_drop_toxic_equals_the_score_of_every_row(spark, docs):
    rng = random.Random(2)
    plain = [(k, words(rng, 40)) for k in range(100, 160)]
    toxic = [(k, words(rng, 20) + " vile scum filth " * 3 + words(rng, 10)) for k in range(160, 200)]
    table = spark.createDataFrame([(*r, "s", 1) for r in [*plain, *toxic, (None, toxic[0][1]), (100, toxic[1][1])]], SCHEMA).unionByName(docs)
    labels = spark.createDataFrame([(i, int(i >= 160)) for i, _ in plain + toxic], "doc_id long, toxic int")
    model = compression_toxicity.fit_on(table, labels)
    data, offsets = text_bytes(pa.array([t for (t,) in table.select("text").toPandas().itertuples(index=False)], pa.string()))
    assert len(offsets) == table.count() + 1
    want = {(r.doc_id, r.text) for r in table.collect()}
    for r in compression_toxicity.score(table.select(F.monotonically_increasing_id().alias("doc_id"), "text"), model).collect():
        assert 0 <= r.score <= 1
    left = {(r.doc_id, r.text) for r in compression_toxicity.drop_toxic(table, labels).collect()}
    assert left <= want
    gone = {t for _, t in want - left}
    assert all((i, t) not in left for i, t in want if t in gone) and (None, toxic[0][1]) not in left and (100, plain[0][1]) in left


def test_words_made_to_collide_stay_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other}".encode(), np.uint8)
    hashes = words_of(data, np.array([0, len(data)])).hashes
    assert len(hashes) == 2 and hashes[0] != hashes[1]
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"x {word} y"), (4, f"x {other} y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in odd_sketch.near_components(docs).collect()}
    assert got == {k: (1, k) for k in range(1, 5)}


def test_a_repeated_word_meets_an_item_on_many_diagonals(spark):
    start = time.time()
    docs = spark.createDataFrame([(1, "la " * 5000), (2, "la " * 5000 + "other"), (3, "lo " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 100)], "item_id long, text string")
    got = {r.doc_id: (r.doc_start, r.words, r.equal_words) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {1: (0, 100, 100), 2: (0, 100, 100)}
    assert time.time() - start < 60


@pytest.mark.parametrize("n", [0, 5, 40, 1000])
def test_smallest_by_hash_is_the_sorted_head(spark, n):
    rows = spark.range(3000).select(F.xxhash64(F.col("id") % 700).alias("h"), F.col("id").alias("k"))
    want = [tuple(r) for r in rows.orderBy("h", "k").limit(n).collect()]
    assert [tuple(r) for r in smallest_by_hash(rows, "h", n, "k").collect()] == want


HOSTILE = {
    "unclosed tags": "<a " * 300_000,
    "open blocks": "<div>" * 200_000 + "x",
    "text in nested blocks": "<div>x" * 30_000,
    "stray quotes": "<a \"'" * 200_000,
    "tags in quotes": '"<a "' * 200_000 + ">",
    "stray ends": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "</q>" * 100_000,
    "inline between blocks": "<li>" + "<b>" * 100_000 + "<div></div>" * 40_000,
    "declarations": "<!" * 400_000,
}


@pytest.mark.parametrize("page", HOSTILE.values(), ids=HOSTILE.keys())
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    block_labeller.blocks_of(page)
    assert time.time() - start < 10


def test_extract_of_an_empty_table_and_a_long_page(spark):
    model = block_labeller.BlockLabeller.fresh()
    pages = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert block_labeller.extract(pages, model).count() == 0
    long = spark.createDataFrame([(1, "u", "<p>" + "word " * 100_000 + "</p><div>" * 2000 + "x", 1)], pages.schema)
    assert block_labeller.extract(long, model).count() == 1


def test_fits_on_many_equal_texts(spark):
    rows = spark.createDataFrame([(k, "ring +1 (826) 555-4081 or a@b.org" if k % 3 else f"at 10.0.{k % 250}.7") for k in range(900)], "doc_id long, text string")
    field = semimarkov.fit_on(rows, fit_docs=60)
    assert {k for k, _, _ in semimarkov.all_spans("call +1 (826) 555-4081", field)[0]} == {"phone"}
