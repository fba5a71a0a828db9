"""Spelling variants: words one edit apart, found by a relational frontier over a trie of the vocabulary.

The trie is a table of edges ``(parent, label, child)``. A node is a prefix, known by its digest; only prefixes where words
part or end are nodes, so a label may hold many letters and even a word of a million letters has few nodes. The frontier
is a table of states ``(word, position, node, edits)``: ``position`` letters of the word have been read on the way to
``node``. States without an edit are the nodes on the word's own path, which building the trie yields. One level joins all
states with the edges of their nodes:

* a state without an edit takes its edit where the word first differs from a label: another letter, or a letter too many;
* a state with an edit follows the only label that begins with the word's next letter, if all of it matches.

States that have read their word to its end at a word's node, with one edit, are pairs. A pair is sought from one side only,
from the longer word or from the one with the smaller letter, and then turned round as well.

Near the root a node has many words and many edges. So words are read from both ends, in a trie of the words and in one of the
reversed words: a pair differs first in the second half of the word from one side or the other, so either trie seeks only the
edits behind the middle, where few words are left. Edges of nodes that still hold a thousandth of the vocabulary are
broadcast if they are few enough and joined by shuffle otherwise; all other nodes are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, staged

ROOT = hashlib.sha256(b"").digest()[:16]
#: A node is near the root if it lies above this share of the vocabulary.
TOP_SHARE = 1e-3
#: Most edges and label characters of such nodes that are broadcast.
TOP_EDGES = 100_000
TOP_CHARS = 4_000_000
#: Prefixes in one Arrow batch.
BATCH = 50_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Letters of a text whose runs are listed at once; those of a longer one are counted as they are found.
LISTED = 1 << 22


@dataclass(frozen=True)
class SpellingPlan:
    """``letters`` is a character class; a word needs ``least_length`` code points and ``least_count`` occurrences.

    A near word is a form of a word if it occurs at least ``ratio`` times as often. ``damage`` deletes one code point of
    every run whose checksum it divides; 0 leaves the runs as they are.
    """

    letters: str = "[A-Za-zÀ-ÿ]"
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    damage: int = 0


QUERY_PLAN = SpellingPlan(damage=199)


def _word_counts(plan: SpellingPlan):
    """Words of a batch of texts with their counts, summed as far as ``COUNTED`` distinct words go."""
    # A run shorter than a word cannot become one: at most a letter is deleted.
    runs = re.compile(f"{plan.letters}{{{plan.least_length},}}")

    def run(batches):
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if not text:
                    continue
                # Lowering bytes touches A to Z only.
                lowered = text.encode().lower().decode()
                found = Counter(runs.findall(lowered) if len(lowered) <= LISTED else (match[0] for match in runs.finditer(lowered)))
                if plan.damage:
                    doc = ids[row].as_py()
                    start = zlib.crc32(b":" if doc is None else f"{doc}:".encode())
                    for word in [w for w in found if zlib.crc32(w.encode(), start) % plan.damage == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        if len(word) > plan.least_length:
                            counts[word[:at] + word[at + 1 :]] += found[word]
                        del found[word]
                counts.update(found)
                if len(counts) >= COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return run


def vocabulary(docs: DataFrame, plan: SpellingPlan) -> DataFrame:
    """``(word, n)``: runs of letters with ASCII capitals lowered, counted over whole texts; tasks sum up before the shuffle."""
    parts = narrow(docs, doc_id="doc_id", text="text").mapInArrow(_word_counts(plan), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= plan.least_count)


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every non-empty prefix of every word: digest, length and the code point that follows (-1 at the end)."""
    keys, prefixes, depths, nexts = [], [], [], []

    def flush():
        columns = [pa.array(keys, pa.binary()), pa.array(prefixes, pa.binary()), pa.array(depths, pa.int32()), pa.array(nexts, pa.int32())]
        for held in (keys, prefixes, depths, nexts):
            held.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "prefix", "depth", "next"])

    for batch in batches:
        for key, word in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist()):
            running = hashlib.sha256()
            for depth, letter in enumerate(word, 1):
                running.update(letter.encode())
                keys.append(key)
                prefixes.append(running.copy().digest()[:16])
                depths.append(depth)
                nexts.append(ord(word[depth]) if depth < len(word) else -1)
                if len(keys) >= BATCH:
                    yield flush()
    if keys:
        yield flush()


def trie_paths(words: DataFrame, size: int) -> DataFrame:
    """Nodes on the path of every word of ``words(key, word)``: ``key, child, depth, parent, from, above, below, ends, chosen``.

    ``above`` and ``below`` count the words under the parent and the child, ``ends`` says that a word ends at the child, and
    ``chosen`` marks one word per child, which labels its edge.
    """
    rows = staged(words.select("key", "word").mapInArrow(_prefixes, "key binary, prefix binary, depth int, next int"), "prefixes")
    ticket = F.xxhash64("key")
    nodes = (
        rows.groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("below"), F.min("next").alias("low"), F.max("next").alias("high"), F.min(ticket).alias("ticket"))
        .filter((F.col("low") == -1) | (F.col("low") != F.col("high")))
    )
    path = W.partitionBy("key").orderBy("depth")
    return (
        rows.select("key", "prefix", "depth").join(nodes, "prefix")
        .select(
            "key", "depth", "below", F.col("prefix").alias("child"), (F.col("low") == -1).alias("ends"), (ticket == F.col("ticket")).alias("chosen"),
            F.lag("prefix", 1, None).over(path).alias("parent"), F.lag("depth", 1, 0).over(path).alias("from"),
            F.lag("below", 1, size).over(path).alias("above"),
        )
        .withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    )


def trie_edges(paths: DataFrame) -> DataFrame:
    """Edge table ``parent, child, label, first, ending, above, below, leaf`` of the paths with their ``word``.

    ``ending`` is the word that ends at the child, or NULL; below a leaf there is nothing more.
    """
    label = F.substr("word", F.col("from") + 1, F.col("depth") - F.col("from"))
    return paths.filter("chosen").select(
        "parent", "child", label.alias("label"), F.substr(label, F.lit(1), F.lit(1)).alias("first"),
        F.when(F.col("ends"), F.substr("word", F.lit(1), F.col("depth"))).alias("ending"),
        "above", "below", (F.col("ends") & (F.col("below") == 1)).alias("leaf"),
    )


def _shared(a: Column, b: Column, size: Column) -> Column:
    """How many letters the first ``size`` letters of ``a`` and ``b`` share at the start: a binary search on equal runs."""

    def longer(known: Column, step: Column) -> Column:
        same = F.substr(a, known + 1, step) == F.substr(b, known + 1, step)
        return F.when((known + step <= size) & same, known + step).otherwise(known)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), longer)


def _edited(met: DataFrame) -> DataFrame:
    """States without an edit, joined with edges, past the first difference: adds their ``position`` at the child."""
    at, label, width, size = F.col("position"), F.col("label"), F.char_length("label"), F.char_length("word")
    left = size - at
    next_ = F.substr("word", at + 1, F.lit(1))
    inside = _shared(F.substr("word", at + 1, width), label, F.least(width, left))
    met = met.withColumn("p", F.when(next_ != F.col("first"), F.lit(0)).when(width == 1, F.lit(1)).otherwise(inside))
    # The word itself goes on along the whole label, or ends on it: no difference here.
    met = met.filter((F.col("p") < F.least(width, left)) & (at + F.col("p") >= F.col("middle")))
    p = F.col("p")
    letter, other = F.substr("word", at + p + 1, F.lit(1)), F.substr(label, p + 1, F.lit(1))
    replaced = (letter < other) & (left >= width) & (F.substr("word", at + p + 2, width - p - 1) == F.substr(label, p + 2, width))
    surplus = (left > width) & (F.substr("word", at + p + 2, width - p) == F.substr(label, p + 1, width))
    ends = F.filter(
        F.array(F.when(replaced, (at + width).cast("int")), F.when(surplus, (at + width + 1).cast("int"))), lambda e: e.isNotNull()
    )
    return met.withColumn("position", F.explode(ends))


def _followed(met: DataFrame) -> DataFrame:
    """States with an edit, joined with the edge of their next letter, at the child if the label matches."""
    at, width = F.col("position"), F.char_length("label")
    return met.filter(F.substr("word", at + 1, width) == F.col("label")).withColumn("position", (at + width).cast("int"))


def _arrived(met: DataFrame, share: float) -> DataFrame:
    """What is left of states that reached a child: pairs, and states that can go on."""
    size = F.char_length("word")
    pair = F.col("ending").isNotNull() & (F.col("position") == size)
    return met.select(
        "word", "position", F.col("child").alias("node"), F.when(pair, F.col("ending")).alias("near"),
        (~F.col("leaf") & (F.col("position") < size)).alias("on"), (F.col("below") >= share).alias("crowded"),
    ).filter(F.col("on") | F.col("near").isNotNull())


def _pairs_behind_the_middle(words: DataFrame, size: int, backwards: bool) -> DataFrame:
    """Pairs ``(word, near)`` whose first difference, from the longer word or the smaller letter, lies behind the middle."""
    half = F.floor(F.char_length("word") / 2).cast("int")
    if backwards:
        words, half = words.withColumn("word", F.reverse("word")), F.char_length("word") - half
    words = words.select("word", _digest(F.col("word")).alias("key"))
    paths = staged(trie_paths(words, size).join(words, "key"), "paths")
    edges = staged(trie_edges(paths), "edges")
    share = size * TOP_SHARE
    upper = edges.filter(F.col("above") >= share)
    chars = F.sum(F.char_length("label") + F.coalesce(F.char_length("ending"), F.lit(0)))
    count, chars = upper.agg(F.count(F.lit(1)), F.coalesce(chars, F.lit(0))).first()
    split = count <= TOP_EDGES and chars <= TOP_CHARS
    pools = [(F.col("crowded"), F.broadcast(upper)), (~F.col("crowded"), edges.filter(F.col("above") < share))] if split else [(F.lit(True), edges)]

    # A path's row names the edge into its child: the word meets other edges at the parent, behind the middle only if the child is.
    own = paths.filter(F.col("depth") > half).select(
        "word", F.col("from").alias("position"), F.col("parent").alias("node"), half.alias("middle"), (F.col("above") >= share).alias("crowded")
    )
    shorter = paths.filter(F.col("ends") & (F.col("depth") == F.char_length("word") - 1))
    found = [shorter.select("word", F.substr("word", F.lit(1), F.col("depth")).alias("near"))]
    steps = [_edited(own.filter(here).drop("crowded").join(pool, F.col("node") == F.col("parent"))) for here, pool in pools]
    while True:
        level = _arrived(steps[0], share)
        for step in steps[1:]:
            level = level.unionByName(_arrived(step, share))
        level = staged(level, "frontier")
        found.append(level.filter(F.col("near").isNotNull()).select("word", "near"))
        states = level.filter("on")
        if states.limit(1).count() == 0:
            break
        states = states.select("word", "position", "node", "crowded", F.substr("word", F.col("position") + 1, F.lit(1)).alias("head"))
        met = (F.col("node") == F.col("parent")) & (F.col("head") == F.col("first"))
        steps = [_followed(states.filter(here).drop("crowded").join(pool, met)) for here, pool in pools]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.select(F.reverse("word").alias("word"), F.reverse("near").alias("near")) if backwards else pairs


def near_pairs(words: DataFrame) -> DataFrame:
    """Ordered pairs ``(word, near)`` of the distinct ``words(word)`` that are exactly one edit apart."""
    words = words.select("word")
    size = words.count()
    pairs = _pairs_behind_the_middle(words, size, False).union(_pairs_behind_the_middle(words, size, True))
    return pairs.union(pairs.select("near", "word")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the table ``(word, form)`` without NULLs: the last word of the chain of forms.

    A form occurs more often than its word, so chains have no circle; every round doubles the steps taken.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = staged(links.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if links.filter("moved").limit(1).count() == 0:
            return links.select("word", "root")
        links = links.select("word", "root")


def variants(docs: DataFrame, plan: SpellingPlan = SpellingPlan()) -> DataFrame:
    """Words of all texts with their near words: ``word, form, root, n, n_near, form_n``.

    Texts that are NULL, empty or without words add nothing; equal rows count each; a NULL ``doc_id`` is an empty one;
    other columns are ignored; without words the result is empty. Of near words with equal counts the first in code
    point order is the form.
    """
    words = staged(vocabulary(docs, plan), "vocabulary")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        near_pairs(words).join(counts, "near")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    )
    strong = -F.col("best.order") >= plan.ratio * F.col("n")
    table = staged(
        words.join(best, "word", "left").select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.order")).alias("form_n"),
        ),
        "variants",
    )
    last = roots(table.filter(F.col("form").isNotNull()))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
