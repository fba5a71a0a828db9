"""Hierarchical residual packing of tokenised documents into sequences of a fixed number of tokens.

Documents become token ids, longer ones are cut, and every piece shorter than a sequence is an item. Items are dealt to
cells of bounded size by a hash of their number; a cell packs its items best-fit in descending order. Bins that are
nearly full are finished. The others become items of the next round, where ``fan`` neighbouring cells merge, until one
cell is left: a tree with a best-fit round at every node.

What a cell hands up is bounded without changing any result. Best fit leaves no two bins that fit together, hence at
most one bin of at most half a sequence per cell; all other bins can only take in such small ones. A node meets at most
``fan`` small bins, one from each child, so of the bins of one fill it can use ``fan`` at most: further ones are
finished where they are. A node therefore reads at most ``fan * (fan * capacity / 2 + 1)`` rows at any input size.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, staged

#: Longer texts are tokenised in parts of so many characters, cut at spaces.
CHUNK_CHARS = 1 << 19


@dataclass(frozen=True)
class PackingPlan:
    """``tokenizer`` is a file of the ``tokenizers`` library: a path, or the name of a public vocabulary file.

    With ``by_words`` it must drop white space, lower-case and part letters from other characters, as the default one does;
    any other is given whole texts.
    """

    tokenizer: str = "word_bpe_49k.json"
    capacity: int = 2048
    end_id: int = 0
    cell_items: int = 16_384
    fan: int = 8
    slack: int = 4
    by_words: bool = True


def _load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def parts(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """A text in parts of about ``size`` characters that end at a space; the tokenizer's words never hold one."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.rfind(" ", start, start + size)
        if cut <= start:
            cut = text.find(" ", start + size)
            if cut < 0:
                break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


#: Chunks between white space that part into letters and other characters without a loss: ASCII but the apostrophe, and the
#: letters of U+00C0 to U+00FF.
_PLAIN = re.compile("[\x21-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]*")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")


_DIGIT = re.compile("[0-9]")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible ones for themselves, the rest from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: 0x100 + k for k, byte in enumerate(b for b in range(256) if b not in visible)}


_BYTES = _byte_letters()


class WordIds:
    """Ids of texts by way of their words: what the tokenizer makes of a word does not depend on its neighbours.

    White space is dropped and parts words for the tokenizer, so the ids of a text are those of its words one after the
    other; so it is with the runs of lower-cased letters and of other characters in a plain word. Ids of words and runs met
    before are kept until there are ``held`` of them; longer ones than ``longest`` are not kept.
    """

    def __init__(self, tokenizer, held: int = 300_000, longest: int = 64):
        self.tokenizer, self.held, self.longest = tokenizer, held, longest
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _keep(self, table: dict[str, bytes], text: str, ids: bytes) -> bytes:
        if len(text) <= self.longest:
            if len(table) >= self.held:
                table.clear()
            table[text] = ids
        return ids

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            if _DIGIT.search(run) is None:  # a word of its own for the model, which reads bytes as letters
                as_bytes = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
                found = [token.id for token in self.tokenizer.model.tokenize(as_bytes)]
            else:
                found = self.tokenizer.encode(run, add_special_tokens=False).ids
            ids = self._keep(self.runs, run, struct.pack(f"<{len(found)}I", *found))
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():
                ids = self._run(word.lower())
            elif _PLAIN.fullmatch(word) and "<|" not in word:
                ids = b"".join(map(self._run, _RUNS.findall(word.lower())))
            else:
                found = self.tokenizer.encode(word, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
            self._keep(self.known, word, ids)
        return ids

    def of(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in parts(text):
            words = part.replace("\n", " ").replace("\t", " ").split(" ")
            found = list(map(self.known.get, words))
            if None in found:
                found = [self._word(word) if ids is None else ids for word, ids in zip(words, found)]
            out.append(b"".join(found))
        return b"".join(out)


def _pieces(plan: PackingPlan, schema: pa.Schema):
    width, end = 4 * plan.capacity, np.array([plan.end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = _load(plan.tokenizer)
        ids_of = WordIds(tokenizer).of if plan.by_words else lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for batch in batches:
            keys, column = batch.column("doc_id"), batch.column("text")
            key_at, piece, start, length, crc = [], [], [], [], []
            for at in range(batch.num_rows):
                ids = ids_of(column[at].as_py() or "") + end
                for number, begin in enumerate(range(0, len(ids), width)):
                    run_ = ids[begin : begin + width]
                    key_at.append(at)
                    piece.append(number)
                    start.append(begin // 4)
                    length.append(len(run_) // 4)
                    crc.append(zlib.crc32(run_))
            columns = [keys.take(pa.array(key_at, pa.int64()))]
            columns += [pa.array(values, field.type) for values, field in zip((piece, start, length, crc), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def cut_pieces(docs: DataFrame, plan: PackingPlan) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of every document in pieces of at most ``capacity``."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = narrow(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType
    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return rows.mapInArrow(_pieces(plan, arrow), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every item in the order given, and the fill of every bin.

    An item goes to the fullest bin that has room, or opens one. Bins are kept by free space and a bit mask names the
    spaces in use, so an item costs a few operations on the mask.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    bins, offsets, used = [], [], []
    for length in lengths:
        room = spaces >> length
        if room:
            space = length + (room & -room).bit_length() - 1
            number = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, number = capacity, len(used)
            used.append(0)
        bins.append(number)
        offsets.append(used[number])
        used[number] += length
        space -= length
        if space:
            by_space[space].append(number)
            spaces |= 1 << space
    return bins, offsets, used


def carried(used: list[int], capacity: int, slack: int, fan: int) -> list[bool]:
    """Which bins a node above can still use: not nearly full, and at most ``fan`` of one fill."""
    seen: Counter[int] = Counter()
    out = []
    for fill in used:
        seen[fill] += 1
        out.append(capacity - fill > slack and seen[fill] <= fan)
    return out


def _round(plan: PackingPlan, last: bool):
    """A best-fit round of one cell: adds ``bin`` (the item at offset 0), ``offset``, ``used`` and ``open``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending")])
        bins, offsets, used = best_fit(table["length"].to_pylist(), plan.capacity)
        up = [False] * len(used) if last else carried(used, plan.capacity, plan.slack, plan.fan)
        at = np.array(bins, np.int64)
        offset = np.array(offsets, np.int64)
        base = np.empty(len(used), np.int64)
        first = offset == 0
        base[at[first]] = table["item"].to_numpy()[first]
        for name, column in (("bin", base[at]), ("offset", offset), ("used", np.array(used, np.int64)[at]), ("open", np.array(up, bool)[at])):
            table = table.append_column(name, pa.array(column))
        return table

    return run


def _packed_round(items: DataFrame, plan: PackingPlan, last: bool) -> DataFrame:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return items.groupBy("cell").applyInArrow(_round(plan, last), f"{columns}, bin long, offset long, used long, open boolean")


def pack(docs: DataFrame, plan: PackingPlan = PackingPlan()) -> DataFrame:
    """Places of all pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A NULL or empty text is one piece that holds only the closing id. NULL and repeated ids are documents like any
    other; other columns are ignored; an empty table gives an empty result. Sequence numbers are unique but have no
    order; they follow the numbering of the written pieces, so another partitioning of the input gives other ones.
    """
    cut = staged(cut_pieces(docs, plan).withColumn("item", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == plan.capacity
    items = cut.filter(~whole)
    cells = max(1, -(-items.count() // plan.cell_items))
    first = staged(
        _packed_round(items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells))), plan, cells == 1), "packed"
    )
    level, moves = first, []
    while cells > 1:
        cells = -(-cells // plan.fan)
        up = level.filter(F.col("open") & (F.col("offset") == 0)).select(
            F.col("bin").alias("item"), F.col("used").alias("length"), F.expr(f"cell div {plan.fan}").alias("cell")
        )
        level = staged(_packed_round(up, plan, cells == 1), "merged")
        moves.append(level.filter(F.col("offset") > 0).select("item", "bin", "offset"))

    placed = first.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset")
    if moves:
        # A cell moves one small bin at most. From the root down, where a bin went in the end.
        target = moves[-1]
        for move in reversed(moves[:-1]):
            higher = target.select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("shift"))
            target = target.unionByName(
                move.join(higher, "bin", "left").select(
                    "item", F.coalesce("top", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
                )
            )
        target = staged(target, "moves").select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("shift"))
        placed = placed.join(target, "bin", "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.coalesce("top", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    full = cut.filter(whole).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("item").alias("bin"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).withColumnRenamed("bin", "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
