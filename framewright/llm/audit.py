"""Which filters remove what: radix tries find repeated texts, bit masks hold what each text fails, sums over masks tell every order.

Texts are range-partitioned by prefixes that are as long as they must be: a prefix that holds more than its share of all
bytes, in texts that differ, is made longer until it doesn't. The texts of one prefix go into a compressed trie whose
terminals hold the least identifier. Copies within a task meet in a trie of the task first and travel as one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.session import broadcast_if_small, scratch_table

from .common import byte_texts, small_batches

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least percentage of distinct words, most percentage of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: Characters of the first prefixes, and how many times longer the next ones are.
PREFIX_CHARS, LONGER = 8, 4
#: Bytes of text per partition, and the part of it that a prefix may hold.
PART_BYTES, SHARE = 32 << 20, 4
#: Bytes of text that the trie of a task holds before it is emptied.
TASK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


class Trie:
    """A compressed trie over bytes; a terminal is a list that its user fills."""

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def terminal(self, text: bytes) -> list:
        """The terminal of *text*, an empty list at first."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            edge = node[0].get(text[at])
            if edge is None:
                leaf: list = [{}, None]
                node[0][text[at]] = [text[at:], leaf]
                node, at = leaf, end
            elif text.startswith(edge[0], at):
                node, at = edge[1], at + len(edge[0])
            else:
                label = edge[0]
                same = self._common(label, text, at)
                between: list = [{label[same]: [label[same:], edge[1]]}, None]
                edge[0], edge[1] = label[:same], between
                node, at = between, at + same
        if node[1] is None:
            node[1] = []
        return node[1]

    @staticmethod
    def _common(label: bytes, text: bytes, at: int) -> int:
        """Length of the common prefix of *label* and the rest of *text*, known to be shorter than *label*."""
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if label[low:mid] == text[at + low:at + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """All texts and their terminals."""
        todo = [(b"", self.root)]
        while todo:
            text, (children, value) = todo.pop()
            if value is not None:
                yield text, value
            todo.extend((text + label, child) for label, child in children.values())


def _fails(text: bytes) -> int:
    """Bits of the filters A to D that *text* fails."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * capitals > MOST_CAPITALS * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


_ROWS = "doc long, part string, mask int, entry long, least long, text binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with its mask and the number of its text, and a row per distinct text of the task."""
    number = TaskContext.get().partitionId() << 40
    trie, held = Trie(), 0
    schema = pa.schema([("doc", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("entry", pa.int64()), ("least", pa.int64()), ("text", pa.binary())])

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, (entry, _, least) in trie.terminals():
            rows.append({"entry": entry, "least": least, "text": text})
            size += len(text)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    for batch in small_batches(batches, "text", BATCH_BYTES):
        masks, numbers = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), byte_texts(batch.column("text")), strict=True):
            terminal = trie.terminal(text)
            if not terminal:
                terminal[:] = [number, _fails(text), doc]
                number, held = number + 1, held + len(text)
            elif doc is not None and (terminal[2] is None or doc < terminal[2]):
                terminal[2] = doc
            numbers.append(terminal[0])
            masks.append(terminal[1])
        none = pa.nulls(len(batch), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("part").cast(pa.string()), pa.array(masks, pa.int32()), pa.array(numbers, pa.int64()), none, pa.nulls(len(batch), pa.binary())], schema=schema)
        if held > TASK_BYTES:
            yield from emptied(trie)
            trie, held = Trie(), 0
    yield from emptied(trie)


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every entry with the least identifier of its text; entries come sorted by prefix, and a prefix has a trie of its own."""
    current, trie = None, Trie()

    def told(trie: Trie) -> Iterator[pa.RecordBatch]:
        entries, least = [], []
        for _, (first, numbers) in trie.terminals():
            entries += numbers
            least += [first] * len(numbers)
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(least, pa.int64())], ["entry", "first"])

    for batch in small_batches(batches, "text", BATCH_BYTES):
        columns = [batch.column(c).to_pylist() for c in ("head", "node", "entry", "least")]
        for head, node, entry, least, text in zip(*columns, byte_texts(batch.column("text")), strict=True):
            if (head, node) != current:
                yield from told(trie)
                current, trie = (head, node), Trie()
            terminal = trie.terminal(text)
            if not terminal:
                terminal[:] = [least, [entry]]
                continue
            terminal[1].append(entry)
            if least is not None and (terminal[0] is None or least < terminal[0]):
                terminal[0] = least
    yield from told(trie)


def _by_prefix(entries: DataFrame) -> DataFrame:
    """Entries range-partitioned and sorted by `head` and `node`, which equal texts share.

    `node` stands for the text's adaptive prefix. All bytes of all entries are counted per prefix; one that holds more than
    its share in texts that differ is replaced by prefixes LONGER times as long, and so on up to whole texts.
    """
    spark = entries.sparkSession
    total = entries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    most = total // (parts * SHARE)
    told, chars = entries.withColumn("chars", F.lit(PREFIX_CHARS)), PREFIX_CHARS
    while True:
        here = F.when(F.col("chars") == chars, F.xxhash64(F.substring("text", 1, chars)))
        sizes = told.select(here.alias("key"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("whole")).where("key is not null")
        large = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.min("whole").alias("low"), F.max("whole").alias("high"))
        large = scratch_table(large.where((F.col("size") > most) & (F.col("low") < F.col("high"))).select("key", F.lit(True).alias("split")), "prefixes")
        if large.isEmpty():
            break
        told = told.withColumn("key", here).join(broadcast_if_small(large), "key", "left")
        told = told.withColumn("chars", F.when(F.col("split"), F.lit(chars * LONGER)).otherwise(F.col("chars"))).drop("key", "split")
        chars *= LONGER
    keyed = told.select("entry", "least", "text", F.substring("text", 1, 2 * PREFIX_CHARS).cast("binary").alias("head"),
                        F.xxhash64(F.substring("text", F.lit(1), F.col("chars"))).alias("node"))
    return keyed.repartitionByRange(parts, "head", "node").sortWithinPartitions("head", "node")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per input row: the id column, `part` and `mask`, whose bit k is set if the text fails the k-th of FILTERS.

    A: fewer than 100 words; B: fewer than 80 % of them distinct; C: more than 10 % capitals among the code points;
    D: one of the symbols # $ % & * |; E: the same text stands under a smaller identifier somewhere.
    A null text counts as empty, a null part as an empty string. Identifiers are whole numbers of 64 bits; a null one is
    neither smaller nor larger than another, and rows that repeat an identifier are no copies of each other. Other
    columns are left out.

    A task keeps TASK_BYTES of distinct texts and sends each of them once; a prefix with more than its share of the bytes
    is split unless it is one text, and of a text come as many entries as tasks hold it.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                       F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"))
    told = scratch_table(rows.mapInArrow(_entries, _ROWS), "masks")
    texts = told.where("text is not null").select("entry", "least", F.col("text").cast("string").alias("text"))
    firsts = _by_prefix(texts).mapInArrow(_least_ids, "entry long, first long")
    masks = told.where("mask is not null").join(firsts, "entry")
    repeated = F.coalesce((F.col("doc") > F.col("first")).cast("int"), F.lit(0))
    return masks.select(F.col("doc").alias(id_col), "part", (F.col("mask") + repeated * (1 << FILTERS.index("E"))).alias("mask"))


def _steps(spark: SparkSession) -> DataFrame:
    """All orders of the filters and their steps: `filter_order`, `step`, the bits `before` and the `own` bit; 600 rows."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(FILTERS) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, own int")


def interactions(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What every filter does at every step of every order, per part: columns as `op11` documents them, zeros included.

    *masks* has the id column, `part` and `mask`; *labels* the id column, `quality` and `toxic`. A document without
    label counts as neither good nor toxic; of repeated labels one that says 1 is enough. No part, no row.

    Masks are counted per part first; what is left has at most 32 rows per part.
    """
    known = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias(id_col)).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad"))
    counts = masks.join(broadcast_if_small(known), id_col, "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    pairs = [(before, 1 << k) for k in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before & 1 << k]
    each = counts.withColumn("pair", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in pairs])))
    mask, before, own = F.col("mask"), F.col("pair.before"), F.col("pair.own")
    fails = mask.bitwiseAND(own) > 0
    open_ = mask.bitwiseAND(before) == 0
    total = lambda condition, column="docs": F.sum(F.when(condition, F.col(column)).otherwise(0)).cast("long")
    # of all orders, a filter comes before the others that a document fails in one of as many as it fails
    orders = F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count(mask), F.lit(1))
    sums = each.groupBy("part", before.alias("before"), own.alias("own")).agg(
        total(open_ & ~fails).alias("kept"), total(open_ & fails).alias("removed"), total(~open_ & fails).alias("redundant"),
        total(mask == own).alias("unique_fails"), total(open_ & fails, "good").alias("good_lost"),
        total(open_ & fails, "bad").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("docs") * orders.cast("long")).otherwise(0)).cast("long").alias("shapley"))
    return sums.join(F.broadcast(_steps(masks.sparkSession)), ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
