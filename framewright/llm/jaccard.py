"""N-gram Jaccard join with grouped prefixes: exact links and their connected components.

Documents with the same shingle set form a class, classes with the same prefix and size a group. Groups that share
shingles of their prefixes are compared by size, number of those and a parity sketch; only then are their members
compared, and what remains is verified on the full sets.

A prefix holds the rarest shingles, by classes of an approximate frequency, then by hash. Any such order gives exact
results; this one keeps common passages out of the prefixes. Pairs are met at the first shingle that they share, not at all
of them, and a parity sketch as long as the sets tells most of those that can't link before texts are read again.

Groups of copies don't become all pairs: a first round only tests each document of a shingle's list with the first and
the one before it, and a second round all pairs whose members are still in different components. So no link between two components is lost.
That gives components. Links lie inside them and are then looked at block against block, where a component's lists meet: a
dense group costs comparisons in memory, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.session import broadcast_if_small, scratch_table

from . import sketch
from .common import byte_texts, small_batches, window_hashes, word_hashes
from .components import components

#: Words of a shingle and least similarity in hundredths, unless the caller says otherwise.
WIDTH, LEAST = 5, 80
#: 64-bit words of the parity sketch of a set.
PARITY = 4
BATCH_BYTES = 4 << 20
#: Sets and shingles of a block, on average, and shingles that two blocks are compared on at a time.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_COLUMNS = 256, 1 << 18, 4096

#: Shingles before one in a prefix that its list remembers.
EARLIER = 3

_PARITY = [f"p{i}" for i in range(PARITY)]
_SKETCHES = ["wide", *_PARITY]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of every text, A-Z in lower case.

    A text with fewer words than *width*, but one at least, has all its words as its one shingle.
    """
    hashes, counts = word_hashes([t.lower() for t in texts])
    sets, start = [], 0
    for n in counts:
        own = hashes[start:start + n]
        start += n
        shingles = np.sort(window_hashes(own, min(width, n)) if n else own)
        sets.append(shingles[np.concatenate([[True], shingles[1:] != shingles[:-1]])] if n else shingles)
    return sets


def _all_shingles(texts: list[bytes], width: int) -> np.ndarray:
    return np.concatenate([*shingle_sets(texts, width), np.zeros(0, np.uint64)])


def _parity(shingles: np.ndarray) -> list[int]:
    """Bits that say whether an odd number of shingles falls on them: two sets differ in as many shingles at least."""
    bits = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _wide_parity(shingles: np.ndarray) -> bytes:
    """The same with about as many bits as there are shingles, so that large sets that differ much show it."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart_by(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has, from their wide sketches."""
    sides = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in (a, b)]
    bits = min(map(len, sides))
    # places are lowest bits of a hash: the longer sketch is folded
    x, y = (s.reshape(-1, bits).sum(axis=0) & 1 for s in sides)
    return int((x != y).sum())


def _prefixes(docs: DataFrame, width: int, least: int, frequency: np.ndarray) -> DataFrame:
    """Size, digests, parity sketches and prefix of every row's set; other columns are the identifier alone."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = []
            for s in shingle_sets(list(byte_texts(batch.column("text"))), width):
                n = len(s)
                ordered = s[np.argsort(shared.value[sketch.bucket_of(s)], kind="stable")]
                prefix = ordered[:n - -(-least * n // 100) + 1] if n else ordered
                rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), xxhash.xxh3_128_digest(prefix.tobytes()),
                             prefix.view(np.int64), _wide_parity(s), *_parity(s)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * PARITY]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", "n", "digest", "prefix_digest", "prefix", "wide", *_PARITY])

    schema = "doc_id long, n int, digest binary, prefix_digest binary, prefix array<long>, wide binary, " + ", ".join(f"{p} long" for p in _PARITY)
    return docs.mapInArrow(run, schema)


def _differing_bits(a: str, b: str) -> Column:
    total = F.lit(0)
    for p in _PARITY:
        total = total + F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    return total


def _needed(a: Column, b: Column, least: int) -> Column:
    """Least number of common shingles of sets with these sizes."""
    return F.ceil(least * (a.cast("long") + b) / F.lit(100.0 + least) - 1e-9)


def _close(a: str, b: str, least: int) -> Column:
    """False where size or parity sketch rule a link out; a group of several classes has no sketch (null)."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (100 * na >= least * nb) & (100 * nb >= least * na)
    return sizes & F.coalesce(_differing_bits(a, b) <= na + nb - 2 * _needed(na, nb, least), F.lit(True))


def _enough(common: Column, na: Column, nb: Column, least: int) -> Column:
    """False where this many common prefix shingles rule a link out.

    Of the set whose prefix ends first in the global order, all common shingles up to there are in both prefixes; the
    others lie behind its prefix, which leaves ceil(least * n / 100) - 1 of them at most.
    """
    behind = F.ceil(least * F.greatest(na, nb) / F.lit(100.0) - 1e-9) - 1
    return common + behind >= _needed(na, nb, least)


def _first_common(least: int) -> Column:
    """False where `x` and `y` can't link with this shingle as the first one they share.

    Sets that link have so many common shingles that the first one, in the global order, leaves room for them all behind
    it in both; and where shingles shortly before agree, the pair is met there.
    """
    nx, ny = F.col("x.n"), F.col("y.n")
    needed = _needed(nx, ny, least)
    room = (nx - F.col("x.at") >= needed) & (ny - F.col("y.at") >= needed)
    before = F.lit(False)
    for i in range(1, EARLIER + 1):
        for j in range(1, EARLIER + 1):
            before = before | F.coalesce(F.col(f"x.e{i}") == F.col(f"y.e{j}"), F.lit(False))
    return room & ~before


def _not_too_far(pairs: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """Pairs of groups `ga`, `gb` that their wide sketches don't rule out; a group of several classes has none."""
    sides = [groups.select(F.col("gid").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab"]
    met = sides[0].join(broadcast_if_small(scratch_table(pairs, "met")), "ga").join(sides[1], "gb")
    met = met.withColumn("most", F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), least))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*[batch.column(c).to_pylist() for c in ("wide_a", "wide_b", "most")], strict=True)
            keep = [a is None or b is None or _apart_by(a, b) <= most for a, b, most in told]
            yield batch.select(["ga", "gb"]).filter(pa.array(keep, pa.bool_()))

    return met.select("ga", "gb", "wide_a", "wide_b", "most").mapInArrow(near, "ga long, gb long")


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of each set (a row) with each of the others (a column)."""
    def laid_out(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(group), np.repeat(np.arange(len(group)), [len(s) for s in group])

    (x, in_x), (y, in_y) = laid_out(sets), laid_out(others)
    known = np.intersect1d(x, y)
    found = np.zeros((len(sets), len(others)), np.int64)
    at_x, at_y = np.searchsorted(known, x), np.searchsorted(known, y)
    here_x, here_y = np.isin(x, known), np.isin(y, known)
    for start in range(0, len(known), BLOCK_COLUMNS):
        width = min(BLOCK_COLUMNS, len(known) - start)
        sides = []
        for at, here, owner, n in ((at_x, here_x, in_x, len(sets)), (at_y, here_y, in_y, len(others))):
            mine = here & (at >= start) & (at < start + width)
            side = np.zeros((n, width), np.float32)
            side[owner[mine], at[mine] - start] = 1
            sides.append(side)
        # at most BLOCK_COLUMNS ones are added up, which a float holds exactly
        found += (sides[0] @ sides[1].T).astype(np.int64)
    return found


def _link_counts(table: pa.Table, least: int) -> pa.Table:
    """`digest` and `links` of the sets of two blocks, or of one with itself: documents of the sets that they link with."""
    sides = []
    for left in (True, False):
        mine = table.filter(pa.array([x is left for x in table.column("left").to_pylist()], pa.bool_()))
        sides.append((mine.column("digest").to_pylist(), mine.column("docs").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in mine.column("set")]))
    (a, docs_a, x), (b, docs_b, y) = sides if sides[1][0] else (sides[0], sides[0])
    both = _common(x, y)
    linked = 100 * both >= least * (np.add.outer([len(s) for s in x], [len(s) for s in y]) - both)
    if not sides[1][0]:
        np.fill_diagonal(linked, False)
        return pa.table({"digest": pa.array(a, pa.binary()), "links": pa.array(linked @ docs_a, pa.int64())})
    return pa.table({"digest": pa.array(a + b, pa.binary()), "links": pa.array(np.concatenate([linked @ docs_b, docs_a @ linked]), pa.int64())})


def _links_of(docs: DataFrame, usable: DataFrame, classes: DataFrame, groups: DataFrame, lists: DataFrame, reached: DataFrame, width: int, least: int) -> DataFrame:
    """`digest` and `n_links` of every class: other documents whose sets are similar enough, those of the class included.

    All links lie inside the components *reached*. These are cut into blocks, and two blocks are compared where a list
    holds groups of both, in one task: rows grow with sets and pairs of blocks, not with pairs of documents.
    """
    weights = scratch_table(usable.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("docs")), "weights")
    # an identifier may stand for two classes, which nothing else tells apart
    twice = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    inner = (classes.join(reached, F.col("rep") == F.col("node"), "left").join(twice, "rep", "left")
             .where("component is not null or times is not null").withColumn("comp", F.coalesce("component", "rep"))
             .join(groups.select("n", "prefix_digest", "gid"), ["n", "prefix_digest"]).select("digest", "rep", "n", "gid", "comp"))
    inner = scratch_table(inner, "inner")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_SETS))), F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))))
    large = scratch_table(inner.groupBy("comp").agg(parts.cast("long").alias("parts")).where("parts > 1"), "large")
    inner = inner.join(broadcast_if_small(large), "comp", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")), F.lit(0).cast("long")))
    inner = scratch_table(inner, "blocks")

    # lists of blocks; members of a group may share shingles that no list holds
    homes = inner.where("parts > 1").select("gid", "comp", "block").distinct()
    held = lists.join(homes, "gid").select(F.lit(True).alias("listed"), "shingle", "comp", "block").unionByName(
        homes.select(F.lit(False).alias("listed"), F.col("gid").alias("shingle"), "comp", "block"))
    held = scratch_table(held.distinct(), "held")
    meetings = held.withColumnRenamed("block", "x").join(held.withColumnRenamed("block", "y"), ["listed", "shingle", "comp"]).where("x < y").select("comp", "x", "y")
    own = inner.select("comp", F.col("block").alias("x"), F.col("block").alias("y"))
    meetings = meetings.unionByName(own).distinct()
    sides = F.array(F.struct(F.col("x").alias("block"), F.lit(True).alias("left")), F.struct(F.col("y").alias("block"), F.lit(False).alias("left")))
    ends = meetings.select("comp", "x", "y", F.explode(sides).alias("end")).select("comp", "x", "y", "end.block", "end.left").where("left or x <> y")

    sets = _sets(docs, classes, inner.select("rep"), width).select("digest", "set").dropDuplicates(["digest"])
    sets = scratch_table(inner.join(sets, "digest").join(weights, "digest").select("comp", "block", "digest", "docs", "set"), "sets")
    met = ends.join(sets, ["comp", "block"]).select("comp", "x", "y", "digest", "docs", "set", "left")
    counted = met.groupBy("comp", "x", "y").applyInArrow(lambda table: _link_counts(table, least), "digest binary, links long")
    return weights.join(counted.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left").select(
        "digest", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def _sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """`rep`, `digest` and `set`, the sorted shingles, of the classes in *reps*, from their texts; repeated rows give a set twice."""
    wanted = classes.join(reps.distinct(), "rep").select("rep", F.col("digest").alias("wanted"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            sets = [s.tobytes() for s in shingle_sets(list(byte_texts(batch.column("text"))), width)]
            same = [xxhash.xxh3_128_digest(s) == w for s, w in zip(sets, batch.column("wanted").to_pylist(), strict=True)]
            found = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("wanted"), pa.array(sets, pa.binary())], ["rep", "digest", "set"])
            yield found.filter(pa.array(same))

    # rows that share an identifier are told apart by the digest; equal rows give a pair twice, which does no harm
    ours = docs.join(broadcast_if_small(scratch_table(wanted, "wanted")), docs["id"] == F.col("rep"))
    return ours.select("rep", "wanted", "text").mapInArrow(sets_of, "rep long, digest binary, set binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, least: int) -> DataFrame:
    """Those of the *pairs* (`a`, `b`: identifiers of classes) whose sets are similar enough.

    The texts that occur in pairs are read again and their sets meet the pairs in two joins.
    """
    pairs = scratch_table(pairs.distinct(), "pairs")
    sets = scratch_table(_sets(docs, classes, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), width), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    met = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a")
           .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b"))
    return scratch_table(met.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "links")


def similar_documents(docs: DataFrame, width: int = WIDTH, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per input row: the id column, `n_shingles` and `component_id`, the smallest identifier reachable by links.

    With *links* also `n_links`, the number of other documents that the row's text links with, exact in dense groups, too;
    a document is an identifier with a shingle set. It costs more than components alone.

    Two documents link when 100 * common shingles >= *least* * all their shingles, on whole texts. Texts without words,
    null ones among them, have no shingles and link with nothing. A row with a null identifier has a null component
    and links with nothing. Rows that repeat an identifier count as one document where their texts agree; where not,
    each has its own text's component. Identifiers are whole numbers. Other columns are left out. Shingles are compared by
    64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = sketch.bucket_counts(rows, "text", lambda texts: _all_shingles(texts, width))
    found = scratch_table(_prefixes(rows, width, least, sketch.classes(counts)), "prefixes")

    usable = found.where("n > 0 and doc_id is not null")
    classes = scratch_table(usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix_digest").alias("prefix_digest"), F.first("wide").alias("wide"),
        *[F.first(p).alias(p) for p in _PARITY]), "classes")
    groups = classes.groupBy("n", "prefix_digest").agg(
        F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"), *[F.first(p).alias(p) for p in _SKETCHES])
    groups = scratch_table(groups.select("n", "prefix_digest", "gid", "members", *[F.when(F.col("members") == 1, F.col(p)).alias(p) for p in _SKETCHES]), "groups")
    members = classes.join(groups.where("members > 1").select("n", "prefix_digest", "gid"), ["n", "prefix_digest"]).select("gid", "rep", "n", *_PARITY)

    # lists of the groups that share a prefix shingle
    entries = (found.join(groups.select("n", "prefix_digest", "gid"), ["n", "prefix_digest"])
               .where("doc_id = gid").select("gid", "n", F.explode("prefix").alias("shingle")))
    in_list = Window.partitionBy("shingle").orderBy("gid")
    lists = entries.select("shingle", "gid", "n", F.lag("gid").over(in_list).alias("before"), F.lead("gid").over(in_list).alias("after"))
    lists = scratch_table(lists.where("before is not null or after is not null").drop("before", "after"), "lists")

    # first round: groups with the one before them and the first one in a list, and the members of a group with its
    # first. Groups with the most company come first: what copies were made from rather than copies with many changes
    info = groups.select("gid", "n", *_PARITY)
    company = lists.join(lists.groupBy("gid").agg(F.count(F.lit(1)).alias("shared")), "gid")
    by_company = Window.partitionBy("shingle").orderBy(F.col("shared").desc(), "gid")
    other = F.struct("gid", "n")
    met = company.select("gid", "n", F.array(F.lag(other).over(by_company), F.first(other).over(by_company)).alias("others"))
    met = met.select("gid", "n", F.explode(F.array_distinct("others")).alias("other")).where("other.gid <> gid")
    neighbours = (met.groupBy(F.least("gid", "other.gid").alias("a"), F.greatest("gid", "other.gid").alias("b"))
                  .agg(F.count(F.lit(1)).alias("common"), F.first("other.n").alias("na"), F.first("n").alias("nb")))
    neighbours = neighbours.where(_enough(F.col("common"), F.col("na"), F.col("nb"), least)).select("a", "b")
    neighbours = broadcast_if_small(scratch_table(neighbours, "neighbours"))
    neighbours = (info.alias("x").join(neighbours, F.col("a") == F.col("x.gid")).join(info.alias("y"), F.col("b") == F.col("y.gid"))
                  .where(_close("x", "y", least)).select("a", "b"))
    firsts = members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    first_links = _verified(neighbours.unionByName(firsts), rows, classes, width, least)

    # second round: all pairs that may link and are in different components so far
    reached = components(first_links)
    member_of = (classes.join(groups.select("n", "prefix_digest", "gid"), ["n", "prefix_digest"])
                 .join(reached, F.col("rep") == F.col("node"), "left")
                 .select("gid", "rep", "n", *_PARITY, F.coalesce("component", "rep").alias("comp")))
    member_of = scratch_table(member_of, "members")
    whole = member_of.groupBy("gid").agg(F.min("comp").alias("comp"), F.max("comp").alias("most"))
    whole = groups.join(whole, "gid").select("gid", *_PARITY, F.when(F.col("comp") == F.col("most"), F.col("comp")).alias("comp"))
    told = lists.join(whole, "gid")
    # lists within one component have nothing to tell; in the others, entries learn what stands before them in their prefix
    across = told.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(F.col("comp").isNull()).alias("mixed"))
    told = scratch_table(told.join(across.where("low <> high or mixed > 0").select("shingle"), "shingle", "left_semi"), "across")
    prefixes = (found.join(groups.select("n", "prefix_digest", "gid"), ["n", "prefix_digest"]).where("doc_id = gid").select("gid", "prefix")
                .join(told.select("gid").distinct(), "gid", "left_semi").groupBy("gid").agg(F.first("prefix").alias("prefix")))
    told = told.join(prefixes, "gid").withColumn("at", (F.array_position("prefix", F.col("shingle")) - 1).cast("int"))
    told = scratch_table(told.withColumns({f"e{k}": F.get("prefix", F.col("at") - k) for k in range(1, EARLIER + 1)}).drop("prefix"), "placed")
    apart = F.coalesce(F.col("x.comp") != F.col("y.comp"), F.lit(True))
    pairs = (told.alias("x").join(told.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid"))
                                  & apart & _first_common(least) & _close("x", "y", least))
             .select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct())
    pairs = _not_too_far(pairs, groups, least)
    mixed = whole.where("comp is null").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    expanded = (pairs.unionByName(mixed).join(member_of.alias("x"), F.col("ga") == F.col("x.gid")).join(
        member_of.alias("y"), (F.col("gb") == F.col("y.gid")) & (F.col("x.comp") != F.col("y.comp")) & _close("x", "y", least))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")))
    more = _verified(expanded, rows, classes, width, least)

    # components so far are stars, which the links across them join
    reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    by_class = classes.join(reached, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    counts = []
    if links:
        by_class = by_class.join(_links_of(rows, usable, classes, groups, lists, reached, width, least), "digest")
        counts = [F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")]
    return (found.join(by_class, "digest", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"), *counts))
