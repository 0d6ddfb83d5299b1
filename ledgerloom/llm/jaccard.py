"""Grouped prefix join: documents whose shingle sets have a Jaccard similarity of 90 % or more, and their components.

1. Documents with equal sets are one class; its smallest id stands for it.
2. Shingles are ordered by how many documents hold them, then by hash. Counts come from all documents, as a table of
   ``CELLS`` cells that holds the largest count of any shingle of the cell: a frequent shingle is never taken for a rare
   one. Sets that link share ``SHARED`` shingles of their prefixes, or all they must have in common where that is less
   (only at 50 percent or below). Classes with one prefix and one size are a group.
3. Groups that share prefix shingles are gathered. A shingle of at most ``HOT`` groups gives pairs; a more frequent one
   hangs its groups on the smallest, so its rows grow with the list, not with its square.
4. Gathered groups are compared by their prefixes in blocks, and pass as a pair only if their sizes fit and the shared
   part of the prefixes, with what both have after the end of the first, makes up the overlap that a link needs. What hangs together by such pairs is a
   cluster, expanded to its classes, whose whole texts are compared block by block. A block returns a spanning forest
   of its links, so copies are never expanded into all pairs, and no link between different sets is lost.

A block holds ``BLOCK`` sets and ``BLOCK_SHINGLES`` shingles, or one larger set. Any order of shingles is correct; the
counts only keep lists short. Null text, empty text or no words: 0 shingles, linked with nothing. Rows with one id are
one document: its component is that of all of them. A null id is linked with nothing and keeps a null component. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import lists, table, text_columns, text_slices, tidy, written
from ledgerloom.llm.components import connected
from ledgerloom.llm.shingles import shingle_sets

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 3, 90
#: Prefix shingles that linked sets share, longest list that gives pairs, sets and shingles of a block.
SHARED, HOT, BLOCK, BLOCK_SHINGLES = 2, 64, 1024, 1 << 19
#: A shingle counted more often is ordered by its count. Cells of the table of counts (a byte each), and of a chunk of it.
FREQUENT, CELLS, CHUNK = 8, 1 << 24, 1 << 16
#: Bytes of text handled at once, and columns of a block's incidence matrix.
SLICE_BYTES, COLUMNS, SPARSE = 4 << 20, 2048, 16


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of n shingles in order to look at, so that two linked sets share ``SHARED`` of them."""
    return min(n, n - -(-percent * n // 100) + SHARED)


def frequency_levels(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Eight times the logarithm of the count of a cell's most frequent shingle, 0 if none is frequent.

    Only twice the prefix is counted: shingles with higher hashes come into a prefix only where most lower ones are
    frequent. The driver gets ``CELLS`` bytes.
    """

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = [s[: 2 * prefix_length(len(s), percent)] for s in shingle_sets(part.column(1), words)]
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    def levels(rows: pa.Table) -> pa.Table:
        cells = rows.column("cell").to_numpy()
        chunk = np.zeros(CHUNK, np.uint8)
        np.maximum.at(chunk, cells % CHUNK, np.minimum(255, np.ceil(8 * np.log2(rows.column("n").to_numpy()))).astype(np.uint8))
        return pa.table({"chunk": [int(cells[0]) // CHUNK], "levels": [chunk.tobytes()]})

    counted = docs.mapInArrow(tidy(low), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    cells = counted.groupBy(F.pmod("token", F.lit(CELLS)).alias("cell")).agg(F.max("n").alias("n"))
    found = cells.groupBy(F.floor(F.col("cell") / CHUNK)).applyInArrow(levels, "chunk long, levels binary").toArrow()
    whole = np.zeros(CELLS, np.uint8)
    for k, chunk in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        whole[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(chunk, np.uint8)
    return whole


def _two(data: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist())


def levels_of(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The levels by which shingles are ordered; those of one level are ordered by hash."""
    return levels[(tokens % np.uint64(len(levels))).astype(np.int64)]


def sketches(docs: DataFrame, shared: Broadcast, words: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, g1, g2, prefix): size, keys of the set and of (size, prefix), and the ordered prefix. ``shared``: levels."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column(1), words)
                keys, prefixes = [], []
                for own in sets:
                    count = levels_of(own, levels)
                    length = prefix_length(len(own), percent)
                    alone = len(own) < 2 and percent > 50  # one shingle: linked with equal sets only
                    prefix = own[:0] if alone else own[np.argsort(count, kind="stable")[:length]]
                    prefixes.append(prefix.view(np.int64))
                    keys.append((*_two(own.tobytes()), *_two(len(own).to_bytes(8, "little") + prefix.tobytes())))
                keys = np.array(keys, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(k) for k in keys.T),
                     lists(np.concatenate(prefixes), np.array([len(p) for p in prefixes]), pa.int64())],
                    names=["doc_id", "n", "k1", "k2", "g1", "g2", "prefix"],
                )

    return docs.mapInArrow(tidy(sketch), "doc_id long, n long, k1 long, k2 long, g1 long, g2 long, prefix array<long>")


def candidate_edges(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): groups (gid, n, prefix) that share a prefix shingle and may hold linked sets, or hang on a frequent one."""
    postings = groups.select("gid", "n", F.explode("prefix").alias("token"))
    several = postings.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    several = written(postings.join(several, "token"), "postings")
    rare = several.where(F.col("groups") <= HOT)
    needed = F.lit(SHARED)
    if percent <= 50:  # above, different sets of linking sizes must have two shingles in common
        needed = F.least(needed, F.ceil(percent * (F.max("n_a") + F.max("n_b")) / (100 + percent)))
    pairs = (
        rare.select("token", F.col("gid").alias("a"), F.col("n").alias("n_a"))
        .join(rare.select("token", F.col("gid").alias("b"), F.col("n").alias("n_b")), "token")
        .where(f"a < b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .groupBy("a", "b").agg(F.count("*").alias("count"), needed.alias("needed")).where("count >= needed").select("a", "b")
    )
    hot = several.where(F.col("groups") > HOT)
    hubs = hot.groupBy("token").agg(F.min("gid").alias("b"))
    return pairs.union(hot.join(hubs, "token").select(F.col("gid").alias("a"), "b").distinct())


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets: rare shingles by pairs, frequent ones by matrix products."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    starts = np.cumsum(counts) - counts
    for times in range(2, SPARSE + 1):
        members = owner[starts[counts == times][:, None] + np.arange(times)]
        for i in range(times):
            for j in range(i):
                np.add.at(sizes, (members[:, i], members[:, j]), 1)
    sizes += sizes.T
    dense = np.flatnonzero(counts > SPARSE)
    for first in range(0, len(dense), COLUMNS):
        some = dense[first : first + COLUMNS]
        x = np.zeros((n, len(some)), np.float32)
        for column, t in enumerate(some):
            x[owner[starts[t] : starts[t] + counts[t]], column] = 1
        sizes += x @ x.T
    return sizes.astype(np.int64)


def forest(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links as pairs of ids."""
    waiting, edges = set(range(len(ids))), []
    while waiting:
        reached = [waiting.pop()]
        while reached:
            i = reached.pop()
            for j in [j for j in np.flatnonzero(linked[i]).tolist() if j in waiting]:
                waiting.discard(j)
                edges.append((ids[i], ids[j]))
                reached.append(j)
    return edges


def in_blocks(sets: DataFrame, ident: str, n: str) -> DataFrame:
    """``sets`` (ident, cluster, n, ...) of clusters of two or more, once for each pair (i, j) of blocks that its own is part of."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(n).alias("sum")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("sum") / BLOCK_SHINGLES))
    dealt = sets.join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return dealt.withColumn("block", F.pmod(F.xxhash64(ident), F.col("blocks"))).withColumn(
        "pair", F.explode(F.transform(others, lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j"))))
    ).select(*sets.columns, "pair.i", "pair.j")


def _edges(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def heads(prefixes: list[np.ndarray], levels: np.ndarray) -> np.ndarray:
    """For sets a and b, how many shingles of a's ordered prefix do not come after the end of b's."""
    tokens = np.unique(np.concatenate(prefixes))
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, levels_of(tokens, levels)))] = np.arange(len(tokens))
    places = [rank[np.searchsorted(tokens, p)] for p in prefixes]
    ends = np.array([p[-1] if len(p) else -1 for p in places])
    return np.stack([np.searchsorted(p, ends, side="right") for p in places])


def fitting(sizes: np.ndarray, prefixes: np.ndarray, shared: np.ndarray, percent: int, heads: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets may link: by size, and by the prefix shingles they share.

    Up to the end of the prefix that ends first, two sets share prefix shingles only; what else they share comes after it
    in both. Without ``heads`` it is not known which ends first: it has all the rest after its own prefix.
    """
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    needed = -(-percent * (small + large) // (100 + percent))
    if heads is None:
        rest = sizes - prefixes
        room = np.maximum(rest[:, None], rest)
    else:
        rest = sizes[:, None] - heads
        room = np.minimum(rest, rest.T)
    return (100 * small >= percent * large) & (shared > 0) & (shared + room >= needed)


def fitting_groups(groups: DataFrame, shared: Broadcast, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs of gathered groups (gid, cluster, n, length, prefix) that may hold linked sets."""

    def compare(block: pa.Table) -> pa.Table:
        if block.num_rows < 2:
            return _edges([])
        prefixes = [np.array(p, np.int64).view(np.uint64) for p in block.column("prefix").to_pylist()]
        lengths = np.array([len(p) for p in prefixes])
        fits = fitting(block.column("n").to_numpy(), lengths, intersections(prefixes), percent, heads(prefixes, shared.value))
        return _edges(forest(block.column("gid").to_pylist(), fits))

    return in_blocks(groups, "gid", "length").groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def verified_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect all linked classes. ``members``: (rep, cluster, n)."""
    placed = in_blocks(members, "rep", "n").select("rep", "cluster", "i", "j")
    texts = docs.join(placed, F.col("doc_id") == F.col("rep")).select("cluster", "i", "j", "doc_id", "text")

    def compare(block: pa.Table) -> pa.Table:
        if block.num_rows < 2:
            return _edges([])
        sets = [s for part in block.to_batches() for some in text_slices(part, "text", SLICE_BYTES)
                for s in shingle_sets(some.column("text"), words)]
        sizes = np.array([len(s) for s in sets])
        common = intersections(sets)
        linked = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
        return _edges(forest(block.column("doc_id").to_pylist(), linked))

    return texts.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = text_columns(docs)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, words, percent))
    sketch = written(sketches(docs, levels, words, percent), "sketches")
    usable = sketch.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("k1", "k2").agg(*(F.min(c).alias(c) for c in ("g1", "g2", "n")), F.min("doc_id").alias("rep"))
    groups = written(
        usable.groupBy("g1", "g2").agg(F.min("doc_id").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix")),
        "groups",
    )
    gathered = connected(candidate_edges(groups, percent)).withColumnRenamed("component", "cluster")
    near = groups.join(gathered, F.col("gid") == F.col("id")).select("gid", "cluster", "n", F.size("prefix").alias("length"), "prefix")
    clusters = connected(fitting_groups(near, levels, percent)).withColumnRenamed("component", "found")
    members = (
        classes.join(groups.select("g1", "g2", "gid"), ["g1", "g2"])
        .join(clusters, F.col("gid") == F.col("id"), "left")
        .select("rep", F.coalesce("found", "gid").alias("cluster"), "n").distinct()
    )
    links = verified_links(docs, written(members, "members"), words, percent)
    # rows of one id are one document, which ties its classes
    several_sets = usable.groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("sets")).where("sets > 1").select("doc_id")
    ties = usable.join(several_sets, "doc_id").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    components = connected(links.union(ties.select("doc_id", "rep")))
    named = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep").join(
        components, F.col("rep") == F.col("id"), "left"
    ).select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    return sketch.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of every component, that of its smallest id, with all columns; rows without id stay."""
    kept = join(docs, words, percent).where("doc_id = component_id").select(F.col("doc_id").alias("\x00id")).distinct()
    first = Window.partitionBy("\x00id").orderBy(F.xxhash64("text"))
    # the join already sorts by id; an id has more than one row only where the table repeats it
    named = docs.join(kept, F.col("doc_id") == F.col("\x00id")).withColumn("\x00n", F.row_number().over(first))
    return named.where(F.col("\x00n") == 1).select(*docs.columns).union(docs.where("doc_id is null"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op8_jaccard": (op8_jaccard, None)}
