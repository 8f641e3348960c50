"""Operator 6: SimHash fingerprints, and their links by BK-trees.

Fingerprints within ``radius`` bits of each other agree on one of radius + 1 blocks of bits. So a
cell is a block with its value, every distinct fingerprint goes to radius + 1 cells, and a shard is
the cells that a shuffle deals to one task. There each cell becomes a BK-tree (children keyed by
their integer Hamming distance to the parent) and each fingerprint searches its own cells' trees,
following only edges within the radius. A cell of more than ``crowd`` fingerprints is dealt on by
blocks of its other bits, which loses no link for the same reason; after the last level so few bits
are open that no cell can be large.

Shard trees are not broadcast: together they hold the fingerprints of all documents, which must not
pass the driver. The shuffle takes each tree to the queries that can have links in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_small, join_unique, slices

BITS = 64
#: Pairs of a query and a tree node looked at in one step.
STEP = 1 << 20
#: Members of cells that a task searches at once.
HELD = 1 << 17


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half of their hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``also``, and fp long (the 64 bits, signed) of every row; texts are read whole."""
    names = [id_col, *also]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in b.column(len(names)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps)], [*names, "fp"])

    return df.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, fp long")


class BKForest:
    """BK-trees of several groups of fingerprints, kept in arrays: a node is a fingerprint's place.

    ``first`` and ``last`` give a node's children in ``child``, which stand in order of ``edge``,
    their distance to the node.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray) -> None:
        n = len(fp)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        # Members that are no node yet lie under a node (or a group) at a distance. The first of
        # each such heap becomes a node there; the others go to heaps under it.
        todo = np.arange(n)
        under, far = group.astype(np.int64), np.zeros(n, np.int64)
        top = True
        while len(todo):
            order = np.lexsort((todo, far, under))
            todo, under, far = todo[order], under[order], far[order]
            new = np.concatenate([[True], (under[1:] != under[:-1]) | (far[1:] != far[:-1])])
            nodes = todo[new]
            if not top:
                parent[nodes], edge[nodes] = under[new], far[new]
            owner = nodes[np.cumsum(new) - 1]
            todo, owner = todo[~new], owner[~new]
            under, far = owner, np.bitwise_count(fp[todo] ^ fp[owner]).astype(np.int64)
            top = False
        self.fp = fp
        self.roots = np.flatnonzero(parent < 0)
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * (BITS + 1) + edge[inner]
        order = np.argsort(key, kind="stable")
        self.child, self.key = inner[order], key[order]

    def search(self, query: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``query``, node) within the radius; ``start``: the root for each query."""
        heaps = [(np.arange(len(query)), start)]
        while heaps:
            who, node = heaps.pop()
            if len(who) > STEP:
                heaps += [(who[:STEP], node[:STEP])] + [(who[STEP:], node[STEP:])]
                who, node = heaps.pop(-2)
            d = np.bitwise_count(query[who] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield who[near], node[near]
            a = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            b = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            size = b - a
            if total := int(size.sum()):
                who = np.repeat(who, size)
                node = self.child[np.arange(total) - np.repeat(np.cumsum(size) - size - a, size)]
                heaps.append((who, node))


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: link all pairs, each set under its smallest place; flat on return."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def shard_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard, as (fingerprint, smallest fingerprint that it reaches here)."""
    # Most fingerprints are alone in their cell.
    order = np.lexsort((fp, cell))
    cell, fp = cell[order], fp[order]
    same = cell[1:] == cell[:-1]
    paired = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    cell, fp = cell[paired], fp[paired]
    if not len(cell):
        return fp, fp
    new = np.concatenate([[True], cell[1:] != cell[:-1]])
    group = np.cumsum(new) - 1
    forest = BKForest(fp, group)
    names, place = np.unique(fp, return_inverse=True)
    parent = np.arange(len(names))
    for who, node in forest.search(fp, forest.roots[group], radius):
        apart = who < node
        parent = merge(parent, place[who[apart]], place[node[apart]])
    linked = np.flatnonzero(parent != np.arange(len(names)))
    return names[linked], names[parent[linked]]


def block_masks(level: int, parts: int) -> list[int]:
    """The bits of each block: by a digit to base ``parts`` of a number spread evenly over all five digits, so that the open bits of any cell are dealt about evenly."""
    block = lambda i: i * parts**5 // BITS // parts**level % parts
    return [sum(1 << i for i in range(BITS) if block(i) == k) for k in range(parts)]


def links(fps: DataFrame, radius: int = 2, crowd: int = 4096, levels: int = 5) -> DataFrame:
    """fp, to: links of distinct fingerprints that join all within ``radius`` bits, spanning each shard's part.

    ``fps`` has a column fp without repeats. A cell of more than ``crowd`` fingerprints goes on to
    the next level; cells are counted and looked up by their hashes (``join_small``), whatever
    their number. After five levels at most 11 of the 64 bits are open, so a cell has at most 2048.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = shard_links(cell, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["fp", "to"])

        cells, fps_, held = [], [], 0
        for b in batches:
            cells.append(b.column(0).to_numpy(zero_copy_only=False))
            fps_.append(b.column(1).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= HELD:  # rows come in order of their cells: the last one may go on
                cell, fp = np.concatenate(cells), np.concatenate(fps_)
                end = int(np.searchsorted(cell, cell[-1]))
                if end:
                    yield found(cell[:end], fp[:end])
                cells, fps_, held = [cell[end:]], [fp[end:]], len(cell) - end
        if held:
            yield found(np.concatenate(cells), np.concatenate(fps_))

    parts = radius + 1
    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long")
    out = None
    # cell: hash of all (block, value) so far; free: the bits that they leave open.
    open_ = fps.select("fp", F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("free"))
    for level in range(levels):
        masks = [F.col("free").bitwiseAND(signed(m)) for m in block_masks(level, parts)]
        dealt = F.array(*[F.struct(F.xxhash64(F.col("cell"), F.lit(level), F.lit(k), F.col("fp").bitwiseAND(m)).alias("cell"), F.col("free").bitwiseAND(F.bitwise_not(m)).alias("free")) for k, m in enumerate(masks)])
        rows = open_.select("fp", F.explode(dealt).alias("c")).select("fp", "c.cell", "c.free")
        crowded = None
        if level < levels - 1:
            full = checkpoint(rows.groupBy("cell").count().filter(F.col("count") > crowd).select("cell", F.lit(True).alias("_full")))
            if not full.isEmpty():
                told = checkpoint(join_small(checkpoint(rows), full, "cell", "left"))
                rows, crowded = told.filter("_full is null"), told.filter("_full").select("fp", "cell", "free")
        links_ = rows.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "fp long, to long")
        out = links_ if out is None else out.unionByName(links_)
        if crowded is None:
            break
        open_ = crowded
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: the smallest fingerprint (as signed) reachable over the edges fp, to, for each end of an edge.

    Each round every node takes the least grandparent of its neighbours for itself and for its
    parent, and jumps to its own grandparent; rounds grow with the logarithm of the longest chain.
    Joins are of a side with one row a node, hot nodes apart (``join_unique``).
    """
    both = edges.select("fp", "to").unionByName(edges.select(F.col("to").alias("fp"), F.col("fp").alias("to"))).distinct()
    both = checkpoint(both)
    node = checkpoint(both.groupBy("fp").agg(F.least(F.col("fp"), F.min("to")).alias("up")))
    while True:
        top = node.select(F.col("fp").alias("up"), F.col("up").alias("top"))
        jumped = checkpoint(join_unique(node, top, "up"))  # fp, up, top: the grandparent
        least = join_unique(both, jumped.select(F.col("fp").alias("to"), "top"), "to").groupBy("fp").agg(F.min("top").alias("least"))
        seen = jumped.join(least, "fp")
        moves = seen.select(F.explode(F.array(F.struct("fp", F.least("top", "least").alias("up")), F.struct(F.col("up").alias("fp"), F.col("least").alias("up")))).alias("m")).select("m.*")
        after = checkpoint(moves.groupBy("fp").agg(F.min("up").alias("up")))
        changed = after.join(node.withColumnRenamed("up", "was"), "fp").filter("up <> was").limit(1).count()
        node = after
        if not changed:
            return node.select("fp", F.col("up").alias("root"))


def fingerprint_roots(own: DataFrame, radius: int) -> DataFrame:
    """fp, _own, root of fingerprints that have links: ``own`` has fp, without repeats, and _own."""
    return components(links(own.select("fp"), radius)).join(own, "fp")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint every text and join texts whose fingerprints differ in ``radius`` bits or fewer, over chains.

    Returns ``id_col``, fp long, fingerprint (16 hex digits), component_id: the smallest id
    reachable, the row's own included. Null and blank texts have fingerprint zero and link like any
    other. Null ids are never the smallest; a component of null ids only has a null component_id.
    Rows stay as they are: repeated rows are repeated in the result. An empty table gives no rows.
    Other columns are not read.
    """
    docs = checkpoint(fingerprints(df, id_col, text_col, shingle))
    named = least_of_components(docs, F.min(id_col), radius).withColumnRenamed("least", "component_id")
    return join_unique(docs, named, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_of_components(docs: DataFrame, least: Column, radius: int) -> DataFrame:
    """fp, least: for each distinct fingerprint the least value, by the aggregate ``least`` of a row, in its component."""
    own = checkpoint(docs.groupBy("fp").agg(least.alias("_own")))
    members = checkpoint(fingerprint_roots(own, radius))
    best = checkpoint(members.groupBy("root").agg(F.min("_own").alias("_least")))
    linked = join_unique(members, best, "root").select("fp", "_least")
    return checkpoint(own.join(linked, "fp", "left").select("fp", F.coalesce("_least", "_own").alias("least")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, all columns as they were: the one with the smallest id, null ids last.

    Rows that share that id (or have none) are told apart by a hash of all their columns, the
    smallest stays, and of rows that are equal in all columns one. No other row of the component
    stays, and no row of another component goes. An empty table gives no rows.
    """
    # The row goes along as one value, so that none of its names can clash.
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    docs = checkpoint(fingerprints(hashed, "_id", "_text", shingle, ("_row",)))
    first = F.min(F.struct(F.col("_id").isNull().alias("lone"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    kept = least_of_components(docs, first, radius).select(F.col("least.id").alias("_kept"), F.col("least.row").alias("_kept_row")).distinct()
    own = hashed.join(kept, (F.col("_row") == F.col("_kept_row")) & F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    # Rows that are equal in all columns are rare; where there are none, the rows need not move again.
    repeated = docs.groupBy("_row").count().filter("count > 1").limit(1).count()
    return (own.dropDuplicates(["_id", "_row"]) if repeated else own).select("_whole.*")
