"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. A tree branches sets by the value of one coordinate of their
MinHash signature; which coordinate depends on the path so far, so similar sets keep falling into the same
node while the node's path is being chosen. Small nodes are compared exhaustively, large ones branch again,
and independent trees are repeated until a pair at the threshold is missed with negligible probability.
Every candidate is confirmed on the two full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carestrata.llm import hashing
from carestrata.llm.tables import Workspace, components, joined, picked, same

COORDINATES = 64
COLUMNS_AT_ONCE = 2048
#: Bytes of written doc_ids that pass through the driver to every task; about 250,000 ids, whatever the input.
IDS_BYTES = 2 << 20
#: Standard deviations that the agreement of two signatures may fall short of the similarity asked for: a pair at
#: the similarity itself is lost with a probability below 1e-8.
SLACK = 6.0
_factors = np.random.default_rng(7).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)

SETS = "doc_id long, t long, n_shingles long, node struct<k1:long,k2:long>, signature array<int>"


def shingle_sets(column: pa.Array, size: int):
    """Per piece of a text column: first row, all distinct shingle hashes, and where each text's begin."""
    for row, data, offsets in hashing.pieces(column):
        starts, ends, first = hashing.words(data, offsets)
        word = hashing.hash_spans(data, starts, ends, fold_case=True)
        grams = hashing.shingles(word, size)
        sets = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= size:
                sets.append(np.unique(grams[lo:hi - size + 1]))
            elif hi > lo:
                sets.append(hashing.mix(hashing.shingles(word[lo:hi], hi - lo) + np.uint64(hi - lo)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield row, sets


def _keys(sets: list) -> tuple:
    """Two independent 64-bit sums that name each set, the flat hashes, and which sets hold some."""
    counts = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(counts)
    flat = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
    begins = (np.cumsum(counts) - counts)[full]
    keys = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        keys[0, full] = np.add.reduceat(hashing.mix(flat), begins)
        keys[1, full] = np.add.reduceat(hashing.mix(flat ^ np.uint64(hashing.BASE)), begins)
    node = pa.StructArray.from_arrays(
        [pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64))], ["k1", "k2"])
    return counts, full, flat, begins, node


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for row, sets in shingle_sets(batch.column(1), size):
                counts, full, flat, begins, node = _keys(sets)
                marks = np.zeros((len(sets), COORDINATES), np.int32)
                if len(full):
                    for c, factor in enumerate(_factors):
                        ranks = ((flat * factor) >> np.uint64(32)).astype(np.uint32)
                        marks[full, c] = np.minimum.reduceat(ranks, begins).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, len(sets)).cast(pa.int64()), batch.column(2).slice(row, len(sets)), pa.array(counts), node,
                    pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * COORDINATES, COORDINATES, dtype=np.int32),
                                             pa.array(marks.ravel())),
                ], ["doc_id", "t", "n_shingles", "node", "signature"])
    return run


def _whole_sets(size: int):
    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), size):
                yield pa.RecordBatch.from_arrays(
                    [_keys(sets)[-1], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))
    return run


def _branch(path, signature: str, prefix: list) -> Column:
    coordinate = F.pmod(F.xxhash64(*prefix, path), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(*prefix, path, coordinate, F.element_at(F.col(signature), coordinate + 1))


def candidate_nodes(work: Workspace, classes: DataFrame, trees: int, small: int, depth: int,
                    branches: int) -> DataFrame:
    """Leaves of all trees with two members or more: (path, node, n, size), n the set's own size."""
    members = (classes.select("node", "n_shingles", "signature", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
               .select(_branch(F.col("tree"), "signature", [F.lit(0)]).alias("path"), "node", "n_shingles", "signature"))
    leaves, written, level = [], [], 1
    while True:
        slim = members.select("path", "node", "n_shingles")
        sized = slim.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = work.cut(slim.join(sized, "path"))
        written.append(shared)
        last = level == depth
        leaves.append(shared if last else shared.filter(F.col("size") <= small))
        if last or not shared.filter(F.col("size") > small).take(1):
            break
        large = shared.filter(F.col("size") > small).select("path", "node", "n_shingles")
        members = (large.join(classes.select("node", "signature"), "node")
                   .select("path", "node", "n_shingles", "signature",
                           F.explode(F.sequence(F.lit(1), F.lit(branches))).alias("branch"))
                   .select(_branch(F.col("path"), "signature", [F.col("branch")]).alias("path"),
                           "node", "n_shingles", "signature"))
        level += 1
    whole = leaves[0]
    for more in leaves[1:]:
        whole = whole.union(more)
    whole = work.cut(whole)
    work.drop(*written)
    return whole


def _exhaustive(leaves: DataFrame) -> DataFrame:
    other = leaves.select("path", F.col("node").alias("other"), F.col("n_shingles").alias("m"))
    return leaves.join(other, "path").filter("node < other").select("node", "n_shingles", "other", "m")


def linked(left: list, right: list | None, percent: int) -> np.ndarray:
    """Which pairs of sets (of one list, or across two) reach the similarity, from their shared shingles."""
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.cumsum(count > 1)[code[shared]] - 1
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    rows = slice(0, len(left))
    columns = slice(len(left), len(sets)) if right is not None else rows
    both = np.zeros((len(left), columns.stop - columns.start), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(code, (at, at + COLUMNS_AT_ONCE))
        held = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        held[owner[lo:hi], code[lo:hi] - at] = 1
        both += held[rows] @ held[columns].T
    return 100 * both >= percent * (sizes[rows, None] + sizes[None, columns] - both)


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (first, member) of each connected group of a symmetric relation."""
    fresh, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if not fresh[i]:
            continue
        fresh[i] = False
        front = near[i] & fresh
        while front.any():
            members = np.flatnonzero(front)
            fresh[members] = False
            out += [(i, m) for m in members.tolist()]
            front = near[members].any(axis=0) & fresh
    return out


def least_agreement(percent: int) -> int:
    """Coordinates in which the signatures of two sets of that similarity agree at least."""
    share = percent / 100
    return max(1, int(COORDINATES * share - SLACK * (COORDINATES * share * (1 - share)) ** 0.5))


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many coordinates each left signature agrees with each right one."""
    both = np.zeros((len(left), len(right)), np.uint8)
    for c in range(COORDINATES):
        both += left[:, c, None] == right[None, :, c]
    return both


def _alike(percent: int):
    """Whether pairs of signatures are as near as those of sets of the similarity are."""
    least = least_agreement(percent)

    def near(data: pa.Array, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        marks = data.flatten().to_numpy().reshape(len(data), COORDINATES)
        return _agreeing(marks[a], marks[a if b is None else b]) >= least

    return near


def _linked(percent: int):
    """Whether pairs of whole sets reach the similarity."""
    def near(data: pa.Array, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in data]
        return linked([sets[i] for i in a], None if b is None else [sets[i] for i in b], percent)

    return near


def _tile(near):
    """Links that span the groups of a tile: of one chunk, or across two."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data, chunk = group.column("data").combine_chunks(), group.column("chunk").to_numpy()
        own = chunk == group.column("i")[0].as_py()
        a, b = np.flatnonzero(own), np.flatnonzero(~own)
        if len(b):
            order, cross = np.r_[a, b], near(data, a, b)
            whole = np.zeros((len(order), len(order)), bool)
            whole[:len(a), len(a):] = cross
            whole[len(a):, :len(a)] = cross.T
        else:
            order, whole = a, near(data, a, None)
        edges = spanning(whole)
        node = group.column("node")
        return pa.table([node.take(pa.array([int(order[e[k]]) for e in edges], pa.int64())) for k in (0, 1)], names=["a", "b"])
    return run


def tiled_links(crowds: DataFrame, data: DataFrame, near, tile_rows: int) -> DataFrame:
    """Links that span the groups of each crowd (node, label), by square tiles of ``tile_rows`` nodes a side over the
    ``data`` (node, data) of its nodes."""
    sizes = crowds.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("chunks"))
    placed = crowds.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = placed.select(
        "node", "label", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "node", "label", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return tiles.join(data, "node").groupBy("label", "i", "j").applyInArrow(
        _tile(near), "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>")


def plausible_crowds(work: Workspace, leaves: DataFrame, classes: DataFrame, percent: int, tile_rows: int) -> DataFrame:
    """Groups (node, label) within the large leaves whose signatures are near enough: what shares a large leaf in any
    tree is one crowd, compared in tiles by the 256 bytes of its signatures."""
    hubs = leaves.groupBy("path").agg(F.min("node").alias("hub"))
    edges = work.cut(leaves.join(hubs, "path").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    sharing = work.cut(components(work, edges))
    marks = classes.select("node", F.col("signature").alias("data"))
    links = work.cut(tiled_links(sharing, marks, _alike(percent), tile_rows))
    near = work.cut(components(work, links))
    work.drop(edges, sharing, links)
    return near


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Drop what the set sizes alone rule out, and repetitions across trees."""
    small, big = F.least("n_shingles", "m"), F.greatest("n_shingles", "m")
    return (pairs.filter((F.col("node") != F.col("other")) & (100 * small >= percent * big))
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


def _near_signatures(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree as those of sets of the similarity do."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("left"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("right"))
    agreeing = F.size(F.filter(F.zip_with("left", "right", lambda x, y: x == y), lambda same: same))
    return pairs.join(left, "a").join(right, "b").filter(agreeing >= least_agreement(percent)).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, size: int = 5,
                    percent: int = 80, trees: int = 10, small: int = 12, depth: int = 4, branches: int = 2,
                    tile_rows: int = 1024, keys: bool = False) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least ``percent`` hundredths.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased; a document of fewer than
    ``size`` words is one shingle of all its words. Returns one row per input row: doc_id, n_shingles,
    component_id (the smallest doc_id reachable over links) and kept (doc_id = component_id). With ``keys`` also t,
    a hash of the row's text, and component_t, that of the group's first text: of (doc_id, t) the smallest, null
    doc_ids last. Rows with one doc_id and different texts, null ids above all, are told apart by these.

    Texts without words (null, empty, white space) have n_shingles 0 and are their own component. Rows with
    equal sets form one class before any comparison, so thousands of copies cost one comparison; repeated rows
    are such a class. A null doc_id takes part like any other and is the smallest only if alone. An empty
    table gives an empty result; other columns are ignored.

    A pair at similarity s shares a tree's first branch with probability s and each later one with
    1-(1-s)^branches. At s = 0.85 ten trees miss it with a probability below 1e-6 at depth 1 and 1e-5 at
    depth 4. Candidates whose signatures agree too little for that similarity go before whole sets are read (see
    SLACK). No group is listed in pairs: what still shares a leaf of more than ``small`` sets is compared in square
    tiles of ``tile_rows`` signatures a side, and the groups found near that way once more in tiles of their whole
    sets, each a matrix product over shared shingles in its own task, which gives back links that span its groups.
    """
    work = Workspace(docs.sparkSession)
    source = picked(docs, doc_id=doc_id, text=text).withColumn("t", F.xxhash64("text"))
    rows = work.cut(source.mapInArrow(_signatures(size), SETS))
    classes = work.cut(rows.filter("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t")).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")).withColumn("first_id", F.col("first.doc_id")))
    leaves = candidate_nodes(work, classes, trees, small, depth, branches)
    few, many = leaves.filter(F.col("size") <= small), leaves.filter(F.col("size") > small)
    pairs = work.cut(_near_signatures(_plausible(_exhaustive(few), percent), classes, percent))
    crowds = plausible_crowds(work, many, classes, percent, tile_rows)
    work.drop(leaves)
    # whole sets only of those that a signature puts near another
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowds.select("node")).distinct()
    wanted = work.cut(nodes.join(classes.select("node", "first_id"), "node").select("first_id").distinct())
    texts = (joined(source, wanted, same(F.col("doc_id"), F.col("first_id")), "left_semi", IDS_BYTES).select("text")
             .mapInArrow(_whole_sets(size), "node struct<k1:long,k2:long>, members binary"))
    sets = work.cut(texts.groupBy("node").agg(F.first("members").alias("members")))

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    confirmed = (pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
                 .mapInArrow(_confirm(percent), "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>"))
    tiled = tiled_links(crowds, sets.withColumnRenamed("members", "data"), _linked(percent), tile_rows)
    links = work.cut(confirmed.union(tiled))
    work.drop(pairs, crowds, wanted, sets)
    groups = work.cut(components(work, links))
    work.drop(links)
    labels = classes.join(groups, "node", "left").select(
        "node", "first", F.coalesce("label", "node").alias("label"))
    lowest = labels.groupBy("label").agg(F.min("first").alias("lowest"))
    named = labels.join(lowest, "label").select("node", "lowest")
    alone = F.col("n_shingles") == 0
    found = rows.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        "t", F.when(alone, F.col("t")).otherwise(F.col("lowest.t")).alias("component_t"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    return found.select(*columns, *["t", "component_t"] * keys)
