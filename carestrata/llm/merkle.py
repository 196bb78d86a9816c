"""A manifest of a dataset as Merkle trees, with a proof for every row found by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carestrata.llm.tables import Workspace, picked

#: Levels of a tree that one task works out over its leaves at once: blocks of at most 2 ** LEVELS_AT_ONCE nodes.
LEVELS_AT_ONCE = 10
#: Trees whose subroots (under 100 bytes each) are joined in place; beyond it they are joined by shuffle.
TREES_IN_PLACE = 50_000
TOP = -1

_PAYLOAD = "doc_id", "leaf", "tampered"


def _field(column: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    fields = [_field(c) for c in (doc_id, source, lang, n_chars, text)]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def _placed(work: Workspace, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree and position, and the trees (tree, lang, size), numbered by language.

    The leaves are range-partitioned by language and doc_id together, so a language of any size is spread; a
    leaf's position is its place in its partition plus what earlier partitions hold of its language.
    """
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    placed = work.cut(leaves.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    cells = placed.groupBy("lang", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    cells = work.cut(cells)
    trees = cells.groupBy("lang").agg(F.sum("n").alias("size"))
    trees = work.cut(trees.withColumn("tree", F.row_number().over(Window.orderBy(F.asc_nulls_first("lang"))) - 1))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col("lang").alias("cell_lang"), F.col("part").alias("cell_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    offsets = offsets.join(trees, F.col("lang").eqNullSafe(F.col("cell_lang"))).drop("lang")
    on = F.col("lang").eqNullSafe(F.col("cell_lang")) & (part == F.col("cell_part"))
    rows = placed.join(offsets, on).select(
        "tree", "size", (F.col("place") + F.col("shift")).alias("pos"), F.col("leaf").alias("hash"), *_PAYLOAD)
    return rows, trees


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree: 0 for a lone leaf."""
    return F.when(size == 1, 0).otherwise(F.length(F.bin(size - 1)))


def _hash_pair(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256(left.hex().encode() + (right.hex().encode() if right is not None else b"")).digest()


def _block(levels: int):
    """Hash a block of consecutive nodes of one tree and level upwards.

    Gives the nodes of the block, each with its run's other node and the ``side`` (L, R, or - for none) where that
    one stands, and last the block's top, whose side is null.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, size, level = (table.column(c)[0].as_py() for c in ("tree", "size", "level"))
        pos, nodes = table.column("pos")[0].as_py(), table.column("hash").to_pylist()
        made = {c: [] for c in ("level", "pos", "hash", "side", "sibling")}

        def give(sides: list, siblings: list) -> None:
            n = len(nodes)
            for c, values in (("level", [level] * n), ("pos", range(pos, pos + n)), ("hash", nodes), ("side", sides),
                              ("sibling", siblings)):
                made[c] += values

        for _ in range(levels):
            if size <= 1 << level:  # the tree ends here
                break
            others = [nodes[i ^ 1] if i ^ 1 < len(nodes) else None for i in range(len(nodes))]
            give(["-" if o is None else "L" if i & 1 else "R" for i, o in enumerate(others)], others)
            nodes = [_hash_pair(nodes[i], others[i]) for i in range(0, len(nodes), 2)]
            level, pos = level + 1, pos >> 1
        give([None] * len(nodes), [None] * len(nodes))

        n, own = len(made["pos"]), table.num_rows
        columns = {"tree": pa.array([tree] * n, pa.int32()), "size": pa.array([size] * n, pa.int64()),
                   "level": pa.array(made["level"], pa.int32()), "pos": pa.array(made["pos"], pa.int64()),
                   "hash": pa.array(made["hash"], pa.binary()), "side": pa.array(made["side"], pa.string()),
                   "sibling": pa.array(made["sibling"], pa.binary())}
        for c in _PAYLOAD:  # of the given nodes, which come first
            given = table.column(c).combine_chunks()
            columns[c] = pa.concat_arrays([given, pa.nulls(n - own, given.type)])
        return pa.table(columns)

    return run


def _grown(work: Workspace, leaves: DataFrame, largest: int, levels: int) -> DataFrame:
    """All nodes of the trees over the given leaves, with side and sibling; the tops of trees have no side.

    Each pass hashes blocks of 2 ** levels nodes, and the blocks' tops are the nodes of the next one.
    """
    doc_type = leaves.schema["doc_id"].dataType.simpleString()
    schema = ("tree int, size bigint, level int, pos bigint, hash binary, side string, sibling binary, "
              f"doc_id {doc_type}, leaf binary, tampered binary")
    given, level, parts = leaves.withColumn("level", F.lit(0)), 0, []
    done = F.col("side").isNotNull() | (F.col("level") == _height(F.col("size")))
    while True:
        made = work.cut(given.select("tree", "size", "level", "pos", "hash", *_PAYLOAD,
                                     F.shiftright("pos", levels).alias("block"))
                        .groupBy("tree", "block").applyInArrow(_block(levels), schema))
        parts.append(made.filter(done))
        level += levels
        if largest <= 1 << level:
            break
        given = made.filter(~done)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


_HERE = "tree", "level", "pos"
_AWAY = "a_tree", "a_level", "a_pos"
#: In place of an ancestor's tree: the root is reached.
_ROOT = -2


def _pointers(nodes: DataFrame, top_height: int) -> DataFrame:
    """Each node (the root left out) with its parent and the segment towards it: ``sides`` and ``siblings``.

    The top of a tree is, under the name (TOP, 0, number of the tree), a leaf of the tree over the subroots. A tree's
    lone leaf points there with an empty segment.
    """
    tree, height = F.col("tree"), _height(F.col("size"))
    lone = F.col("side").isNull()
    above = F.col("level") + F.when(lone, 0).otherwise(1)
    top = F.when(tree == TOP, above == top_height).otherwise((above == height) & F.lit(top_height == 0))
    crosses = (tree != TOP) & (above == height)
    return nodes.filter(F.col("side").isNotNull() | ((F.col("level") == 0) & (tree != TOP))).select(
        *_HERE, *_PAYLOAD,
        F.when(top, _ROOT).when(crosses, TOP).otherwise(tree).alias("a_tree"),
        F.when(top | crosses, 0).otherwise(above).cast("int").alias("a_level"),
        F.when(top, F.col("pos")).when(crosses, tree.cast("bigint")).otherwise(F.shiftright("pos", 1)).alias("a_pos"),
        F.coalesce("side", F.lit("")).alias("sides"),
        F.coalesce("sibling", F.lit(b"")).alias("siblings"))


def _jumped(rows: DataFrame, far: DataFrame) -> DataFrame:
    """Every pointer on by the pointer of the node it points to. Rows at the root keep a key of their own each, so
    they do not meet in one task."""
    onward = far.select(*[F.col(h).alias(f"r_{a}") for h, a in zip(_HERE, _AWAY)],
                        *[F.col(a).alias(f"n_{a}") for a in _AWAY],
                        F.col("sides").alias("n_sides"), F.col("siblings").alias("n_siblings"))
    met = rows.join(onward, [F.col(a) == F.col(f"r_{a}") for a in _AWAY], "left")
    kept = [c for c in rows.columns if c not in (*_AWAY, "sides", "siblings")]
    return met.select(
        *kept, F.coalesce("n_a_tree", "a_tree").alias("a_tree"), F.coalesce("n_a_level", "a_level").alias("a_level"),
        F.when(F.col("n_a_tree") == _ROOT, F.col("pos")).otherwise(F.coalesce("n_a_pos", "a_pos")).alias("a_pos"),
        F.concat("sides", F.coalesce("n_sides", F.lit(""))).alias("sides"),
        F.concat("siblings", F.coalesce("n_siblings", F.lit(b""))).alias("siblings"))


def _proven(work: Workspace, pointers: DataFrame, depth: int) -> DataFrame:
    """The leaves with their whole proofs.

    Each round doubles the distance d of the pointers. The leaves jump from nodes of level d, and doubling those
    takes only levels that d divides, so the inner nodes in use fall from half the leaves to a quarter, a
    sixteenth, ... while their segments double.
    """
    leaves = pointers.filter((F.col("level") == 0) & (F.col("tree") != TOP))
    inner = pointers.filter((F.col("level") > 0) | (F.col("tree") == TOP)).drop(*_PAYLOAD)
    d = 1
    while d < depth:
        leaves = _jumped(leaves, inner.filter((F.col("level") == d) | (F.col("tree") == TOP)))
        d *= 2
        if d < depth:
            used = inner.filter((F.col("level") % d == 0) | (F.col("tree") == TOP))
            inner = work.cut(_jumped(used, inner))
    return leaves


def _fold(root: bytes):
    """Fold each tampered (else original) leaf along its siblings, and take the digest of the proof."""
    def climbed(node: bytes, sides: str, siblings: bytes) -> bytes:
        at = 0
        for side in sides:
            if side == "-":
                node = _hash_pair(node, None)
                continue
            other, at = siblings[at:at + 32], at + 32
            node = _hash_pair(other, node) if side == "L" else _hash_pair(node, other)
        return node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, sides, siblings = (batch.column(c).to_pylist() for c in ("leaf", "sides", "siblings"))
            tampered = [t if t is not None else x for t, x in zip(batch.column("tampered").to_pylist(), leaves)]
            folded = [climbed(*x) for x in zip(tampered, sides, siblings)]
            text = pa.string()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x.hex() for x in leaves], text),
                pa.array([x.hex() for x in batch.column("subroot").to_pylist()], text),
                pa.array([root.hex()] * len(leaves), text),
                pa.array([hashlib.sha256(s.hex().encode()).hexdigest() for s in siblings], text),
                pa.array([x.hex() for x in folded], text), pa.array([x == root for x in folded], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest(docs: DataFrame, tampered_n_chars: Column | None = None, levels: int = LEVELS_AT_ONCE,
             doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
             text: str = "text") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are the leaves of one binary tree per language, in order of doc_id; the subroots, in order of the
    languages (null first), are the leaves of a tree above them. A last node without a partner is hashed alone. A
    row's proof lists the siblings from leaf to root; ``folded_root`` folds the row as it is claimed to be (its
    ``n_chars`` replaced by ``tampered_n_chars`` where that differs) along its proof, and ``verified`` tells whether
    the root comes out.

    Texts are read once, for their leaves; all later work is on digests. Only the root and the number and size of
    the trees reach the driver.

    Nulls are hashed as ``-``; a null language is a tree of its own, null doc_ids come first. Rows that share a
    doc_id are ordered by their leaf, so repeated rows are neighbours with equal leaves and proofs of their own. An
    empty table gives an empty result; other columns are not read.
    """
    work = Workspace(docs.sparkSession)
    rows = picked(docs, doc_id=doc_id, source=source, lang=lang, n_chars=n_chars, text=text)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    result = (f"doc_id {doc_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    tampered = F.lit(None).cast("binary")
    if tampered_n_chars is not None:
        claimed = columns[:3] + [tampered_n_chars] + columns[4:]
        tampered = F.when(~tampered_n_chars.eqNullSafe(F.col("n_chars")), leaf_digest(*claimed))
    leaves, trees = _placed(work, work.cut(rows.select(
        "lang", "doc_id", leaf_digest(*columns).alias("leaf"), tampered.alias("tampered"))))
    count, largest = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    if not count:
        return docs.sparkSession.createDataFrame([], result)

    nodes = _grown(work, leaves, largest, levels)
    subroots = nodes.filter(F.col("side").isNull()).select("tree", F.col("hash").alias("subroot"))
    over = subroots.select(F.lit(TOP).alias("tree"), F.lit(count).cast("bigint").alias("size"), F.col("tree").cast("bigint").alias("pos"),
                           F.col("subroot").alias("hash"), *[F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in _PAYLOAD])
    above = _grown(work, over, count, levels)
    root = bytes(above.filter(F.col("side").isNull()).first()["hash"])

    top_height = (count - 1).bit_length()
    depth = max((largest - 1).bit_length() + top_height, top_height + 1)
    proven = _proven(work, _pointers(nodes.union(above), top_height), depth)
    # a language may hold most of the rows, so its leaves are not gathered for the sake of one subroot
    return proven.join(F.broadcast(subroots) if count <= TREES_IN_PLACE else subroots, "tree").select("doc_id", "leaf", "tampered", "sides", "siblings", "subroot").mapInArrow(
        _fold(root), result)
