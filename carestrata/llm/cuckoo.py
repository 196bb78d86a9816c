"""Exact duplicates by an index of live digests: cuckoo filters per shard, hits verified against what their bucket holds."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from carestrata.llm.tables import Workspace, picked

SLOTS = 4
MOST_MOVES = 200
FIRST_BUCKETS = 64
#: Texts that a shard of the index holds on the average.
SHARD_TEXTS = 50_000

_UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class CuckooIndex:
    """Live digests of one shard.

    The filter keeps a 16-bit print of each digest in one of two buckets of four slots; the content (digest ->
    value) lies beside it, bucketed by the print and the lower of its two buckets. A digest whose print is in
    neither bucket is new; one whose print is there is compared with the bucketed content. A print that finds no
    slot within ``MOST_MOVES`` moves doubles the buckets, and the filter is filled again from the stored digests.
    Only where the filter is nearly empty, so that more buckets would not help (over eight digests of one print
    and bucket), the print goes to a stash that every lookup reads.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.resizes = 0
        self.size = 0
        self.random = random.Random(7)
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]
        self.stash: list[int] = []
        self.content: dict[tuple[int, int], dict[bytes, object]] = {}

    def _other(self, bucket: int, mark: int) -> int:
        # an involution: the other bucket of the other bucket is the first
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & self.mask

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        # the shard is chosen by the first eight bytes, so the print and bucket come from later ones
        mark = int.from_bytes(digest[8:10], "little") or 1
        bucket = int.from_bytes(digest[10:18], "little") & self.mask
        return mark, bucket, self._other(bucket, mark)

    def get(self, digest: bytes):
        """The value of a live digest, or None."""
        mark, one, two = self._places(digest)
        if mark not in self.slots[one] and mark not in self.slots[two] and mark not in self.stash:
            return None
        return self.content.get((min(one, two), mark), {}).get(digest)

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        mark, one, two = self._places(digest)
        self.content.setdefault((min(one, two), mark), {})[digest] = value
        self.size += 1
        if (left := self._put(mark, one, two)) is not None:
            self._grow(left)

    def _put(self, mark: int, one: int, two: int) -> int | None:
        """Store a print; the print that is left over if there is no slot within the moves."""
        for bucket in (one, two):
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return None
        bucket = self.random.choice((one, two))
        for _ in range(MOST_MOVES):
            at = self.random.randrange(SLOTS)
            mark, self.slots[bucket][at] = self.slots[bucket][at], mark
            bucket = self._other(bucket, mark)
            if len(self.slots[bucket]) < SLOTS:
                self.slots[bucket].append(mark)
                return None
        return mark

    def _grow(self, left: int) -> None:
        buckets = len(self.slots)
        if 8 * self.size < SLOTS * buckets:
            self.stash.append(left)
            return
        stored = list(self.items())
        self.resizes += 1
        self._empty(buckets * 2)
        for digest, value in stored:
            mark, one, two = self._places(digest)
            self.content.setdefault((min(one, two), mark), {})[digest] = value
        for digest, _ in stored:
            if (left := self._put(*self._places(digest))) is not None:
                self._grow(left)
                if len(self.slots) > buckets * 2:  # it has been filled on the way
                    return

    def delete(self, digest: bytes):
        """Take a live digest out and return its value; None if it is not live."""
        mark, one, two = self._places(digest)
        held = self.content.get((min(one, two), mark), {})
        if digest not in held:
            return None
        value = held.pop(digest)
        if not held:
            del self.content[min(one, two), mark]
        next(held for held in (self.slots[one], self.slots[two], self.stash) if mark in held).remove(mark)
        self.size -= 1
        return value

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content.values():
            yield from held.items()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        digests = [hashlib.sha256((t.as_py() or b"").translate(_UPPER_TO_LOWER)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and digest (sha256 of the text with A-Z lower-cased) of every row; a null text counts as empty."""
    narrow = picked(docs, doc_id=doc_id, text=text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_digest, f"doc_id {kind}, digest binary")


def _live_rows(shard: int, index: CuckooIndex, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = [{"shard": shard, "digest": digest, "members": n, "keep_id": best[0], "keep_row": best[1]}
            for digest, (n, best) in index.items()]
    for at in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_pylist(rows[at:at + 20_000], schema)


def _apply(doc_type: pa.DataType, buckets: int):
    """Play the changes of each shard, in order, against its index; gives the live rows."""
    schema = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("members", pa.int64()),
                        ("keep_id", doc_type), ("keep_row", pa.int64())])

    def rank(best):
        return (best[0] is not None, best[0] if best[0] is not None else 0, best[1] if best[1] is not None else -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, CuckooIndex(buckets)
        for batch in batches:
            for shard, digest, n, doc_id, row in zip(*[batch.column(c).to_pylist() for c in (
                    "shard", "digest", "members", "keep_id", "keep_row")]):
                if shard != current:
                    if current is not None:
                        yield from _live_rows(current, index, schema)
                    current, index = shard, CuckooIndex(buckets)
                best, old = (doc_id, row), index.get(digest)
                if old is None:
                    if n > 0:
                        index.insert(digest, (n, best))
                    continue
                members, leader = index.delete(digest)
                if n < 0:  # a leader that goes leaves its place open: (None, None)
                    leader = (None, None) if leader[0] == doc_id or leader == (None, None) else leader
                elif rank(leader) < rank(best):
                    leader = best
                if members + n > 0:
                    index.insert(digest, (members + n, leader))
        if current is not None:
            yield from _live_rows(current, index, schema)

    return run


def _shards(rows: int, shard_texts: int) -> int:
    return max(1, -(-rows // shard_texts))


def _played(changes: DataFrame, order: str, shards: int, buckets: int) -> DataFrame:
    kind = changes.schema["keep_id"].dataType
    word = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")
    dealt = (changes.withColumn("shard", (word % shards).cast("int")).repartition(F.col("shard"))
             .sortWithinPartitions("shard", order, F.asc_nulls_first("keep_id"), "keep_row")
             .select("shard", "digest", "members", "keep_id", "keep_row"))
    return dealt.mapInArrow(_apply(to_arrow_type(kind), buckets),
                            f"shard int, digest binary, members bigint, keep_id {kind.simpleString()}, keep_row bigint")


def _partials(known: DataFrame) -> DataFrame:
    """One change per digest: combined before the shuffle, so copies of one text are a row per task."""
    return known.groupBy("digest").agg(
        F.count(F.lit(1)).alias("members"), F.max(F.struct("doc_id", "row")).alias("best")).select(
        "digest", "members", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))


def build_index(known: DataFrame, shards: int, buckets: int = FIRST_BUCKETS) -> DataFrame:
    """The live digests (shard, digest, members, keep_id, keep_row) of rows (doc_id, row, digest)."""
    return _played(_partials(known).withColumn("at", F.lit(0)), "at", shards, buckets)


def update_index(work: Workspace, index: DataFrame, shards: int, rest: DataFrame, added: DataFrame | None = None,
                 removed: DataFrame | None = None, buckets: int = FIRST_BUCKETS) -> DataFrame:
    """The index after documents were added and removed.

    ``index`` is a written result of :func:`build_index` or of this function over as many ``shards``; ``added`` and
    ``removed`` hold (doc_id, row, digest), ``rest`` all documents that stand afterwards. Shards load their stored
    digests, then play additions, then removals. Where the keeper of a text goes and copies stay, the largest
    doc_id among ``rest`` follows; only those digests are looked up there.
    """
    parts = [index.drop("shard").withColumn("at", F.lit(0))]
    if added is not None:
        parts.append(_partials(added).withColumn("at", F.lit(1)))
    if removed is not None:
        parts.append(removed.select("digest", F.lit(-1).cast("bigint").alias("members"), F.col("doc_id").alias("keep_id"),
                                    F.col("row").alias("keep_row"), F.lit(2).alias("at")))
    changes = parts[0]
    for part in parts[1:]:
        changes = changes.unionByName(part)
    played = work.cut(_played(changes, "at", shards, buckets))
    open_ = played.filter(F.col("keep_row").isNull())
    heirs = _partials(rest.join(open_.select("digest"), "digest", "left_semi")).drop("members")
    return played.filter(F.col("keep_row").isNotNull()).unionByName(
        open_.drop("keep_id", "keep_row").join(heirs, "digest"))


def exact_duplicates(docs: DataFrame, shard_texts: int = SHARD_TEXTS, buckets: int = FIRST_BUCKETS,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the largest doc_id
    stays. The index is sharded by digest. In a shard each text comes as one change at most per task (a text
    in a third of all rows is no hot key), and is verified by its whole digest (256 bits) where its print hits.

    A null text counts as empty. A null doc_id is smaller than any other; keep_id is null only where all rows of
    a text have none. Of rows that share text and doc_id one stays. An empty table gives an empty result. Other
    columns are not read.
    """
    work = Workspace(docs.sparkSession)
    known = work.cut(digests(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    index = work.cut(build_index(known, _shards(known.count(), shard_texts), buckets))
    several = index.filter("members > 1").select(F.col("digest").alias("d"), "members", "keep_id", "keep_row")
    found = known.join(several, F.col("digest") == F.col("d"), "left")
    alone = F.col("members").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
