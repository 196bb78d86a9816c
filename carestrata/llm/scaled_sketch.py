"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

Unlike a sketch of fixed size, the share kept is the same for short and long texts, so two sketches of very
unequal texts still estimate containment, and the sketch of a union is the union of sketches.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carestrata.llm.hashing import BASE, INVERSE, mix
from carestrata.llm.merge_replay import batches_of
from carestrata.llm.tables import same

SIZE = 8
FRACTION = 8
_powers: dict[int, np.ndarray] = {}


def _power(factor: int, n: int) -> np.ndarray:
    found = _powers.get(factor)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 20), factor, np.uint64)
        steps[0] = 1
        found = _powers[factor] = np.multiply.accumulate(steps)
    return found[:n]


def sketches(texts: list[str], size: int = SIZE, fraction: int = FRACTION) -> list[np.ndarray]:
    """Distinct 32-bit hashes of ``size`` consecutive characters below 2^32 / ``fraction``, ascending, per text.

    A shorter text is one shingle; an empty one has none.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=sums[1:])
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    stop = np.minimum(start + size, ends[owner])
    hashes = mix((sums[stop] - sums[start]) * _power(INVERSE, n + 1)[start]) >> np.uint64(32)
    low = hashes < (1 << 32) // fraction
    kept = np.unique((owner[low].astype(np.uint64) << np.uint64(32)) | hashes[low])
    cuts = np.searchsorted(kept >> np.uint64(32), np.arange(1, len(texts)))
    return [part.astype(np.uint32) for part in np.split(kept, cuts)]


def fingerprint(text: str, sketch: np.ndarray) -> str:
    """A hash of the whole text, which decides between texts too short to have a sketch, and the sketch."""
    whole = hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
    return f"{whole}:{base64.b64encode(sketch.astype('<u4').tobytes()).decode()}"


def parse(text: str) -> tuple[str, np.ndarray]:
    whole, _, sketch = text.partition(":")
    return whole, np.frombuffer(base64.b64decode(sketch), "<u4")


def merge(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The sketch of both texts together."""
    return np.union1d(first, second)


def _shared(first: np.ndarray, second: np.ndarray) -> int:
    both = np.concatenate((first, second))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def containment(first: np.ndarray, second: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has."""
    return _shared(first, second) / len(first) if len(first) else 0.0


def likeness(first: np.ndarray, second: np.ndarray, equal: bool) -> float:
    """Estimated Jaccard similarity; without any retained hash, whether the texts are equal."""
    if not len(first) and not len(second):
        return float(equal)
    shared = _shared(first, second)
    return shared / (len(first) + len(second) - shared)


def _prints(size: int, fraction: int):
    def finish(rows: list) -> pa.RecordBatch:
        """Rows (doc_id, text, next text), the next one's sketch included by position where it follows."""
        out = []
        for first, some in batches_of([text for _, text, _ in rows], 1 << 20):
            group = rows[first:first + len(some)]
            edited = []
            for _, text, after in group:
                half = len(text) // 2
                edited.append(text[:len(text) - half] + after[:half])
            afters = [after for _, _, after in group]
            # most next texts are the following row's own text
            fresh = [i for i in range(len(group)) if i + 1 == len(group) or group[i + 1][1] is not afters[i]]
            found = sketches(some + edited + [afters[i] for i in fresh], size, fraction)
            n = len(group)
            later = dict(zip(fresh, found[2 * n:]))
            for i, (doc_id, text, after) in enumerate(group):
                own, other = found[i], found[n + i]
                following = later[i] if i in later else found[i + 1]
                out.append((doc_id, len(text), hashlib.sha256(edited[i].encode()).hexdigest(),
                            fingerprint(text, own), fingerprint(edited[i], other),
                            likeness(own, other, text == edited[i]), likeness(own, following, text == after)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], NAMES)

    def run(batches):
        before = None
        for batch in batches:
            rows = []
            ids, texts, buckets, heads = (batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "head"))
            for doc_id, text, bucket, head in zip(ids, texts, buckets, heads):
                text = text or ""
                if before is not None and before[2] == bucket:
                    rows.append((before[0], before[1], text))
                before = None if head else (doc_id, text, bucket)
            if rows:
                yield finish(rows)
    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, size: int = SIZE,
                 fraction: int = FRACTION, range_rows: int = 4096, most_ranges: int = 4096) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next
    document by doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next: estimated Jaccard similarities of the texts' shingles.

    A null text is empty. Rows with one doc_id follow each other in order of a hash of their text; null doc_ids
    come last. A table of one row is its own next. An empty table gives an empty result; other columns are
    ignored. Documents are dealt to ranges of doc_id (``most_ranges`` at most, by approximate quantiles) and
    sorted there; only the first row of each range is sent to the range before it, so texts are shuffled once.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("t"))
    ranges = min(max(source.count() // range_rows, 1), most_ranges)
    bounds = sorted(set(source.select(F.col("doc_id").cast("double")).approxQuantile(
        "doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    if bounds:
        dealt = (Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="as_double", outputCol="b",
                            handleInvalid="keep")
                 .transform(source.withColumn("as_double", F.col("doc_id").cast("double")))
                 .withColumn("bucket", F.col("b").cast("int")).drop("b", "as_double"))
    else:
        dealt = source.withColumn("bucket", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    lowest = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("first"))
    order = Window.orderBy("bucket")
    around = Window.partitionBy(F.lit(0))
    heads = lowest.select(  # as many rows as ranges
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(around)).alias("goes_to"),
        F.col("bucket").alias("of"), F.col("first.doc_id").alias("h_id"), F.col("first.t").alias("h_t"))
    firsts = (dealt.join(F.broadcast(heads), same(F.col("doc_id"), F.col("h_id")) & (F.col("t") == F.col("h_t"))
                         & (F.col("bucket") == F.col("of")))
              .dropDuplicates(["goes_to"])
              .select("doc_id", "text", "t", F.col("goes_to").alias("bucket"), F.lit(True).alias("head")))
    ordered = (dealt.select("doc_id", "text", "t", "bucket", F.lit(False).alias("head")).union(firsts)
               .repartition(ranges, "bucket")
               .sortWithinPartitions("bucket", "head", F.col("doc_id").asc_nulls_last(), "t"))
    return ordered.select("doc_id", "text", "bucket", "head").mapInArrow(
        _prints(size, fraction), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
