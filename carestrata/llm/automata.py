"""Repeated passages across documents, found with suffix automata over shards of reference text.

The reference is the corpus itself, so it is not broadcast whole. Winnowed anchors (a minimum of hashed word
groups in every window of the wanted length) tell which stretches of text can repeat at all; each such stretch
is sent to the shard that owns its anchors. A shard reads its stretches in document order: the automaton of
what came earlier yields matching statistics, spans at or above the length are removed, and only what is new
is added to the automaton. Shards with very much text are read in parts, each by its own automaton; windows that
are new in several parts meet under a hash of their words, and the first of each stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.llm import hashing, memory
from carestrata.llm.tables import Workspace, joined, same

ANCHOR = 5
RUNS = "doc_id long, t long, start int, stop int, fresh boolean, shard int, words binary"


class Automaton:
    """A suffix automaton over several runs of words that tells which windows of a run it has seen before."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, p: int, q: int, word: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        following, link, length = self.next, self.link, self.length
        q = following[last].get(word)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        state = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in following[p]:
            following[p][word] = state
            p = link[p]
        if p != -1:
            q = following[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return state

    def seen(self, words: list, add: bool = False) -> list[int]:
        """Starts of windows that occurred before; with ``add`` the run itself joins, word by word."""
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = last = 0
        found = []
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            if word in following[state]:
                state = following[state][word]
                matched += 1
                if matched >= window:
                    found.append(i - window + 1)
            if add:
                last = self._extend(last, word)
                while state and matched <= length[link[state]]:
                    state = link[state]
        return found

    def read(self, words: list) -> list[int]:
        """Starts of windows seen before this run or earlier in it; afterwards the run's windows are known."""
        found = self.seen(words)
        known, count = set(found), len(words) - self.window + 1
        start = 0
        while start < count:
            if start in known:
                start += 1
                continue
            stop = start
            while stop < count and stop not in known:
                stop += 1
            found += [start + i for i in self.seen(words[start:stop + self.window - 1], add=True)]
            start = stop
        return sorted(found)


def ranges(starts) -> list[tuple[int, int]]:
    """Consecutive numbers as (first, one past the last)."""
    starts = np.asarray(starts, np.int64)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + 1).tolist()))


def _anchors(window: int):
    span = window - ANCHOR + 1

    def run(batches):
        memory.give_back()
        for batch in batches:
            for row, data, offsets in hashing.pieces(batch.column(2)):
                starts, ends, first = hashing.words(data, offsets)
                word = hashing.hash_spans(data, starts, ends)
                texts = len(offsets) - 1
                counts = np.diff(first)
                grams = hashing.shingles(word, ANCHOR)
                k = np.zeros((2, texts), np.uint64)
                full = np.flatnonzero(counts)
                if len(full):
                    place = (np.arange(len(word)) - np.repeat(first[:-1], counts)).astype(np.uint64)
                    place *= np.uint64(hashing.BASE)
                    k[0, full] = np.add.reduceat(hashing.mix(word + place), first[:-1][full])
                    k[1, full] = np.add.reduceat(hashing.mix(word ^ hashing.mix(place)), first[:-1][full])
                chosen, per_text = [], np.zeros(texts, np.int64)
                for i in np.flatnonzero(counts >= window).tolist():
                    own = grams[first[i]:first[i] + counts[i] - ANCHOR + 1]
                    views = np.lib.stride_tricks.sliding_window_view(own, span)
                    least = np.unique(views.argmin(axis=1) + np.arange(len(views)))
                    chosen.append(first[i] + least)
                    per_text[i] = len(least)
                at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                lists = np.r_[0, np.cumsum(per_text)].astype(np.int32)
                places = (at - np.repeat(first[:-1], per_text)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, texts).cast(pa.int64()), batch.column(1).slice(row, texts),
                    pa.array(counts), pa.array(k[0].view(np.int64)), pa.array(k[1].view(np.int64)),
                    pa.ListArray.from_arrays(lists, pa.array(hashing.signed(grams[at]))),
                    pa.ListArray.from_arrays(lists, pa.array(places)),
                ], ["doc_id", "t", "n_words", "k1", "k2", "hashes", "places"])
    return run


def _stretches(window: int):
    """Words around the anchors of each document, per shard: everything a repeated window can cover."""
    def run(batches):
        for batch in batches:
            texts, targets = batch.column(2), batch.column(3).to_pylist()
            for row, data, offsets in hashing.pieces(texts):
                starts, ends, first = hashing.words(data, offsets)
                word = hashing.hash_spans(data, starts, ends)
                out = []
                for i in range(len(offsets) - 1):
                    own = word[first[i]:first[i + 1]]
                    for target in targets[row + i]:
                        places = np.unique(np.array(target["places"], np.int64))
                        lo = np.maximum(places - (window - ANCHOR), 0)
                        hi = np.minimum(places + window, len(own))
                        breaks = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1])
                        for s, e in zip(lo[np.r_[0, breaks + 1]].tolist(), hi[np.r_[breaks, len(hi) - 1]].tolist()):
                            out.append((row + i, target["shard"], target["part"], s, own[s:e].tobytes()))
                rows, shard, part, start, binary = zip(*out) if out else ((), (), (), (), ())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(shard, pa.int32()),
                    pa.array(part, pa.int32()), pa.array(start, pa.int32()), pa.array(binary, pa.binary()),
                ], ["doc_id", "t", "shard", "part", "start", "words"])
    return run


def _read_shard(window: int):
    def run(group: pa.Table) -> pa.Table:
        ids, texts, starts = (group.column(c).to_pylist() for c in ("doc_id", "t", "start"))
        shard, binary = group.column("shard")[0].as_py(), group.column("words")
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i], starts[i]))
        automaton, out, before = Automaton(window), [], None
        for i in order:
            if before == (ids[i], texts[i], starts[i]):  # the same stretch of a repeated row
                continue
            before = ids[i], texts[i], starts[i]
            words = np.frombuffer(binary[i].as_buffer(), np.int64)
            found = automaton.read(words.tolist())
            new = np.setdiff1d(np.arange(max(len(words) - window + 1, 0)), found, assume_unique=True)
            for s, e in ranges(found):
                out.append((ids[i], texts[i], starts[i] + s, starts[i] + e + window - 1, False, shard, None))
            for s, e in ranges(new):
                out.append((ids[i], texts[i], starts[i] + s, starts[i] + e + window - 1, True, shard,
                            words[s:e + window - 1].tobytes()))
        names = ["doc_id", "t", "start", "stop", "fresh", "shard", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
        columns = zip(*out) if out else [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    return run


def _windows(window: int):
    """Every window of the runs under a 128-bit hash of its words; a part has a window at most once."""
    def run(batches):
        for batch in batches:
            binary = batch.column(4)
            words = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in binary] or [np.zeros(0, np.uint64)])
            ends = np.cumsum([len(b.as_buffer()) // 8 for b in binary], dtype=np.int64)
            begins = np.r_[0, ends[:-1]] if len(ends) else ends
            counts = np.maximum(ends - begins - window + 1, 0)
            take = np.repeat(np.arange(batch.num_rows), counts)
            place = np.arange(len(take)) - np.repeat(np.cumsum(counts) - counts, counts)
            at, rows = begins[take] + place, pa.array(take)
            keys = [hashing.signed(hashing.shingles(w, window)[at]) for w in (words, hashing.mix(words ^ np.uint64(hashing.BASE)))]
            start = batch.column(2).to_numpy()[take] + place
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)),
                 batch.column(3).take(rows), pa.array(keys[0]), pa.array(keys[1])],
                ["doc_id", "t", "start", "shard", "k1", "k2"])
    return run


def _cut(batches):
    memory.give_back()
    for batch in batches:
        texts, whole, spans = batch.column("text"), batch.column("copied"), batch.column("spans")
        counts, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode().split()
            gone = bool(whole[i].as_py())
            counts.append(len(words))
            if gone:
                removed.append(len(words))
                kept.append("")
                continue
            stay, at = [], 0
            for span in sorted((s["start"], s["stop"]) for s in spans[i].as_py() or ()):
                stay += words[at:span[0]]
                at = max(at, span[1])
            stay += words[at:]
            removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.string()), batch.column("row")],
            ["doc_id", "n_words", "n_removed", "kept_text", "row"])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, window: int = 20,
                   shard_words: int = 200_000, carry: list[str] | None = None) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose sequence also starts earlier.

    Earlier means a smaller doc_id (null is smallest) or an earlier start in the same document; windows are judged on the input.
    Words are runs of bytes other than space and 0x09-0x0D. Returns one row per input row: doc_id, n_words,
    n_removed, kept_text (kept words joined by one space), and ``row``, a struct of the ``carry`` columns.

    Texts that are null, empty or white space have no words; texts below ``window`` words lose nothing. Among
    rows with one doc_id, different texts count as different documents in order of a hash of the text, and
    repeated rows as one document. An empty table gives an empty result.

    A document whose whole word sequence came earlier loses all its windows and takes no further part, so
    groups of copies cost one document. ``shard_words`` bounds the text an automaton is meant to hold; shards
    beyond it are read in parts, and no task reads all parts of one.
    """
    work = Workspace(docs.sparkSession)
    source = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("t"), docs[text].alias("text"),
                         F.struct(*[docs[c].alias(c) for c in carry or [doc_id]]).alias("row"))
    rows = work.cut(source.select("doc_id", "t", "text").mapInArrow(
        _anchors(window), "doc_id long, t long, n_words long, k1 long, k2 long, hashes array<long>, places array<int>"))
    keyed = rows.select("doc_id", "t", "n_words", "k1", "k2")
    firsts = keyed.filter(F.col("n_words") >= window).groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "t")).alias("first"))
    copies = work.cut(keyed.join(firsts, ["k1", "k2"]).filter(
        ~same(F.col("doc_id"), F.col("first.doc_id")) | (F.col("t") != F.col("first.t")))
        .select("doc_id", "t").distinct())

    anchors = rows.select("doc_id", "t", "k1", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select(
        F.col("x.hashes").alias("h"), "doc_id", "t", F.col("x.places").alias("place"),
        F.xxhash64("k1", "x.places").alias("u"))
    repeated = anchors.groupBy("h").agg(
        F.min(F.struct("doc_id", "t")).alias("owner"), F.min("u").alias("lo"), F.max("u").alias("hi")
    ).filter("lo != hi").select("h", F.xxhash64("owner").alias("owner"))
    found = work.cut(
        anchors.select("h", "doc_id", "t", "place").join(repeated, "h")
        .groupBy("doc_id", "t", "owner").agg(F.collect_set("place").alias("places")))
    marked = copies.select(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t"))
    found = found.join(marked, same(F.col("doc_id"), F.col("c_id")) & (F.col("t") == F.col("c_t")), "left_anti")

    # an anchor stands for about half a winnowing window of words
    weight = F.size("places") * F.lit((window - ANCHOR + 1) // 2) + F.lit(window)
    total = found.agg(F.sum(weight)).first()[0] or 0
    shards = max(1, -(-int(total) // (shard_words // 2)))
    placed = (found.withColumn("shard", F.pmod("owner", F.lit(shards)).cast("int")).withColumn("weight", weight)
              .groupBy("doc_id", "t", "shard").agg(
                  F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.sum("weight").alias("weight")))
    placed = work.cut(placed)
    parts = placed.groupBy("shard").agg(F.ceil(F.sum("weight") / (2 * shard_words)).cast("int").alias("parts"))
    targets = work.cut(
        placed.join(parts, "shard")
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "t"), F.col("parts")).cast("int"))
        .groupBy(F.col("doc_id").alias("d_id"), F.col("t").alias("d_t"))
        .agg(F.collect_list(F.struct("shard", "part", "places")).alias("targets")))
    stretches = joined(source.select("doc_id", "t", "text"), targets,
                       same(F.col("doc_id"), F.col("d_id")) & (F.col("t") == F.col("d_t")), "inner")
    pieces = stretches.select("doc_id", "t", "text", "targets").mapInArrow(
        _stretches(window), "doc_id long, t long, shard int, part int, start int, words binary")
    local = work.cut(pieces.groupBy("shard", "part").applyInArrow(_read_shard(window), RUNS))
    crowded = parts.filter("parts > 1").select("shard")
    windows = (local.filter("fresh").join(crowded, "shard", "left_semi").select("doc_id", "t", "start", "shard", "words")
               .mapInArrow(_windows(window), "doc_id long, t long, start int, shard int, k1 long, k2 long"))
    here, key = F.struct("doc_id", "t", "start"), ["shard", "k1", "k2"]
    several = windows.groupBy(*key).agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    across = windows.join(several, key).filter(~same(here, F.col("first")))
    covered = local.filter("not fresh").select("doc_id", "t", "start", "stop").union(
        across.select("doc_id", "t", "start", F.col("start") + F.lit(window)))
    verdicts = work.cut(
        covered.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
        .select(F.col("doc_id").alias("d_id"), F.col("t").alias("d_t"), "spans", F.lit(False).alias("copied"))
        .union(copies.select("doc_id", "t", F.lit(None).cast("array<struct<start:int,stop:int>>"), F.lit(True))))
    whole = joined(source, verdicts, same(F.col("doc_id"), F.col("d_id")) & (F.col("t") == F.col("d_t")), "left")
    row_type = source.schema["row"].dataType.simpleString()
    return whole.select("doc_id", "text", "copied", "spans", "row").mapInArrow(
        _cut, f"doc_id long, n_words long, n_removed long, kept_text string, row {row_type}")
