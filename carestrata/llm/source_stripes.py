"""How far the sources of a language differ in their words: exact chi-square-like divergences from merged stripes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carestrata.llm.tables import Workspace, picked

UNIT = 1_000_000_000
#: (term, source) entries that a task folds before it passes its stripes on; bounds memory only.
ENTRIES_AT_ONCE = 600_000
STRIPES_AT_ONCE = 20_000
PAIRS_AT_ONCE = 1 << 20

# a term is a run of ASCII letters and bytes from 0x80 on; everything else parts terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STRIPES = "lang string, term string, entries array<struct<source:string,n:bigint>>"
_ENTRY = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


def _stripe_rows(stripes: dict[str, dict[bytes, list]]) -> Iterator[pa.RecordBatch]:
    """Stripes as rows; the entry without a source carries the document frequency."""
    for lang, terms in stripes.items():
        items = list(terms.items())
        for at in range(0, len(items), STRIPES_AT_ONCE):
            part = items[at:at + STRIPES_AT_ONCE]
            names, counts, ends = [], [], [0]
            for _, (seen, by_source) in part:
                names.append(None)
                counts.append(seen)
                names += by_source
                counts += by_source.values()
                ends.append(len(names))
            entries = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["source", "n"])
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(part), pa.string()), pa.array([t for t, _ in part], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["lang", "term", "entries"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents into stripes: per language, term -> [documents, {source: occurrences}]."""
    stripes: dict[str, dict[bytes, list]] = {}
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            terms = stripes.setdefault(lang, {})
            for term, n in Counter(text.as_py().translate(_FOLD).split()).items():
                stripe = terms.get(term)
                if stripe is None:
                    terms[term] = [1, {source: n}]
                    held += 1
                    continue
                stripe[0] += 1
                by_source = stripe[1]
                if source in by_source:
                    by_source[source] += n
                else:
                    by_source[source] = n
                    held += 1
            if held >= ENTRIES_AT_ONCE:
                yield from _stripe_rows(stripes)
                stripes, held = {}, 0
    yield from _stripe_rows(stripes)


def merged_stripes(docs: DataFrame, least_documents: int = 3) -> DataFrame:
    """lang, term, documents, total, entries (source, n): one stripe per language and term in enough documents.

    Each task folds its documents first, so a term arrives at most once per task and spill, however often it
    occurs; the folded stripes are shuffled whole, once, and merged by key.
    """
    source = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    folded = source.mapInArrow(_fold, _STRIPES).repartition("lang", "term")
    entries = (folded.select("lang", "term", F.explode("entries").alias("e"))
               .groupBy("lang", "term", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n")))
    known = F.col("source").isNotNull()
    return (entries.groupBy("lang", "term")
            .agg(F.max(F.when(~known, F.col("n"))).alias("documents"),
                 F.sum(F.when(known, F.col("n"))).alias("total"),
                 F.collect_list(F.when(known, F.struct("source", "n"))).alias("entries"))
            .filter(F.col("documents") >= least_documents))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), in wide decimals."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    return F.call_function("div", wide(F.lit(UNIT)) * wide(count + 1), wide(total + terms)) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and pair of sources, over stripes that hold both: what the sum of their distances lacks when
    each of the two is taken as the only one that has the term. Sums are modulo 2^64, which the final sum undoes."""
    def rows(lang, names, sums):
        codes = np.fromiter(sums, np.int64, len(sums))
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(codes), pa.string()), pa.array(names).take(pa.array(codes >> 32)),
            pa.array(names).take(pa.array(codes & 0xFFFFFFFF)), pa.array(list(sums.values()), pa.int64())],
            ["lang", "source", "item", "value"])

    names: dict[str, dict[str, int]] = {}
    sums: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            part = batch.filter(pc.equal(batch.column("lang"), lang)).column("entries")
            flat, known = part.flatten(), names.setdefault(lang, {})
            local = flat.field("source").dictionary_encode()
            coded = np.array([known.setdefault(s, len(known)) for s in local.dictionary.to_pylist()], np.int64)
            source = coded[local.indices.to_numpy()]
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            ends = np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False)).astype(np.int64)
            sizes = np.diff(ends, prepend=0)
            width, start = np.repeat(sizes, sizes), np.repeat(ends - sizes, sizes)
            grown, total, at = np.cumsum(width), sums.setdefault(lang, {}), 0
            while at < len(width):
                end = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                reps = width[at:end]
                left = np.repeat(np.arange(at, end), reps)
                right = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(start[at:end], reps)
                apart = source[left] != source[right]
                left, right = left[apart], right[apart]
                a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
                more = (a - b) ** 2 // b - (a - b0) ** 2 // b0 - (a0 - b) ** 2 // b + (a0 - b0) ** 2 // b0
                codes, place = np.unique((source[left] << 32) | source[right], return_inverse=True)
                added = np.zeros(len(codes), np.int64)
                np.add.at(added, place, more)
                for code, value in zip(codes.tolist(), added.tolist()):
                    total[code] = total.get(code, 0) + value
                at = end
        if sum(map(len, sums.values())) > ENTRIES_AT_ONCE:
            for lang, total in sums.items():
                if total:
                    yield rows(lang, list(names[lang]), {k: _wrapped(v) for k, v in total.items()})
            sums = {}
    for lang, total in sums.items():
        if total:
            yield rows(lang, list(names[lang]), {k: _wrapped(v) for k, v in total.items()})


def _wrapped(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def _long(total: Column) -> Column:
    """A sum of longs that were taken modulo 2^64, as the long it stands for."""
    span = F.lit("18446744073709551616").cast("decimal(20,0)")
    least = F.lit("9223372036854775808").cast("decimal(20,0)")
    return (F.pmod(total + least, span) - least).cast("bigint")


def divergences(docs: DataFrame, least_documents: int = 3, top_terms: int = 200, lang: str = "lang",
                source: str = "source", text: str = "text") -> DataFrame:
    """How each source of a language differs from the other ones (part ``pair``) and which terms it overuses (part
    ``term``): lang, source, part, item, value, rank.

    A term is a run of letters A-Z, lower-cased, and characters beyond ASCII. Each language keeps the terms of at
    least ``least_documents`` of its documents: V terms, N occurrences in a group (language and source, or a whole
    language). The share of a term is p = 1 + floor(10^9 (n + 1) / (N + V)), and the distance of two shares
    floor((p - q)^2 / q). ``pair`` rows sum the distances to the other source over all kept terms; ``term`` rows
    hold the distance to the whole language, where the source has the term and a larger share, for the first
    ``top_terms`` ranks. Ranks go from the largest value, ties to the smaller item.

    The distances of a pair are summed without visiting terms that neither source has: were no term shared, the
    sum would follow from how many terms a source has how often; stripes that hold both sources correct it.

    Nulls count as empty strings. A group without terms has its pairs (0 where the language keeps no term) and no
    terms. Repeated rows count as documents of their own. An empty table gives an empty result; other columns are
    not read.
    """
    work = Workspace(docs.sparkSession)
    narrow = picked(docs, lang=lang, source=source, text=text)
    stripes = work.cut(merged_stripes(narrow, least_documents))
    entries = stripes.select("lang", "term", "total", F.explode("entries").alias("e")).select(
        "lang", "term", "total", "e.source", "e.n")

    groups = narrow.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    langs = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    nothing = F.lit(0).cast("bigint")
    totals = work.cut(groups.join(held, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("group_n", "kept", "lang_n")]))
    totals = totals.withColumn("p0", F.when(F.col("kept") > 0, _share(nothing, F.col("group_n"), F.col("kept"))))

    shares = entries.join(totals, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_n"), F.col("kept")))
    of_group = Window.partitionBy("lang", "source")
    terms = (shares.withColumn("q", _share(F.col("total"), F.col("lang_n"), F.col("kept"))).filter("p > q")
             .select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), F.asc("item"))))
             .filter(F.col("rank") <= top_terms))

    wide = "decimal(38,0)"
    other = totals.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    base = totals.join(other, "lang").filter(apart).select(
        "lang", "source", "item",
        F.coalesce(F.col("kept").cast("decimal(19,0)") * _distance(p0, q0).cast("decimal(19,0)"), F.lit(0)).cast(wide).alias("value"))
    # how many terms a source has with each share: few values, as counts repeat
    often = work.cut(shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n")))
    alone = often.join(other, "lang").filter(apart)
    known = F.col("n").cast("decimal(19,0)")
    forth = alone.select("lang", "source", "item", (
        known * (_distance(p, q0) - _distance(p0, q0)).cast("decimal(19,0)")).cast(wide).alias("value"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (
        known * (_distance(q0, p) - _distance(q0, p0)).cast("decimal(19,0)")).cast(wide).alias("value"))
    with_shares = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries"))
    both = (with_shares.filter(F.size("entries") > 1).select("lang", "entries")
            .mapInArrow(_corrections, "lang string, source string, item string, value bigint")
            .select("lang", "source", "item", F.col("value").cast(wide).alias("value")))
    summed = (base.union(forth).union(back).union(both).groupBy("lang", "source", "item")
              .agg(_long(F.sum("value")).alias("value")))
    pairs = summed.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), F.asc("item"))))

    def part(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return part(pairs, "pair").union(part(terms, "term"))
