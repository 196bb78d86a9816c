"""Source divergences, exact duplicates and the manifest: registered queries against their twins, small cases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carestrata.llm import cuckoo, memory, merkle, source_stripes
from carestrata.llm.queries import ORACLE, QUERIES
from carestrata.llm.tables import Workspace
from tests.comparing import assert_same, database

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos int, term string, row int, tree int"
WORDS = "ape Bee cat ÉTÉ dog x1y fox 水水 gnu".split()


def table(spark, rows):
    """Documents with extra columns under names that the operators use inside."""
    return spark.createDataFrame([(*r, "extra", 1, "extra", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def mixed():
    """Nulls in every column, empty and long texts, ties, repeated rows, one very common text."""
    random.seed(3)
    rows = []
    for i in range(300):
        text = " ".join(random.choices(WORDS, k=random.choice([0, 1, 3, 8, 40])))
        rows.append((i, random.choice([text, text.upper(), "same text", None]), random.choice(["en", "de", None, "", "é"]),
                     random.choice(["a", "b", "c", None]), random.choice([len(text), None])))
    rows += [rows[5], rows[5], (None, "same text", "en", "a", 9), (None, "only here", None, None, None),
             (7, "other text", "en", "b", 1), (900, "wide " * 50_000, "en", "a", 250_000), (901, "", "alone", "z", 0),
             (902, "\x00 nul Nul", "en", "a", 9)]
    return rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_query_equals_its_twin(spark, name):
    assert_same(QUERIES[name](spark, SMALL), database(SMALL), ORACLE[name])


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def divergences(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
            for _, text, lang, source, _ in rows]
    groups, result = {(g[0], g[1]) for g in docs}, []
    for lang in {g for g, _ in groups}:
        seen = Counter(t for g, _, terms in docs if g == lang for t in set(terms))
        kept = [t for t, n in seen.items() if n >= least]
        counts = {s: Counter(t for g, x, terms in docs if (g, x) == (lang, s) for t in terms if t in set(kept))
                  for g, s in groups if g == lang}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pair = [(-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), x.encode(), x)
                    for x, o in counts.items() if x != s]
            term = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t)
                    for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                result += [(lang, s, part, item, -value, i) for i, (value, _, item) in enumerate(found, 1)]
    return sorted(result)


@pytest.mark.parametrize("entries,pairs", [(600_000, 1 << 20), (3, 5)])
def test_divergences(spark, mixed, monkeypatch, entries, pairs):
    # small limits spill stripes and pair sums all the time
    fold, correct = source_stripes._fold, source_stripes._corrections

    def limited(f):
        def run(batches):
            f.__globals__.update(ENTRIES_AT_ONCE=entries, PAIRS_AT_ONCE=pairs, STRIPES_AT_ONCE=entries)
            yield from f(batches)
        return run

    monkeypatch.setattr(source_stripes, "_fold", limited(fold))
    monkeypatch.setattr(source_stripes, "_corrections", limited(correct))
    got = source_stripes.divergences(table(spark, mixed), least_documents=3, top_terms=4)
    assert sorted(map(tuple, got.collect())) == divergences(mixed, 3, 4)


def test_divergences_of_few_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "word", "en", None, 4)]
    got = source_stripes.divergences(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]
    assert source_stripes.divergences(table(spark, rows).filter("false")).collect() == []


def test_sums_beyond_a_long_come_back():
    assert source_stripes._wrapped(2 ** 63 + 5) == -2 ** 63 + 5
    assert source_stripes._wrapped(-3) == -3


# --- exact duplicates -------------------------------------------------------------------------------

def groups_of(rows):
    found = defaultdict(list)
    for doc_id, text, *_ in rows:
        found[hashlib.sha256(lowered(text).encode()).hexdigest()].append(doc_id)
    return found


@pytest.mark.parametrize("shard_texts,buckets", [(50_000, 64), (20, 1)])
def test_exact_duplicates(spark, mixed, shard_texts, buckets):
    got = cuckoo.exact_duplicates(table(spark, mixed), shard_texts, buckets).collect()
    expected = groups_of(mixed)
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(i), s) for s, ids in expected.items() for i in ids)
    for r in got:
        ids = expected[r.text_sha256]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert not r.kept or r.doc_id == best
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(expected, 1))


def test_exact_duplicates_of_nothing(spark, mixed):
    assert cuckoo.exact_duplicates(table(spark, mixed).filter("false")).collect() == []


def test_index_inserts_deletes_and_resizes():
    random.seed(1)
    index, live = cuckoo.CuckooIndex(buckets=1), {}
    known = [random.randbytes(32) for _ in range(3000)]
    for i in range(20_000):
        digest = random.choice(known)
        if random.random() < 0.6 and digest not in live:
            index.insert(digest, i)
            live[digest] = i
        elif random.random() < 0.4:
            assert index.delete(digest) == live.pop(digest, None)
        assert index.get(digest) == live.get(digest)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 5
    assert all(index.get(d) == live.get(d) for d in known)
    assert sum(map(len, index.slots)) + len(index.stash) == len(live)


def test_digests_of_one_print_overflow_into_the_stash():
    index = cuckoo.CuckooIndex(buckets=1)
    alike = [bytes([i]) * 8 + b"\x01\x02" + b"\x00" * 8 + bytes([i]) * 14 for i in range(40)]
    for i, digest in enumerate(alike):
        index.insert(digest, i)
    assert index.stash and [index.get(d) for d in alike] == list(range(40))
    assert [index.delete(d) for d in alike] == list(range(40))
    assert index.size == 0 and not index.stash and not any(index.slots)


def test_updated_index_equals_one_built_anew(spark, mixed):
    work = Workspace(spark)
    known = work.cut(cuckoo.digests(table(spark, mixed)).withColumn("row", F.monotonically_increasing_id()))
    first, later = known.filter("row % 3 != 0"), known.filter("row % 3 = 0")
    leaders = cuckoo.exact_duplicates(table(spark, mixed)).filter("kept").select("doc_id")
    removed = work.cut(first.join(leaders, "doc_id", "left_semi").filter("row % 2 = 0"))
    rest = work.cut(known.join(removed.select("row"), "row", "left_anti"))
    index = work.cut(cuckoo.build_index(first, 4))
    updated = cuckoo.update_index(work, index, 4, rest, added=later, removed=removed)
    columns = ["digest", "members", "keep_id", "keep_row"]
    assert removed.count() > 10
    assert sorted(map(str, updated.select(columns).collect())) == sorted(
        map(str, cuckoo.build_index(rest, 4).select(columns).collect()))


# --- manifest ---------------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    n = None if n is None else n + more
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def climb(nodes):
    """The root, and per node the list of (side, sibling) up to it."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            other = nodes[at ^ 1] if at ^ 1 < len(nodes) else None
            paths[i].append((at & 1, other))
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        places = [at >> 1 for at in places]
    return nodes[0], paths


def manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    inner = {g: climb([leaf(r) for r in trees[g]]) for g in order}
    root, upper = climb([inner[g][0] for g in order])
    result = []
    for g, above in zip(order, upper):
        for row, path in zip(trees[g], inner[g][1]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, proof = leaf(row, int(changed)), ""
            for side, other in path + above:
                node = sha(*([other or "", node] if side else [node, other or ""]))
                proof += other or ""
            result.append((str(row[0]), leaf(row), inner[g][0], root, sha(proof), node, node == root))
    return sorted(result)


def claimed():
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, mixed, levels):
    rows = mixed if levels == 10 else mixed[:60] + mixed[-8:]
    got = merkle.manifest(table(spark, rows), claimed(), levels=levels).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == manifest(rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_manifest_of_one_language(spark, n):
    rows = [(i, "t", "en", "a", 1) for i in range(n)]
    got = merkle.manifest(table(spark, rows)).collect()
    assert [(r[2], r[3], r[4]) for r in got if r.verified] == [(r[2], r[3], r[4]) for r in got] and len(got) == n
    if n:
        assert {r.root for r in got} == {climb([leaf(r) for r in rows])[0]}
    lone = merkle.manifest(table(spark, [(1, "t", g, "a", 1) for g in ("x", "y", "z")][:n])).collect()
    assert len({r.root for r in lone}) <= 1 and all(r.verified for r in lone)


def test_freed_memory_goes_back_before_another_thing_is_made(monkeypatch):
    calls = []
    monkeypatch.setattr(memory, "_kept", {})
    monkeypatch.setattr(memory, "give_back", lambda: calls.append(list(memory._kept)))
    assert [memory.only(key, lambda: key) for key in ("a", "a", "b")] == ["a", "a", "b"]
    assert calls == [[], []]


def test_a_worker_keeps_one_thing_at_a_time():
    from carestrata.llm import memory
    made = []
    for key in ("a", "a", "b", "a"):
        assert memory.only(key, lambda: made.append(key) or [key]) == [key]
    assert made == ["a", "b", "a"] and list(memory._kept) == ["a"]
