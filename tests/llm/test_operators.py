"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carestrata.llm import (
    automata, chosen_path, fuzzy_lines, merge_replay, scaled_sketch, string_kernel, text_density, tier_packing,
    token_spans, vptree)
from carestrata.llm.tables import Workspace
from carestrata.plans.session import shared_folder

PATTERN = public_tokenizers.PATTERN
MULTI, ENGLISH, WORDS = (public_tokenizers.path(n) for n in (
    "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars int, shard string, node int"


def words(n, seed):
    random = np.random.default_rng(seed)
    return ["".join(random.choice(list("abcdefghij"), 4)) for _ in range(n)]


BASE = words(120, 1)
PASSAGE = words(30, 2)
TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE)), (3, " ".join(BASE[:60] + ["changed"] + BASE[61:])),
    (4, None), (5, ""), (6, "  \n "), (7, "one two"), (7, "One  TWO"), (8, " ".join(words(40, 3) + PASSAGE)),
    (9, " ".join(PASSAGE + words(40, 4))), (10, "again " * 60), (11, "x" * 3000), (2, " ".join(BASE)),
    (12, " ".join(words(3000, 5))), (None, " ".join(words(30, 6))), (13, "Été, naïve — 漢字 🙂 don't"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def split(text):
    return (text or "").encode().split()


def test_near_duplicates(docs, nothing):
    def members(text):
        w = split((text or "").lower() if (text or "").isascii() else text)
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    rows = [(i, members(t)) for i, t in TEXTS]
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = sorted((str(i), len(s), str(i if not s else low(rows[k][0] for k in range(len(rows)) if group[k] == group[n])))
                  for n, (i, s) in enumerate(rows))
    found = chosen_path.near_duplicates(docs, size=3, percent=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert chosen_path.near_duplicates(nothing).count() == 0


def test_many_wanted_ids_do_not_pass_through_the_driver(docs, monkeypatch):
    """Beyond IDS_BYTES no join of whole texts has its ids broadcast, and the result is the same."""
    plans, plain = [], chosen_path.joined

    def seen(*args):
        plans.append(plain(*args))
        return plans[-1]

    def rows():
        return sorted(map(str, chosen_path.near_duplicates(docs, size=3, percent=85).collect()))

    want = rows()
    monkeypatch.setattr(chosen_path, "IDS_BYTES", 0, raising=False)
    monkeypatch.setattr(chosen_path, "joined", seen)
    assert rows() == want
    found = [p._jdf.queryExecution().sparkPlan().toString() for p in plans]
    assert found and not any("Broadcast" in p for p in found)


def test_crowded_leaves_are_compared_in_tiles(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(80):
        own = list(BASE)
        for at in random.choice(120, 1 + i % 7, replace=False):
            own[at] = f"w{i}x{at}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[k:k + 3]) for k in range(118)} for _, t in rows]
    group = list(range(80))
    for a in range(80):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = {i: min(k for k in range(80) if group[k] == group[i]) for i in range(80)}
    found = chosen_path.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85, small=4, tile_rows=16, trees=16)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_repeated_passages(docs, nothing):
    order = sorted({(i is not None, i or 0, t) for i, t in TEXTS if i not in (7,)}, key=lambda x: x[:2])
    seen, want = {}, {}
    for there, i, t in order:
        w = split(t)
        cover = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                cover[s:s + 20] = [True] * 20
            seen.setdefault(key, (i, s))
        want[i if there else None] = (len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode())
    for shard_words in (200_000, 200):  # one reading, and shards read in parts first
        found = automata.remove_repeats(docs, shard_words=shard_words, carry=["text", "node"]).collect()
        assert len(found) == len(TEXTS)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found if r.doc_id != 7} == want
    assert automata.remove_repeats(nothing).count() == 0


def test_a_common_passage_is_no_single_task(spark, monkeypatch):
    rows = [(i, " ".join(words(25, 1000 + i) + PASSAGE + words(25, 2000 + i))) for i in range(400)]
    # neighbours of the passage that repeat in some documents: windows that are new in several parts
    rows += [(400 + i, " ".join(words(25, 1000 + i) + PASSAGE + words(25, 3000 + i))) for i in range(60)]
    seen, want, plain = set(), {}, automata._read_shard
    for i, text in rows:
        w, cover = text.split(), [False] * 80
        for s in range(61):
            if tuple(w[s:s + 20]) in seen:
                cover[s:s + 20] = [True] * 20
            seen.add(tuple(w[s:s + 20]))
        want[i] = " ".join(x for x, c in zip(w, cover) if not c)

    def bounded(window):
        read = plain(window)

        def run(group):
            assert sum(len(b.as_py()) for b in group.column("words")) // 8 < 10_000
            return read(group)
        return run

    monkeypatch.setattr(automata, "_read_shard", bounded)
    found = automata.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard_words=2000).collect()
    assert {r.doc_id: r.kept_text for r in found} == want


def test_automaton_knows_what_it_has_read():
    random = np.random.default_rng(0)
    tool, seen = automata.Automaton(4), set()
    for _ in range(40):
        run = random.integers(0, 3, random.integers(1, 30)).tolist()
        want = []
        for s in range(len(run) - 3):
            if tuple(run[s:s + 4]) in seen:
                want.append(s)
            seen.add(tuple(run[s:s + 4]))
        assert tool.read(run) == want


def test_similar_lines(spark, nothing):
    a, b = " ".join(words(40, 7)), " ".join(words(40, 8))
    near = a[:60] + "z" + a[61:]
    rows = [(1, f"{a}\nshort\n\n{b}"), (2, f"Short\n{near.upper()}"), (3, "short"), (4, None), (5, ""), (6, a), (6, a)]
    found = {r.doc_id: (r.n_removed, r.kept_text) for r in fuzzy_lines.remove_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == (0, f"{a}\nshort\n\n{b}") and found[2] == (1, "Short")
    assert found[3] == (0, "short") and found[4] == (0, None) and found[5] == (0, "") and found[6] == (1, "")
    assert fuzzy_lines.remove_lines(nothing).count() == 0


def changed_lines(count: int, seed: int) -> list[tuple[str, str]]:
    """Lines of 5 to 50 made-up words, each beside a copy of which one word is replaced, added or left out."""
    random = np.random.default_rng(seed)
    made = lambda: "".join(random.choice(list("abcdefghijklmnoprstu"), random.integers(3, 10)))
    pairs = []
    for n in range(count):
        line = [made() for _ in range(random.integers(5, 51))]
        at = int(random.integers(0, len(line)))
        pairs.append((" ".join(line), " ".join([line[:at] + [made()] + line[at + 1:], line[:at] + [made()] + line[at:],
                                                 line[:at] + line[at + 1:]][n % 3])))
    return pairs


def test_recall_of_similar_lines_against_brute_force(spark):
    """Nine in ten of the copies whose edit similarity is 0.8 and more go, and none below it; no unlike line does."""
    pairs = changed_lines(300, 11)
    close = [fuzzy_lines.edit_distance(a, b, 10 ** 6) <= 0.2 * max(len(a), len(b)) + 1e-6 and len(b.split()) >= 5
             for a, b in pairs]
    rows = [(n, a) for n, (a, _) in enumerate(pairs)] + [(1000 + n, b) for n, (_, b) in enumerate(pairs)]
    found = {r.doc_id: r.n_removed for r in fuzzy_lines.remove_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[n] for n in range(300))
    assert not any(found[1000 + n] for n in range(300) if not close[n])
    assert sum(found[1000 + n] for n in range(300)) >= 0.97 * sum(close) > 200


def test_crowded_blocks_and_repeated_rows(spark):
    """Variants of one line beyond a block's bound for comparing all, beside unlike lines with the same beginning,
    a very long line, null ids, repeated rows and a clashing column."""
    random = np.random.default_rng(4)
    base, start = words(30, 21), words(6, 22)
    variant = lambda n: " ".join(base[:n % 30] + [f"q{'abcdefghij'[n % 10]}x"] + base[n % 30 + 1:])
    unlike = [" ".join(start + words(12, 100 + n)) for n in range(30)]
    long = " ".join(words(40_000, 5))
    rows = [(n, variant(n)) for n in range(40)] + [(100 + n, t) for n, t in enumerate(unlike)]
    rows += [(200, long), (201, long + " end"), (None, "only here " + " ".join(words(9, 77))), (300, "a b c d e"), (300, "a b c d e")]
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in [(None if r[0] is None else int(r[0]), str(r[1])) for r in rows]],
                                 "doc_id long, text string, line int, label int")
    found = {}
    for r in fuzzy_lines.remove_lines(docs).collect():
        found.setdefault(r.doc_id, []).append(r.n_removed)
    assert found[0] == [0] and all(found[n] == [1] for n in range(1, 40))
    assert all(found[100 + n] == [0] for n in range(30))
    assert found[200] == [0] and found[201] == [1] and found[None] == [0] and found[300] == [0, 0]


@pytest.mark.parametrize("part", [256, 3])
def test_groups_of_a_crowded_block_meet_in_all_near_pairs(spark, monkeypatch, part):
    """Only q and s link the two groups, and the line nearest to each by SimHash in the other group is another one."""
    monkeypatch.setattr(fuzzy_lines, "PART", part, raising=False)
    base, far = words(20, 31), -1 << 32
    changed = lambda line, at: [f"z{w[1:]}" * 2 if at <= i < at + 3 else w for i, w in enumerate(line)]
    q, s = base, changed(base, 0)
    named = [(0b000, q, 100), (0b110, changed(q, 6), 100), (0b111, s, 101), (0b001, changed(s, 12), 101)]
    named += [(far, words(20, 500 + n), None) for n in range(40)]
    lines = [(n, n, 0, 0, (n, 0), sim, len(" ".join(w)), 7, other, None, None, None, None)
             for n, (sim, w, other) in enumerate(named)]
    distinct = spark.createDataFrame(lines, "doc_id long, n long, t long, place int, line struct<k1:long,k2:long>, sim long, "
                                     "size int, " + ", ".join(f"h{i} long" for i in range(6))).drop("n")
    source = spark.createDataFrame([(n, 0, " ".join(w)) for n, (_, w, _) in enumerate(named)], "doc_id long, t long, text string")
    found = fuzzy_lines.line_groups(Workspace(spark), source, distinct, 0.8).collect()
    assert {r.node.k1: r.label.k1 for r in found} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert len(found) == 4


def test_spark_collects_only_small_tables_by_itself(spark):
    """A written table of 4 MB is joined by shuffle, not through the driver; a limit set lower stays."""
    key, was = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set(key, str(10 << 20))
        work = Workspace(spark)
        ids = work.cut(spark.range(500_000).select(F.xxhash64("id").alias("id")))
        wide = work.cut(spark.range(2_000_000).select(F.xxhash64("id").alias("id"), F.xxhash64("id", "id").alias("x")))
        plan = wide.join(ids, "id")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        spark.conf.set(key, "1000")
        Workspace(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, was)


def test_a_text_of_a_crowded_block_goes_to_few_tiles(spark, monkeypatch):
    """3,000 lines in two blocks are 12 times 256: each text is in two tiles of each block, not in twelve."""
    def listed(batches):
        for batch in batches:
            rows = pa.StructArray.from_arrays([batch["key"], batch["key"]], ["k1", "k2"])
            yield pa.RecordBatch.from_arrays([rows, rows], ["a", "b"])

    monkeypatch.setattr(fuzzy_lines, "_across", lambda similarity: listed)
    node = "struct<k1:long,k2:long>"
    crowds = spark.createDataFrame([(key, (n, 0), (n, 0), 0, 9) for n in range(3000) for key in (7, 8)],
                                   f"key long, line {node}, label {node}, sim long, size int")
    texts = spark.createDataFrame([((n, 0), "some words") for n in range(3000)], f"line {node}, words string")
    assert fuzzy_lines.links_across(Workspace(spark), crowds, texts, 0.8).count() <= 4 * 3000


def test_pairs_of_tiles_that_need_no_verifying(monkeypatch):
    """Letters that differ too much rule a pair out; one that shares two crowded blocks is verified in the lesser only."""
    seen, close = [], fuzzy_lines.close_pairs
    monkeypatch.setattr(fuzzy_lines, "close_pairs", lambda xs, ys, s: seen.extend(zip(xs, ys)) or close(xs, ys, s))
    words_ = ["aaaa bbbb cccc dddd eeee", "aaaa bbbb cccc dddd eeef", "vvvv wwww xxxx yyyy zzzz", "é" * 24]
    for keys, want in ([8], [(words_[0], words_[1])]), ([5, 8], []), ([8, 9], [(words_[0], words_[1])]):
        seen.clear()
        table = pa.table({
            "key": [8] * 4, "i": pa.array([0] * 4, pa.int32()), "j": pa.array([0] * 4, pa.int32()),
            "part": pa.array([0] * 4, pa.int32()), "l1": [1, 2, 3, 4], "l2": [0] * 4, "sim": [0] * 4,
            "size": pa.array([24] * 4, pa.int32()), "words": words_, "keys": pa.array([keys] * 4, pa.list_(pa.int64()))})
        assert fuzzy_lines.links_of_tiles(table, 0.8).num_rows == len(want)
        assert seen == want


def test_many_pairs_at_once_against_one_by_one(monkeypatch):
    random = np.random.default_rng(9)
    xs, ys = [], []
    for n in range(600):
        x = random.choice(list("abcdé漢 🙂"), random.integers(0 if n % 9 == 0 else 1, 400)).tolist()
        y = list(x)
        for _ in range(int(random.integers(0, 2 + len(x) // 3))):
            at = int(random.integers(0, len(y) + 1))
            y[at:at + int(random.integers(0, 2))] = ["q"] * int(random.integers(0, 2))
        xs.append("".join(x))
        ys.append("".join(y))
    xs, ys = xs + ["", "a" * 500], ys + ["", "b" * 500]
    for similarity in (0.5, 0.8, 0.95):
        most = [int(max(len(x), len(y)) * (1 - similarity) + 1e-6) for x, y in zip(xs, ys)]
        want = [fuzzy_lines.edit_distance(x, y, k) <= k for x, y, k in zip(xs, ys, most)]
        for singly in (32, 0):
            monkeypatch.setattr(fuzzy_lines, "SINGLY", singly)
            assert fuzzy_lines.close_pairs(xs, ys, similarity).tolist() == want


def test_pairs_of_different_lengths_are_verified_together(monkeypatch):
    random, calls, together = np.random.default_rng(3), [], fuzzy_lines._together
    monkeypatch.setattr(fuzzy_lines, "_together", lambda *a: calls.append(len(a[0])) or together(*a))
    xs = ["".join(random.choice(list("abcdef "), 100 + n)) for n in range(190)]
    ys = [x[:n % 40] + x[n % 40 + n % 30:] + "z" * (n % 17) for n, x in enumerate(xs)]
    most = [int(max(len(x), len(y)) * (1 - 0.8) + 1e-6) for x, y in zip(xs, ys)]
    want = [fuzzy_lines.edit_distance(x, y, k) <= k for x, y, k in zip(xs, ys, most)]
    assert fuzzy_lines.close_pairs(xs, ys, 0.8).tolist() == want and 0 < sum(want) < len(want)
    assert len(calls) == 1


def test_long_pairs_are_verified_together_and_without_their_common_ends(monkeypatch):
    random, single, seen = np.random.default_rng(5), [], []
    one, together = fuzzy_lines.edit_distance, fuzzy_lines._together
    text = lambda n: "".join(random.choice(list("abcdef "), n))
    xs = [text(1_500 + 20 * n) for n in range(60)]
    ys = [x[:300] + text(int(random.integers(100, 700))) + x[800:] if n % 2 else text(len(x)) for n, x in enumerate(xs)]
    ys[1] = xs[1][:200] + text(100) + xs[1][300:]  # a middle below the limit need not be looked at
    most = [int(max(len(x), len(y)) * 0.2 + 1e-6) for x, y in zip(xs, ys)]
    want = [one(x, y, k) <= k for x, y, k in zip(xs, ys, most)]
    monkeypatch.setattr(fuzzy_lines, "edit_distance", lambda *a: single.append(a) or one(*a))
    monkeypatch.setattr(fuzzy_lines, "_together", lambda a, b, k: seen.extend(a) or together(a, b, k))
    assert fuzzy_lines.close_pairs(xs, ys, 0.8).tolist() == want and 0 < sum(want) < len(want) and want[1]
    assert len(single) < 20 < len(seen) and not any(x[:300] == a[:300] for x in xs[1::2] for a in seen)


def test_edit_distance_against_the_whole_table():
    def table(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    random = np.random.default_rng(3)
    for _ in range(2000):
        x, y = ("".join(random.choice(list("abé漢🙂"), random.integers(0, 14))) for _ in range(2))
        most = int(random.integers(0, 15))
        assert fuzzy_lines.edit_distance(x, y, most) == min(table(x, y), most + 1)
    long = "".join(random.choice(list("abcdef "), 3000))
    assert fuzzy_lines.edit_distance(long, "z" + long[:1500] + long[1501:], 600) == 2


def test_encoding_and_decoding(docs, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    tool = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=merge_replay.read_ranks(MULTI), special_tokens={})
    found = merge_replay.encode_decode(docs, MULTI, PATTERN).collect()
    want = sorted((str(i), tool.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in found) == want
    assert merge_replay.encode_decode(nothing, MULTI, PATTERN).count() == 0
    random = np.random.default_rng(5)
    texts = ["".join(random.choice(list("abc \n\t\xa0\x1cé漢'sT1.,"), 40)) for _ in range(300)]
    assert [x.tolist() for x in merge_replay.Encoder(MULTI, PATTERN).texts(texts)] == [tool.encode_ordinary(t) for t in texts]


def test_merges_of_many_pieces_are_replayed_together(monkeypatch):
    random, steps, pair_ranks = np.random.default_rng(6), [], merge_replay.MergeReplay.pair_ranks
    ranks = merge_replay.read_ranks(MULTI)
    longer = [token for token in ranks if len(token) > 1]
    # in shuffled order a merge often comes before the one that made it possible
    shuffled = {t: r for t, r in ranks.items() if len(t) == 1} | dict(zip(longer, (256 + random.permutation(len(longer))).tolist()))
    pieces = [random.bytes(int(n)) for n in random.integers(1, 40, 500)] + [" ".join(words(60, 7)).encode()] + [
        "".join(random.choice(list("the and ing é漢"), 20)).encode() for _ in range(2_000)]
    monkeypatch.setattr(merge_replay.MergeReplay, "pair_ranks", lambda self, *a: steps.append(1) or pair_ranks(self, *a))
    for order in (ranks, shuffled):
        replay = merge_replay.MergeReplay(order)
        want = [[order[p]] if p in order else replay.one(p) for p in pieces]
        steps.clear()
        ids, counts = replay.encode(pieces)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        # steps for the merges of the longest piece, not for all merges
        assert len(steps) <= 2 * merge_replay.LONG < sum(len(p) - len(w) for p, w in zip(pieces, want)) / 10
        assert replay.decode(ids) == b"".join(pieces)


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_section_counts_add_up(docs, nothing, rule):
    found = token_spans.section_tokens(docs, ENGLISH, PATTERN, rule=rule)
    sums = found.groupBy("doc_id", "doc_tokens").agg(F.sum("n_tokens").alias("n")).filter("doc_id != 2").collect()
    assert all(abs(r.n - r.doc_tokens) < 1e-9 for r in sums if r.doc_id != 7)
    assert token_spans.section_tokens(nothing, ENGLISH, PATTERN).count() == 0


def test_allocation_rules():
    bounds, sections = np.array([0, 3, 6, 8]), np.array([0, 4])  # the second token holds 1 character of section 0
    assert token_spans.allocate(bounds, sections, "start").tolist() == [2, 1]
    assert token_spans.allocate(bounds, sections, "end").tolist() == [1, 2]
    assert token_spans.allocate(bounds, sections, "majority").tolist() == [1, 2]
    assert np.allclose(token_spans.allocate(bounds, sections, "fraction"), [1 + 1 / 3, 1 + 2 / 3])


def test_fingerprints(docs, nothing):
    rows = sorted({(i, t or "") for i, t in TEXTS if i not in (7, None)})
    found = {r.doc_id: r for r in scaled_sketch.fingerprints(docs.filter("doc_id != 7"), range_rows=3).collect()}
    for n, (i, t) in enumerate(rows):
        if i == 2:
            continue  # the row is there twice: its next document is itself
        after = rows[(n + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(t)
    assert found[1].fingerprint == found[2].fingerprint and found[1].near_next == 1.0
    assert scaled_sketch.fingerprints(nothing).count() == 0


def test_sketches_estimate_containment():
    long = " ".join(words(4000, 9))
    part = long[4000:12000]
    a, b = scaled_sketch.sketches([part, long])
    assert scaled_sketch.containment(a, b) > 0.95 and scaled_sketch.containment(b, a) < 0.6
    assert scaled_sketch.merge(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def test_packing(docs, nothing):
    tool = Tokenizer.from_file(WORDS)
    found = tier_packing.pack(docs, WORDS, with_ids=True).collect()
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, set()).add(tuple(tool.encode(t or "", add_special_tokens=False).ids + [1]))
    for r in found:
        assert any(x[r.start:r.start + r.length] == tuple(r.ids) for x in ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        size = sum(r.length for r in pieces)
        assert size == pieces[0].sequence_size <= 2048 and size & (size - 1) == 0
    total = sum(len(tool.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert sum(r.length for r in found) == total
    assert tier_packing.pack(nothing, WORDS).count() == 0


def test_packing_holds_a_bounded_part_of_the_text(monkeypatch):
    random, sizes, coded = np.random.default_rng(8), [], tier_packing.WordCoder.texts
    texts = [" ".join(words(20_000, n)) for n in range(50)] + [None, "", "w" * 4_000_000, "a É 漢. " * 100]

    def measured(self, some):
        sizes.append([len((t if isinstance(t, str) else t.as_py()).encode()) for t in some])
        return coded(self, some)

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(tier_packing.WordCoder, "texts", measured)
    monkeypatch.setattr(tier_packing, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    found = pa.Table.from_batches(tier_packing._rows(WORDS, 1, tier_packing.TIERS, 65_536, False)([batch])).to_pandas()
    assert all(len(some) == 1 or sum(some) <= 3 << 20 for some in sizes)
    whole = Tokenizer.from_file(WORDS)
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts]
    assert found.groupby("doc_id")["length"].sum().tolist() == want

    # words are forgotten by their bytes, long before there are many of them
    monkeypatch.setattr(tier_packing, "REMEMBERED_BYTES", 20_000)
    coder = tier_packing.WordCoder(WORDS)
    for n in range(20):
        text = " ".join("".join(random.choice(list("abcdeé"), 2_000)) for _ in range(5))
        assert coder.texts([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        assert coder.held <= 40_000 and sum(map(len, coder.numbers)) <= 40_000


def test_toxicity(spark, docs, nothing):
    random, rows, labels = np.random.default_rng(4), [], []
    for i in range(400):
        own = words(30, 100 + i)
        if i % 5 == 0:
            own[random.integers(30)] = str(random.choice(["blockhead", "nitwit"]))
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, "you b-l-o-c-k-h-e-a-d"), (1001, "blo.ckhe.ad indeed"), (1002, None), (1003, ""), (None, "nitwit")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in string_kernel.toxicity(
        table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(400) if found[i].held_out} == set(held)
    assert all(found[i].predicted == int(i % 5 == 0) for i in held)
    assert found[1000].predicted == found[1001].predicted == found[None].predicted == 1
    assert found[1002].predicted == found[1003].predicted == 0 and 0 <= found[1002].score < 0.3
    none = string_kernel.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in none.collect()} == {0.0} and string_kernel.toxicity(
        nothing, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_training_leaves_no_tables(spark):
    rows = [(i, " ".join(words(8, i) + ["nitwit"] * (i % 5 == 0)), int(i % 5 == 0)) for i in range(200)]
    table, shared = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), Path(shared_folder(spark)).parent
    before = set(shared.glob("*/*"))
    found = string_kernel.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert set(shared.glob("*/*")) == before and found.filter("predicted = 1").count() == 40


def test_short_texts_are_no_copies_of_each_other(spark):
    long = " ".join(words(30, 9))
    rows = [(1, 1, "nitwit"), (2, 1, "you blockhead"), (3, 1, ""), (4, 0, "hello"), (5, 0, long), (6, 0, long), (7, 1, long)]
    left = string_kernel.without_copies(
        Workspace(spark), spark.createDataFrame(rows, "doc_id long, toxic int, text string")).collect()
    assert sorted(r.doc_id for r in left) == [1, 2, 3, 4, 5, 7]


def test_main_text(spark):
    page = ("<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
            "<article><h1>Head &amp; line</h1><p>First\n  part <b>bold</b><p>Second&nbsp;part<div class='comments'>no</div>"
            "</article><footer>(c)</footer>")
    plain = ("<body><div id=menu><a href=1>a</a></div><div><p>" + "many words of text " * 20 + "</p><p>short.</p></div>"
             "<div><a href=1>link one</a> <a href=2>link two</a></div></body>")
    assert text_density.main_text(page) == "Head & line\nFirst part bold\nSecond part"
    assert text_density.main_text(plain) == " ".join(["many words of text"] * 20) + "\nshort."
    assert [text_density.main_text(x) for x in (None, "", "<nav>x</nav>", "bare <b>text")] == ["", "", "", "bare text"]
    rows = spark.createDataFrame([(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0)],
                                 "page_id long, url string, html string, text int")
    found = text_density.extract(rows).collect()
    assert [r.n_chars for r in found] == [len(r.text) for r in found] and len(found) == 3
    assert text_density.extract(rows.filter("false")).count() == 0


STORY = "".join(f"<p>{' '.join(words(40, 50 + i))}</p>" for i in range(5))
STORY_TEXT = "\n".join(" ".join(words(40, 50 + i)) for i in range(5))
TEASER = "<article><h2><a href=1>more of this</a></h2><p><a href=1>a few words here</a></p></article>"


def test_densities_decide_over_article_marks():
    main_text = text_density.main_text
    assert main_text(f"<body>{TEASER * 3}<div>{STORY}</div>{TEASER * 2}</body>") == STORY_TEXT
    assert main_text(f"<body><main><h1>Head</h1><div>{STORY}</div><div>{TEASER * 3}</div></main></body>") == "Head\n" + STORY_TEXT
    links = "<ul><li><a href=1>one more page</a><li><a href=2>and another</a></ul>"
    assert main_text(f"<body><article><h1>Head</h1><div>{STORY}</div>{links}</article></body>") == "Head\n" + STORY_TEXT


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "comments-open", "ad-free", "share-page", "related-work"])
def test_names_are_evidence_only(name):
    main_text, ad = text_density.main_text, "<div class='ad'>buy this now</div>"
    for inner in (STORY, f"<div>{STORY}</div>", f"<article>{STORY}</article>", f"<main>{STORY}</main>"):
        assert main_text(f"<body>{ad}<div class='{name}'>{ad}{inner}</div>{ad}</body>") == STORY_TEXT
        assert main_text(f"<body><section id='{name}'>{inner}</section></body>") == STORY_TEXT


def test_neighbours(spark):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(600, 16)) * random.uniform(0.5, 2, (600, 1))
    vectors[100:140] = vectors[0]  # a common vector: ties go to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] * 16, 0), (703, [None] * 16, 0), (704, [1.0], 0),
             (None, vectors[1].tolist(), 0), (5, vectors[5].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    asked = table.filter("vec_id % 20 = 0")
    for factor, least in ((1.0, 1.0), (1.6, 0.9)):
        found = vptree.nearest(table, asked, k=20, factor=factor, shard_rows=200, block_rows=20).collect()
        hits = 0
        for q in range(0, 600, 20):
            scores = (vectors * vectors[q]).sum(axis=1)
            scores[q] = -np.inf
            want = np.lexsort((np.arange(600), -scores))[:20].tolist()
            mine = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
            hits += len(set(mine) & set(want))
            assert factor > 1 or mine == want
        assert hits >= least * 600 and len(found) == 600
    assert vptree.nearest(table.filter("false"), asked.filter("false")).count() == 0
