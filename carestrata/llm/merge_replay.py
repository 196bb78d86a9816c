"""Byte-level BPE by replaying merges over the vocabulary of a corpus shard.

Encoding depends only on the distinct pieces of the texts. Each task gathers the pieces it has not met, lays their
bytes out in one array beside the ranks of neighbouring pairs, and replays the merges of all pieces at once: in one
step each piece makes its merge of lowest rank, leftmost first, and only the two neighbours of a merged position get
new pairs. Texts are then looked up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carestrata.llm.memory import only
from carestrata.llm.tables import picked

#: Characters of stretches and bytes of pieces a worker remembers; beyond it the memory is emptied, results stay the same.
REMEMBERED = 6_000_000
#: Longer stretches and pieces are not remembered.
LONGEST_REMEMBERED = 100
#: Pieces replayed at once, whose arrays stay within a core's cache; longer pieces are replayed one by one.
PIECES, LONG = 20_000, 256
#: Ids decoded at once.
DECODED = 1 << 16
#: The rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max

# A stretch is white space and what follows up to the next white space. No match of the piece pattern runs from
# a non-space into ASCII white space, so stretches can be split into pieces one by one.
_stretch = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# other white space may join ASCII white space in one piece; such texts are taken whole
_odd_space = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` one behind the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(len(at))
    return table[at]


class MergeReplay:
    """Merges of one rank table, replayed over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        # of bytes: most pairs ever asked for
        self.of_bytes = self.pair_ranks(np.repeat(self.single, 256), np.tile(self.single, 256))
        tokens = dict(sorted((rank, token) for token, rank in ranks.items()))
        self.lengths = np.zeros(max(tokens) + 1, np.int64)
        self.lengths[list(tokens)] = list(map(len, tokens.values()))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.values()), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that the pairs merge to, NONE where there is none."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], np.int32(NONE))

    def one(self, word: bytes) -> list[int]:
        """The merges of a single word, lowest rank and leftmost first."""
        ids, n = self.single[np.frombuffer(word, np.uint8)].tolist(), len(word)
        token, ranks = [word[i:i + 1] for i in range(n)], self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ranks.get(token[i] + token[j]) != r:
                continue
            ids[i], token[i], alive[j] = r, token[i] + token[j], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get(token[i] + token[k])) is not None:
                    heappush(heap, (s, i))
            if (k := before[i]) >= 0 and (s := ranks.get(token[k] + token[i])) is not None:
                heappush(heap, (s, k))
        return [x for x, there in zip(ids, alive) if there]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one behind the other, and how many each word has."""
        parts = [self._replayed(words[at:at + PIECES]) for at in range(0, len(words), PIECES)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, counts = zip(*parts)
        return np.concatenate(ids), np.concatenate(counts)

    def _replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        one = np.flatnonzero(whole >= 0)
        found = [(one, np.ones(len(one), np.int64), whole[one].astype(np.int32))]  # words, their numbers of ids, ids
        for w in np.flatnonzero((whole < 0) & (sizes > LONG)).tolist():
            ids = np.array(self.one(words[w]), np.int32)
            found.append((np.array([w]), np.array([len(ids)]), ids))
        split = np.flatnonzero((whole < 0) & (sizes > 0) & (sizes <= LONG))
        raw = np.frombuffer(b"".join([words[w] for w in split.tolist()]), np.uint8)
        owner, ids = np.repeat(split, sizes[split]), self.single[raw]
        # beside each token the rank of its pair with the next one of the word
        rank = np.full(len(ids), NONE, np.int32)
        rank[:-1] = self.of_bytes[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        rank[np.cumsum(sizes[split]) - 1] = NONE
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[first, len(ids)])
            least = np.minimum.reduceat(rank, first)
            done = least == NONE
            if done.any():
                out = np.repeat(done, lengths)
                found.append((owner[first[done]], lengths[done], ids[out]))
                owner, ids, rank = owner[~out], ids[~out], rank[~out]
                lengths, least = lengths[~done], least[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            who = owner[at]
            at = at[np.r_[True, who[1:] != who[:-1]]]
            ids[at] = least
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            owner, ids, rank = owner[stay], ids[stay], rank[stay]
            at -= np.arange(len(at))  # each word before has lost one token
            for left in (at - 1, at):
                beside = np.minimum(left + 1, len(ids) - 1)
                own = (left >= 0) & (left + 1 < len(ids)) & (owner[left] == owner[beside])
                rank[left[own]] = self.pair_ranks(ids[left[own]], ids[beside[own]])
            rank[at[~own]] = NONE
        who, counts, ids = (np.concatenate(x) for x in zip(*found))
        starts, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[who], total[who] = np.cumsum(counts) - counts, counts
        return gather(ids, starts, total), total

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (ids[at:at + DECODED] for at in range(0, len(ids), DECODED))
        return b"".join(gather(self.bytes, self.starts[some], self.lengths[some]).tobytes() for some in parts)


class Memory:
    """Numbers of strings, and the ids of each by its number."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def number(self, keys: list[str]) -> np.ndarray:
        """The number of each key, -1 where it is not known."""
        return np.fromiter(map(self.numbers.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known = len(self.numbers)
        self.numbers.update(zip(keys, range(known, known + len(keys))))
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these numbers one behind the other, and how many each has."""
        starts = self.ends[numbers]
        counts = self.ends[numbers + 1] - starts
        return gather(self.ids, starts, counts), counts

    def drop(self, keys: list[str]) -> None:
        """Forget the keys that were added last."""
        for key in keys:
            del self.numbers[key]
        self.ends = self.ends[:len(self.numbers) + 1].copy()
        self.ids = self.ids[:self.ends[-1]].copy()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(counts)]])


class Encoder:
    """Whole texts to ids, remembering stretches seen before."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.replay = MergeReplay(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.stretches, self.pieces = Memory(), Memory()
        self.held = 0

    def _learn(self, memory: Memory, keys: list[str], coded) -> tuple[np.ndarray, list[str]]:
        """Numbers of the keys, those not known coded and added; and the keys too long to stay, which are last."""
        numbers = memory.number(keys)
        new = sorted(dict.fromkeys(compress(keys, (numbers < 0).tolist())), key=lambda k: len(k) > LONGEST_REMEMBERED)
        if not new:
            return numbers, []
        memory.add(new, *coded(new))
        at = np.flatnonzero(numbers < 0).tolist()
        numbers[at] = memory.number([keys[i] for i in at])
        long = [k for k in new if len(k) > LONGEST_REMEMBERED]
        self.held += sum(map(len, new)) - sum(map(len, long))
        return numbers, long

    def _pieces(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches one behind the other, and how many each has; only pieces not met before are replayed."""
        split = list(map(self.pattern.findall, stretches))
        numbers, long = self._learn(self.pieces, list(chain.from_iterable(split)),
                                    lambda new: self.replay.encode([p.encode() for p in new]))
        ids, counts = self.pieces.take(numbers)
        self.pieces.drop(long)
        return ids, _sums(counts, np.fromiter(map(len, split), np.int64, len(split)))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > REMEMBERED:
            self._forget()
        parts = [[text] if _odd_space.search(text) else _stretch.findall(text) for text in texts]
        numbers, long = self._learn(self.stretches, list(chain.from_iterable(parts)), self._pieces)
        ids, counts = self.stretches.take(numbers)
        self.stretches.drop(long)
        ends = np.cumsum(_sums(counts, np.fromiter(map(len, parts), np.int64, len(parts)))).tolist()
        return [ids[lo:hi].astype(np.uint32) for lo, hi in zip([0, *ends], ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.replay.decode(ids)


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return only(("merge replay", path, pattern), lambda: Encoder(path, pattern))


def batches_of(texts: list[str], limit: int = 4 << 20):
    """Runs of whole texts of about ``limit`` characters: (first, texts)."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _rows(path: str, pattern: str, whole: bool):
    def run(batches):
        tool = encoder(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for first, run_of in batches_of(texts):
                coded = tool.texts(run_of)
                counts = np.array([len(c) for c in coded], np.int64)
                decoded = [tool.decode(c) for c in coded]
                if whole:
                    flat = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                    columns = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(flat)),
                               pa.array(decoded, pa.binary())]
                else:
                    columns = [pa.array([hashlib.sha256(c.astype("<u4").tobytes()).hexdigest() for c in coded]),
                               pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(run_of)).cast(pa.int64()), pa.array(counts), *columns],
                    ["doc_id", "n_tokens", *(("ids", "decoded") if whole else ("ids_sha256", "decoded_sha256"))])
    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token ids of every whole text and the bytes they decode to: doc_id, n_tokens, ids array<int>, decoded binary.

    A null text is an empty one, without tokens. Repeated rows stay, ids and order do not matter, other columns
    are ignored, an empty table gives an empty result. There is no shuffle; a lost task is simply run again.
    Memory: about 4 million characters of text, their distinct pieces, and stretches and pieces of REMEMBERED
    characters per worker.
    """
    return picked(docs, doc_id=doc_id, text=text).mapInArrow(
        _rows(path, pattern, True), "doc_id long, n_tokens long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``encode_decode``, with SHA-256 of the ids (little-endian unsigned 32 bits) and of the decoded bytes."""
    return picked(docs, doc_id=doc_id, text=text).mapInArrow(
        _rows(path, pattern, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
