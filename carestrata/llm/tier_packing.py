"""Packing whole documents into training sequences of several lengths.

A document's token ids are cut into full windows of the longest length; what is left goes to the tier of the
smallest length that holds it. Each tier packs its own windows: gaps are filled with the longest remainder of a
shorter tier that fits, and a last gap by cutting a remainder, so every window is full. Windows are dealt to
step groups of equal token counts.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from carestrata.llm.memory import give_back, only
from carestrata.llm.merge_replay import gather
from carestrata.llm.tables import picked

#: Words a worker remembers and their bytes; beyond it the memory is emptied, results stay the same.
REMEMBERED, REMEMBERED_BYTES = 350_000, 6_000_000
TIERS = (2048, 1024, 512, 256)
#: Tokens gathered before a round of packing; bounds a worker's memory.
ROUND_TOKENS = 2_000_000
#: Bytes of text coded at once; a longer text is coded alone.
CODED_BYTES = 3 << 20

# letters without special case rules: a run of them is one piece, with or without the stop behind it
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


class WordCoder:
    """Ids of whole texts by a tokenizer that drops white space, remembering the words it has met.

    Such a tokenizer never joins across white space, so words are encoded once each, many at a time; words of
    letters are folded to lower case and parted from a stop behind them first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        ends = [i for token, i in self.tool.get_vocab().items() if token.endswith("</w>")]
        self.last = np.zeros(self.tool.get_vocab_size(), bool)
        self.last[ends] = True
        self._forget()

    def _forget(self) -> None:
        """Know only the stops: nothing, full stop, comma."""
        self.numbers: dict[str, int] = {}
        self.table = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.held = 0
        self._learn([], ["", ".", ","])

    def _learn(self, letters: list[str], other: list[str]) -> None:
        """Number new words and append their ids to the table."""
        ids, ends = [self.table], [self.starts]
        for at in range(0, len(letters), 20_000):
            some = letters[at:at + 20_000]
            runs = [" ".join(some[i:i + 500]) for i in range(0, len(some), 500)]
            found = [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast(runs, add_special_tokens=False)]
            found = np.concatenate(found)
            stops = np.flatnonzero(self.last[found]) + 1
            if len(stops) != len(some):
                raise ValueError("a word of letters is more than one piece to this tokenizer")
            ids.append(found)
            ends.append(stops + ends[-1][-1])
        for at in range(0, len(other), 5_000):
            found = [e.ids for e in self.tool.encode_batch_fast(other[at:at + 5_000], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
            ends.append(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) + ends[-1][-1])
        count = len(self.numbers)
        self.numbers.update(zip(chain(letters, other), range(count, count + len(letters) + len(other))))
        self.table, self.starts = np.concatenate(ids), np.concatenate(ends)

    def _numbers(self, bases: pa.Array) -> np.ndarray:
        """The number of each of the distinct words, learned where it is new."""
        words = bases.to_pylist()
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        new = numbers < 0
        if new.any():
            if len(self.numbers) + int(new.sum()) > REMEMBERED or self.held > REMEMBERED_BYTES:
                self._forget()
                known = np.fromiter((w in self.numbers for w in words), bool, len(words))
                new = ~known
            self.held += int(pc.sum(pc.binary_length(bases.filter(pa.array(new)))).as_py() or 0)
            plain = pc.match_substring_regex(bases, f"^{_LETTERS}$").to_numpy(zero_copy_only=False)
            self._learn([words[i] for i in np.flatnonzero(new & plain)], [words[i] for i in np.flatnonzero(new & ~plain)])
            numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return numbers

    def texts(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        # only ASCII white space splits here; whatever else a word holds, the tokenizer sees it whole
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        found = parts.flatten().dictionary_encode()
        words = found.dictionary
        plain = pc.match_substring_regex(words, f"^{_LETTERS}[.,]?$")
        stop = np.where(plain, np.where(pc.ends_with(words, "."), 1, np.where(pc.ends_with(words, ","), 2, 0)), 0)
        bases = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(words, ".,")), words).dictionary_encode()
        base = self._numbers(bases.dictionary)[bases.indices.to_numpy()]
        # two stretches of the table for each distinct word, then one stretch of ids for each word of the texts
        both = np.stack((base, stop), 1).ravel()
        sizes = np.diff(self.starts)[both]
        coded = gather(self.table, self.starts[both], sizes)
        lengths = sizes.reshape(-1, 2).sum(axis=1)
        at = found.indices.to_numpy()
        ids = gather(coded, (np.cumsum(lengths) - lengths)[at], lengths[at])
        bounds = np.r_[0, np.cumsum(lengths[at])][parts.offsets.to_numpy()]
        return [ids[lo:hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Packer:
    """Packs remainders round by round: pieces of a document never overlap, every window closed here is full."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_tokens: int):
        self.tiers = sorted(tiers, reverse=True)
        self.first_id, self.step_tokens = first_id, step_tokens
        self.items: list[tuple] = []  # (length, arrival, document, start) in order
        self.made = self.arrived = self.pending = 0
        self.windows = {tier: 0 for tier in self.tiers}

    def add(self, document, length: int):
        """Emit the full longest windows of a document, keep what is left over."""
        longest, start = self.tiers[0], 0
        while length - start >= longest:
            yield from self._close([(document, start, longest)], longest)
            start += longest
        if length > start:
            self._keep(document, start, length - start)

    def _keep(self, document, start: int, length: int) -> None:
        insort(self.items, (length, self.arrived, document, start))
        self.arrived += 1
        self.pending += length

    def _take(self, index: int, most: int):
        length, _, document, start = self.items.pop(index)
        self.pending -= length
        if length > most:
            self._keep(document, start + most, length - most)
        return document, start, min(length, most)

    def _close(self, pieces: list, size: int):
        number = self.first_id + self.made
        self.made += 1
        step = self.windows[size] // max(1, self.step_tokens // size) if size in self.windows else 0
        if size in self.windows:
            self.windows[size] += 1
        offset = 0
        for document, start, length in pieces:
            yield document, start, length, number, offset, size, step
            offset += length

    def _fill(self, size: int, index: int):
        """One window of ``size``: the item at ``index``, then the longest that fit, then a cut one."""
        pieces, room = [], size
        while room:
            piece = self._take(index, room)
            pieces.append(piece)
            room -= piece[2]
            if room:
                index = bisect_right(self.items, (room, float("inf"))) - 1
                index = max(index, 0)  # nothing fits: cut the shortest that is too long
        yield from self._close(pieces, size)

    def round(self):
        """Close windows of every tier, longest first, while its own remainders last."""
        for tier in self.tiers:
            least = tier // 2 if tier != self.tiers[-1] else 0
            while self.pending >= tier and self.items and self.items[-1][0] > least:
                yield from self._fill(tier, len(self.items) - 1)

    def finish(self):
        """Pack everything that is left into windows whose lengths are powers of two."""
        yield from self.round()
        size = self.tiers[0]
        while self.pending:
            while size > self.pending:
                size //= 2
            yield from self._fill(size, len(self.items) - 1)


def coder(path: str) -> WordCoder:
    return only(("word coder", path), lambda: WordCoder(path))


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_size", "step_group"]


def _runs(column: pa.Array):
    """A column of texts (null: empty) in runs of whole texts of up to CODED_BYTES: (first row, texts)."""
    ends, first = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)), 0
    while first < len(column):
        begun = ends[first - 1] if first else 0
        stop = max(int(np.searchsorted(ends, begun + CODED_BYTES, "right")), first + 1)
        yield first, column.slice(first, stop - first).fill_null("").cast(pa.string())
        first = stop


def _rows(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
    def table(pieces: list) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in FIELDS]
        ids = []
        for (doc_id, tokens), start, length, number, offset, size, step in pieces:
            own = tokens[start:start + length]
            for column, value in zip(columns, (doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()),
                                               len(tokens), number, offset, size, step)):
                column.append(value)
            if with_ids:
                ids.append(own.astype(np.int64))
        arrays = [pa.array(c, pa.int64()) for c in columns]
        extra = [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
        return pa.RecordBatch.from_arrays(arrays + extra, FIELDS + ["ids"] * with_ids)

    def run(batches):
        tool = coder(path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 33, step_tokens)
        pieces: list = []
        for batch in batches:
            for first, some in _runs(batch.column(1)):
                for i, ids in enumerate(tool.texts(some)):
                    tokens = np.append(ids, np.uint32(end_id))
                    pieces += packer.add(_Document((batch.column(0)[first + i].as_py(), tokens)), len(tokens))
                if packer.pending > ROUND_TOKENS:
                    pieces += packer.round()
                if pieces:
                    yield table(pieces)
                    pieces = []
        pieces += packer.finish()
        if pieces:
            yield table(pieces)
        pieces = []
        give_back()
    return run


class _Document(tuple):
    """A document's id and tokens; never compared, as arrivals differ."""


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", *, end_id: int = 1,
         tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536, with_ids: bool = False) -> DataFrame:
    """Pack every whole document, its ids followed by ``end_id``, into sequences without padding.

    Returns one row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of the
    little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (gapless from 0 in each sequence),
    sequence_size (a power of two, the sum of its pieces), step_group (numbered per size and task, each of
    ``step_tokens`` tokens), and with ``with_ids`` the ids.

    A null or empty text is the end id alone. Repeated rows are packed each. Other columns are ignored; an empty
    table gives an empty result. Tasks pack the rows of their own partition, so nothing is shuffled, sequence
    ids are a task's number and a counter, and a task that runs again gives the same rows. At its end a task
    has at most one window of each smaller power of two.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    schema = ", ".join(f"{name} long" for name in FIELDS) + (", ids array<long>" if with_ids else "")
    return picked(docs, doc_id=doc_id, text=text).mapInArrow(_rows(path, end_id, tiers, step_tokens, with_ids), schema)
