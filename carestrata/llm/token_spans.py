"""Token counts of the sections of documents, from one encoding of the whole document.

Tokens are mapped to character spans, sections are character spans too, and the two ordered lists of intervals
are joined; a token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.llm.merge_replay import batches_of, read_ranks
from carestrata.llm.tables import picked

RULES = ("majority", "start", "end", "fraction")


def token_bounds(lengths: np.ndarray, text: bytes) -> np.ndarray:
    """Character offsets of token boundaries (one more than tokens); a boundary inside a character moves to its end."""
    bounds = np.r_[0, np.cumsum(lengths)]
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    characters = np.r_[0, np.cumsum(leads)]
    return characters[bounds]


def allocate(bounds: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section. ``bounds``: token boundaries; ``sections``: ascending first characters, from 0.

    start, end: the section of the token's first or last character. majority: the section with most of its
    characters, the earlier one on a tie. fraction: each section gets its share of the token's characters. A token
    without characters of its own (a part of one) counts where the character it belongs to ends.
    """
    n = len(sections)
    starts, ends = bounds[:-1], bounds[1:]
    if rule == "start":
        return np.bincount(np.searchsorted(sections, np.minimum(starts, bounds[-1] - 1), "right") - 1, minlength=n)
    last = np.maximum(ends - 1, 0)
    first_at = np.searchsorted(sections, np.minimum(starts, last), "right") - 1
    last_at = np.searchsorted(sections, last, "right") - 1
    if rule == "end":
        return np.bincount(last_at, minlength=n)
    whole = first_at == last_at
    edges = np.r_[sections, max(int(bounds[-1]), int(sections[-1]))]
    counts = np.bincount(first_at[whole], minlength=n).astype(float if rule == "fraction" else np.int64)
    for i in np.flatnonzero(~whole).tolist():
        span = np.arange(first_at[i], last_at[i] + 1)
        share = np.minimum(edges[span + 1], ends[i]) - np.maximum(edges[span], starts[i])
        if rule == "fraction":
            counts[span] += share / share.sum()
        else:
            counts[span[share.argmax()]] += 1
    return counts


def line_starts(text: str) -> np.ndarray:
    """Sections that begin at the start of the text and behind every line feed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.r_[0, np.flatnonzero(codes == 10) + 1]


_tools: dict = {}


def _tool(path: str, pattern: str):
    if (path, pattern) not in _tools:
        import tiktoken
        ranks = read_ranks(path)
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _tools[path, pattern] = (
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _tools[path, pattern]


def _rows(path: str, pattern: str, rule: str):
    number = float if rule == "fraction" else np.int64

    def run(batches):
        tool, lengths = _tool(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, some in batches_of(texts):
                per_text, starts, stops, counts, totals = [], [], [], [], []
                for text in some:
                    ids = tool.encode_ordinary(text)
                    bounds = token_bounds(lengths[np.asarray(ids, np.int64)], text.encode())
                    sections = line_starts(text)
                    found = allocate(bounds, sections, rule) if ids else np.zeros(len(sections), number)
                    per_text.append(len(sections))
                    starts.append(sections)
                    stops.append(np.r_[sections[1:], len(text)])
                    counts.append(found.astype(number))
                    totals.append(len(ids))
                lists = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
                columns = [pa.array(np.concatenate(x).astype(t)) for x, t in
                           ((starts, np.int32), (stops, np.int32), (counts, number))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(some)).cast(pa.int64()), pa.array(totals, pa.int64()),
                     *[pa.ListArray.from_arrays(lists, c) for c in columns]],
                    ["doc_id", "doc_tokens", "starts", "stops", "tokens"])
    return run


def section_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", *,
                   rule: str = "majority") -> DataFrame:
    """Tokens of every line of every whole document.

    Returns one row per section: doc_id, section (from 0), start_char, end_char, n_tokens, doc_tokens. The line
    feed belongs to the line it ends. ``rule`` says where a token across a boundary counts; whichever is chosen,
    the counts of a document add up to doc_tokens ("fraction" makes n_tokens a double).

    A null or empty text is one empty section without tokens. Repeated rows give repeated sections; other
    columns are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = "double" if rule == "fraction" else "bigint"
    coded = picked(docs, doc_id=doc_id, text=text).mapInArrow(
        _rows(path, pattern, rule),
        f"doc_id long, doc_tokens long, starts array<int>, stops array<int>, tokens array<{kind}>")
    return coded.select("doc_id", "doc_tokens", F.posexplode(F.arrays_zip("starts", "stops", "tokens")).alias("section", "x")).select(
        "doc_id", "section", F.col("x.starts").alias("start_char"), F.col("x.stops").alias("end_char"),
        F.col("x.tokens").alias("n_tokens"), "doc_tokens")
