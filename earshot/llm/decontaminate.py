"""Benchmark decontamination with one Aho-Corasick automaton over normalised item words.

Texts are read as words (A-Z in lower case, ASCII punctuation and control characters as separators).  A
window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
The automaton holds all windows as sequences of word numbers, words outside the benchmark being number 0,
and reads every document once.  Hits are word positions, mapped back to offsets in the original text.

The benchmark is the small side, and its size is checked: items are numbered in blocks of at most
``block_bytes`` of text, each block is one automaton, and more blocks mean more passes over the same rows
within their tasks, without a shuffle.

Defined results: a null or empty text has no words and no hits; items without an id or without words take
no part; items that repeat count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import normal_words, slices
from earshot.sources.shared import cut

#: A word in a text whose A-Z may be in either case.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BLOCK_BYTES = 1 << 20

Windows = dict[tuple[bytes, ...], tuple[str, ...]]


def item_windows(items: list[tuple[str, str | None]], window: int) -> Windows:
    """Each window with the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item_id)
    return {w: tuple(sorted(ids)) for w, ids in found.items()}


class Scanner:
    """The automaton over one block of windows."""

    def __init__(self, windows: Windows):
        self.ids: dict[bytes, int] = {}
        self.items = list(windows.values())
        self.lengths = [len(w) for w in windows]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, words in enumerate(windows):
            self.automaton.add_word(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words), n)
        if windows:
            self.automaton.make_automaton()

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that windows cover, merged and in order, and the items they are of."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if not words or not self.items:
            return [], items
        number = self.ids.get
        for end, n in self.automaton.iter(tuple([number(w, 0) for w in words])):
            start = end + 1 - self.lengths[n]
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end + 1])
            items.update(self.items[n])
        return [(a, b) for a, b in spans], items


def word_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    ends = [m.span() for m in WORD.finditer(text)]
    return [(ends[a][0], ends[b - 1][1]) for a, b in ranges]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items (sorted), hit_spans`` (character offsets, end exclusive).

    Columns of ``docs`` by these names are replaced.
    """
    spark = docs.sparkSession
    own = ["n_words", "n_hit", "items", "hit_spans"]
    ids, text = F.col(item_id_col).cast("string"), F.col(item_text_col)
    items = benchmark.filter(ids.isNotNull() & text.isNotNull()).select(ids.alias("id"), text.alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // block_bytes)
    if n_blocks > 1:
        items = cut(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))), "items")
    blocks = []
    for k in range(n_blocks):
        rows = items.filter(F.col("block") == k) if n_blocks > 1 else items
        blocks.append(spark.sparkContext.broadcast(item_windows([(r["id"], r["text"]) for r in rows.collect()], window)))
    keep = [c for c in docs.columns if c not in own]
    at = keep.index(text_col)
    spans = "array<struct<start:bigint,end:bigint>>"
    out = docs.select(*keep).withColumns({
        "n_words": F.lit(None).cast("bigint"),
        "n_hit": F.lit(None).cast("bigint"),
        "items": F.lit(None).cast("array<string>"),
        "hit_spans": F.lit(None).cast(spans),
        "_hits": F.lit(None).cast(spans),
    })
    for block in blocks or [spark.sparkContext.broadcast({})]:
        out = out.mapInArrow(_pass(block, at, len(keep)), out.schema)
    return out.drop("_hits")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(block: Broadcast, at: int, n_keep: int):
    """One reading of the documents; ``_hits`` and ``items`` hold what earlier passes have found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Scanner(block.value)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                texts = part.column(at).to_pylist()
                words = [normal_words(t) for t in texts]
                had, hits = part.column(n_keep + 2).to_pylist(), part.column(n_keep + 4).to_pylist()
                ranges, items = [], []
                for w, old_items, old_hits in zip(words, had, hits):
                    hit, found = find(w)
                    ranges.append(merged(hit + [(x["start"], x["end"]) for x in old_hits or ()]))
                    items.append(sorted(found.union(old_items or ())))
                offsets = [word_spans(t, r) if r else [] for t, r in zip(texts, ranges)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:n_keep],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
                        pa.array(items, pa.list_(pa.string())),
                        *(pa.array([[{"start": a, "end": b} for a, b in x] for x in y], _SPANS) for y in (offsets, ranges)),
                    ],
                    part.schema.names,
                )

    return scan


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest_items(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return find_contamination(docs, benchmark, **options).filter("n_hit = 0").select(*docs.columns)

