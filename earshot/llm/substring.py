"""Substring dedup: words covered by a repeated window of words are removed.

A window is ``window`` consecutive words.  Its minimiser is the least hash of the ``order`` consecutive
words in it, so equal windows have equal minimisers.  Consecutive windows of a text that share a minimiser
form one piece, and travel as one packed string to their bucket, the minimiser:

1. Minimisers alone are counted over the corpus; a window can only repeat where its minimiser occurs again,
   in another piece or once more in its own text.
2. Texts that hold repeated minimisers pack those pieces.  In a bucket, the windows of all pieces are
   sorted and equal ones counted, on the words themselves.
3. Texts take back the ranges of repeated windows, and the words they cover are removed.

Equal texts collapse first and count as often as they occur, so a group of copies is packed once.  A
minimiser with more than ``hot`` pieces (a passage that very many texts share) is split by window: such
pieces send digests of their windows, which are counted map-side before the shuffle and joined back.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; a window
that repeats within one text counts as repeated; rows that repeat are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import WordHashes, mixed, plain_words, rolling, slices, word_hashes
from earshot.sources.shared import cut

WINDOW = 35
#: Words in what a minimiser is chosen from.  Longer ones repeat less often by chance, shorter ones give longer pieces.
ORDER = 8
#: Pieces of one minimiser beyond which its windows are counted one by one.
HOT = 256
#: Words of packed pieces that are counted together; a bucket is never split.
COUNT_WORDS = 1 << 18

_FACTOR = 0x2545F4914F6CDD1D


def text_key(text: Column) -> Column:
    """The first half of a text's SHA-256; null is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def minimisers(h: np.ndarray, window: int, order: int) -> np.ndarray:
    """The minimiser of every window of word hashes."""
    grams = rolling(h, order, _FACTOR)
    left, out, span = window - order + 1, grams, 1
    while span * 2 <= left:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    if span < left:
        out = np.minimum(out[: len(grams) - left + 1], out[left - span :])
    return out


def pieces(words: list[bytes], window: int, order: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers of the pieces of a text, and the first window of each, with the number of windows at the end."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    low = minimisers(hashes.of(words), window, order)
    first = np.concatenate(([0], np.nonzero(low[1:] != low[:-1])[0] + 1))
    return low[first], np.append(first, len(low))


def _list_pieces(window: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for part in slices(batch):
                lows, keys, numbers, again = [], [], [], []
                for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = plain_words(text)
                    low, _ = pieces(words, window, order, hashes)
                    lows.append(low)
                    again.append(_again(words, low, order, hashes))
                    keys += [key] * len(low)
                    numbers.append(np.arange(len(low)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "low": pa.array(np.concatenate(lows).view(np.int64)),
                        "key": pa.array(keys, pa.binary()),
                        "piece": pa.array(np.concatenate(numbers), pa.int32()),
                        "again": pa.array(np.concatenate(again)),
                    }
                )

    return run


def _again(words: list[bytes], low: np.ndarray, order: int, hashes: WordHashes) -> np.ndarray:
    """Which minimisers occur more than once in their own text."""
    if not len(low):
        return np.zeros(0, bool)
    grams = np.sort(rolling(hashes.of(words), order, _FACTOR))
    twice = grams[1:][grams[1:] == grams[:-1]]
    return np.isin(low, twice) if len(twice) else np.zeros(len(low), bool)


def _pack(window: int, order: int):
    """The wanted pieces of each text as packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for part in slices(batch):
                out: dict[str, list] = {"low": [], "key": [], "start": [], "copies": [], "packed": []}
                for key, text, copies, wanted in zip(*(c.to_pylist() for c in part.columns)):
                    words = plain_words(text)
                    low, first = pieces(words, window, order, hashes)
                    low = low.view(np.int64)
                    for i in wanted:
                        a, b = int(first[i]), int(first[i + 1]) + window - 1
                        out["low"].append(low[i])
                        out["key"].append(key)
                        out["start"].append(a)
                        out["copies"].append(copies)
                        out["packed"].append(b" ".join(words[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["low"], pa.int64()),
                        pa.array(out["key"], pa.binary()),
                        pa.array(out["start"], pa.int32()),
                        pa.array(out["copies"], pa.int64()),
                        pa.array(out["packed"], pa.binary()),
                    ],
                    list(out),
                )

    return run


def _digest_windows(window: int, order: int):
    """The different windows of the wanted pieces as digests, with all places of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for part in slices(batch):
                digests, keys, starts, weights = [], [], [], []
                for key, text, copies, wanted in zip(*(c.to_pylist() for c in part.columns)):
                    words = plain_words(text)
                    _, first = pieces(words, window, order, hashes)
                    own: dict[bytes, list[int]] = {}
                    for i in wanted:
                        for a in range(int(first[i]), int(first[i + 1])):
                            body = b" ".join(words[a : a + window])
                            own.setdefault(hashlib.blake2b(body, digest_size=16).digest(), []).append(a)
                    digests += own
                    keys += [key] * len(own)
                    starts += own.values()
                    weights += [copies * len(x) for x in own.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.binary()),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(weights, pa.int64()),
                    ],
                    ["digest", "key", "starts", "times"],
                )

    return run


def repeated_windows(packed: list[bytes], copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of every window that occurs more than once among the packed pieces.

    Windows are sorted by a hash, and neighbours compared word by word; should different windows ever
    share a hash, that run is counted by its words.
    """
    numbers: dict[bytes, int] = {}
    rows = [p.split(b" ") for p in packed]
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for r in rows for w in r), np.int64)
    sizes = np.array([len(r) for r in rows], np.int64)
    base, n = np.cumsum(sizes) - sizes, sizes - window + 1
    row = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + offset
    hashed = rolling(mixed(ids.astype(np.uint64) + np.uint64(1)), window, _FACTOR)[at]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    starts = np.concatenate(([0], np.nonzero(~same)[0] + 1))
    run = np.cumsum(np.concatenate(([0], ~same)))
    often = np.add.reduceat(copies[row[order]], starts) > 1
    hit = often[run]
    a, b = at[order[:-1]][same], at[order[1:]][same]
    unlike = np.zeros(len(a), bool)
    for j in range(window):
        unlike |= ids[a + j] != ids[b + j]
    if unlike.any():
        for r in np.unique(run[1:][same][unlike]):
            members = np.nonzero(run == r)[0]
            found: dict[bytes, list[int]] = {}
            for m in members:
                p = at[order[m]]
                found.setdefault(ids[p : p + window].tobytes(), []).append(m)
            for group in found.values():
                hit[group] = copies[row[order[group]]].sum() > 1
    chosen = np.sort(order[hit])
    return row[chosen], offset[chosen]


def _ranges(row: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows as (row, first word, word after the last); input in order."""
    if not len(row):
        return row, first, first
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)))
    begin = np.nonzero(new)[0]
    last = np.append(begin[1:], len(row)) - 1
    return row[begin], first[begin], first[last] + window


def _count(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0

        def flush() -> pa.RecordBatch:
            _, keys, starts, copies, packed = zip(*held)
            row, offset = repeated_windows(list(packed), np.array(copies, np.int64), window)
            row, a, b = _ranges(row, np.array(starts, np.int64)[row] + offset, window)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[r] for r in row], pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                ["key", "a", "b"],
            )

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and words >= COUNT_WORDS and x[0] != held[-1][0]:
                    yield flush()
                    held, words = [], 0
                held.append(x)
                words += x[4].count(b" ") + 1
        if held:
            yield flush()

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for key, text, copies, ranges in zip(*(c.to_pylist() for c in part.columns)):
                    words = plain_words(text)
                    gone = np.zeros(len(words), bool)
                    if copies > 1 and len(words) >= window:
                        gone[:] = True
                    for r in ranges or ():
                        gone[r["a"] : r["b"]] = True
                    kept = b" ".join(w for w, g in zip(words, gone) if not g) if gone.any() else b" ".join(words)
                    out.append((key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                keys, n, removed, digest, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(n, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(digest),
                        pa.array(kept, pa.string()),
                    ],
                    ["key", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def substring_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    order: int = ORDER,
    hot: int = HOT,
    with_text: bool = True,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)`` per row; ``with_text=False`` leaves the last out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text"), text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"))
    listed = cut(
        rows.select("text", "key").mapInArrow(_list_pieces(window, order), "low bigint, key binary, piece int, again boolean"),
        "pieces",
    )
    # Counts are written before they are joined: a hot key on the other side of the join can then be split.
    often = cut(
        listed.groupBy("low").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).filter("n > 1"), "often"
    )
    wanted = cut(
        listed.join(often, "low").groupBy("key", (F.col("n") > hot).alias("hot")).agg(
            F.array_sort(F.collect_set("piece")).alias("wanted")
        ),
        "wanted",
    )
    # One shuffle of the texts serves the three joins below: each finds them by their key already.
    # (No key is null; said here, as the inner joins would add it below the shuffle, and only they.)
    texts = rows.filter("key is not null").groupBy("key").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )

    def with_pieces(is_hot: bool) -> DataFrame:
        own = wanted.filter(F.col("hot") == is_hot).select("key", "wanted")
        return texts.join(own.hint("shuffle_hash"), "key").select("key", "text", "copies", "wanted")

    packed = with_pieces(False).mapInArrow(
        _pack(window, order), "low bigint, key binary, start int, copies bigint, packed binary"
    )
    counted = (
        packed.repartition("low").sortWithinPartitions("low").mapInArrow(_count(window), "key binary, a int, b int")
    )
    single = cut(
        with_pieces(True).mapInArrow(
            _digest_windows(window, order), "digest binary, key binary, starts array<int>, times bigint"
        ),
        "hot-windows",
    )
    twice = single.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest")
    found = single.join(cut(twice, "twice"), "digest").select("key", F.explode("starts").alias("a"))
    shared = found.select("key", "a", (F.col("a") + window).alias("b"))
    ranges = counted.unionByName(shared).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    done = (
        texts.join(ranges.hint("shuffle_hash"), "key", "left")
        .select("key", "text", "copies", "ranges")
        .mapInArrow(_remove(window), "key binary, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    )
    columns = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return rows.select("doc_id", "key").join(done.select("key", *columns), "key").select("doc_id", *columns)
