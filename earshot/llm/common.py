"""Words, sizes and small column helpers that several operators share.

Words are taken on UTF-8 bytes: ``bytes.split`` cuts at exactly 0x20 and 0x09-0x0D, and bytes of
characters beyond ASCII are never separators.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, so that a batch of long texts stays small in memory.
SLICE_BYTES = 4 << 20

#: Lower-cases A-Z; ASCII bytes that are neither letters nor digits become blanks.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return encoded(text).split()


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return encoded(text).translate(_FOLD).split()


def normal_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of anything beyond ASCII, with A-Z in lower case."""
    return encoded(text).translate(_NORMAL).split()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit word hashes, remembered for a bounded number of words."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What tasks share in a Python worker.  Only what was asked for last is held, which bounds the memory."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and Arrow and malloc keep what they once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def word_hashes() -> WordHashes:
    return kept(("words",), WordHashes)


def rolling(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of every ``n`` consecutive items, as a polynomial modulo 2**64."""
    m = len(h) - n + 1
    out = h[:m].copy()
    step = np.uint64(factor)
    for i in range(1, n):
        out *= step
        out += h[i : i + m]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the argument (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many words ``[^\\x20\\x09-\\x0D]+`` each text has; null has none."""
    if not len(texts):
        return np.zeros(0, np.int64)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out = np.zeros(len(texts), np.int64)
    for a, b in _runs(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if lo == hi:
            continue
        space = _SPACE[raw[lo:hi]]
        start = ~space
        start[1:] &= space[:-1]
        # A text also starts a word where its neighbour in the buffer ends with one.
        firsts = (offsets[a:b] - lo)[offsets[a:b] < offsets[a + 1 : b + 1]]
        start[firsts] = ~space[firsts]
        total = np.concatenate(([0], np.cumsum(start)))
        out[a:b] = total[offsets[a + 1 : b + 1] - lo] - total[offsets[a:b] - lo]
    return out


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    a, n = 0, batch.num_rows
    while a < n:
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def different(mark: Column) -> Column:
    """About how many different 64-bit hashes there are, to two percent; combined before the shuffle."""
    return F.approx_count_distinct(mark, 0.02)


def hash_limit(wanted: int, distinct: int) -> int:
    """Below this 64-bit hash lie about twice the different hashes wanted, or all of them."""
    return min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2 * wanted / max(1, distinct))))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
