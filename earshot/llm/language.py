"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to four bytes.  A byte's code length is that of the
longest known context: where the byte has not followed it, an escape is paid and the next shorter context
asked (escape method C: of n occurrences with d different followers, d / (n + d) escapes; no exclusions),
down to equal chances for all bytes.  Statistics are frozen after fitting, so a code length depends on the
byte and the four bytes before it alone, and a text's code length is an exact sum over all of its bytes.
The language with the shortest code wins; the score is its posterior with equal priors.

The fit takes a bounded number of labelled rows per language, chosen by a hash; scoring covers every row.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything when
nothing could be learned; equal code lengths go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import different, encoded, hash_limit, slices

ORDER = 4
UNKNOWN = "und"


#: Bytes worked on at once.
_CHUNK = 1 << 20


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with zero bytes before each, and where each text starts and ends."""
    raw = [encoded(t) for t in texts]
    ends = np.cumsum(np.array([len(r) + ORDER for r in raw], np.int64))
    gap = bytes(ORDER)
    return np.frombuffer(gap + gap.join(raw), np.uint8), ends - [len(r) for r in raw], ends


def grams(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Each byte from a to b (a is ``ORDER`` or more) with those before it as one number."""
    out = data[a:b].astype(np.uint64)
    for i in range(1, ORDER + 1):
        out |= data[a - i : b - i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _has_letter(text: str) -> bool:
    """Whether there is a character of category L; fractions, raised digits and Roman numerals are none."""
    return any(map(str.isalpha, text))


class ContextTree:
    """Followers of all contexts of one language, as sorted arrays per order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            gram, at = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(at, counts)
            context, of = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of).astype(float)
            self.orders.append((gram, n, context, total, kinds))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram's last byte."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        for order in range(ORDER, -1, -1):
            gram, n, context, total, kinds = self.orders[order]
            key = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(context, key >> np.uint64(8)), len(context) - 1)
            known = open_ & (context[at] == key >> np.uint64(8))
            to = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            seen = known & (gram[to] == key)
            out[seen] -= np.log2(n[to[seen]] / (total[at[seen]] + kinds[at[seen]]))
            open_ &= ~seen
            paid = known & open_
            out[paid] -= np.log2(kinds[at[paid]] / (total[at[paid]] + kinds[at[paid]]))
        out[open_] += 8.0
        return out


class PpmModel:
    """Context trees of several languages, and a table of the code lengths asked for before."""

    SLOTS = 1 << 19

    def __init__(self, trees: dict[str, ContextTree]):
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        self.keys = self.values = None

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths of whole texts in bits, one column per language."""
        data, starts, ends = joined(texts)
        out = np.zeros((len(texts), len(self.trees)))
        for a in range(ORDER, len(data), _CHUNK):
            b = min(len(data), a + _CHUNK)
            keys = grams(data, a, b)
            slot = self._slots(keys)
            # Grams whose slot another one holds are looked up in the trees, each different one once.
            lost = np.nonzero(self.keys[slot] != keys)[0]
            rest, of = np.unique(keys[lost], return_inverse=True)
            here = slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left")))
            lo, hi = np.maximum(starts[here], a) - a, np.minimum(ends[here], b) - a
            total = np.zeros(b - a + 1)
            for j in range(len(self.trees)):
                bits = self.values[j][slot]
                if len(lost):
                    bits[lost] = self.trees[j].bits(rest)[of]
                np.cumsum(bits, out=total[1:])
                out[here, j] += total[hi] - total[lo]
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The table's slot of each key, after entering what it does not hold yet."""
        if self.keys is None:
            self.keys = np.full(self.SLOTS, np.iinfo(np.uint64).max, np.uint64)
            self.values = np.zeros((len(self.trees), self.SLOTS))
        slot = self._place(keys)
        missing = self.keys[slot] != keys
        if missing.any():
            new = np.unique(keys[missing])
            at = self._place(new)
            self.keys[at] = new
            # Of keys that share a slot one is entered; its value must be that of the key that stayed.
            stayed = self.keys[at] == new
            for j, tree in enumerate(self.trees):
                self.values[j, at[stayed]] = tree.bits(new[stayed])
        return slot

    def predict(self, text_list: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(text_list), np.zeros(len(text_list))
        asked = [i for i, t in enumerate(text_list) if t and _has_letter(t)] if self.trees else []
        if asked:
            bits = self.lengths([text_list[i] for i in asked])
            best = bits.argmin(axis=1)
            gap = bits - bits[np.arange(len(asked)), best][:, None]
            scores[asked] = 1.0 / np.exp2(-gap).sum(axis=1)
            for i, b in zip(asked, best):
                names[i] = self.languages[b]
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts per language, summed over a slice."""
    for batch in batches:
        for part in slices(batch):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                data, starts, ends = joined([t for t, x in zip(texts, langs) if x == lang])
                inside = np.zeros(len(data) + 1, np.int8)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                if len(data) > ORDER:
                    own = np.cumsum(inside[:-1])[ORDER:] > 0
                    keys, n = np.unique(grams(data, ORDER, len(data))[own], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang] * len(keys), "gram": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())}
                    )


def fit_ppm(
    docs: DataFrame,
    learn: Column,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 600,
    max_languages: int = 500,
) -> PpmModel:
    """A model of the languages of rows where ``learn`` holds and text and language are not null.

    At most ``max_rows`` different texts of each language are read for it (those with the smallest hashes), and at
    most ``max_languages`` languages are allowed.
    """
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.filter(learn & text.isNotNull() & lang.isNotNull()).select(
        text.alias("text"), lang.cast("string").alias("lang"), F.xxhash64(text).alias("mark")
    )
    sizes = rows.groupBy("lang").agg(different(F.col("mark")).alias("n")).limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return PpmModel({})
    names = [r["lang"] for r in sizes]
    # Copies share a hash and count once, so each language's limit follows from its different texts.
    last = [(r["lang"], hash_limit(max_rows, r["n"])) for r in sizes]
    limits = F.broadcast(docs.sparkSession.createDataFrame(last, "lang string, last bigint"))
    few = rows.join(limits, "lang").filter(F.col("mark") <= F.col("last"))
    few = few.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = few.withColumn("place", place).filter(F.col("place") <= max_rows).select("text", "lang")
    counted = chosen.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    trees = {}
    langs = np.array(table.column("lang").to_pylist())
    keys = table.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    n = table.column("n").to_numpy().astype(float)
    for name in names:
        own = langs == name
        if own.any():
            trees[name] = ContextTree(keys[own], n[own])
    return PpmModel(trees)


def predict_language(docs: DataFrame, model: PpmModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = keep.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep).withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = PpmModel(dict(zip(shared.value.languages, shared.value.trees)))
        for batch in batches:
            for part in slices(batch, text_col):
                names, scores = one.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores)], part.schema.names
                )

    return out.mapInArrow(predict, out.schema)
