"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on which words, and beginnings of words, a text has.  Besides the loss on the labels it is penalised for
every change of score when the identity terms of a labelled text are swapped for their counterparts, so
a neutral mention of a group does not raise the score.

The fit takes a bounded number of labelled rows, chosen by a hash of the text, equal texts once.  Words
are counted by Spark and chosen by their likelihood ratio with the label; identity terms are always among
them.  Only the chosen words' codes reach the driver.  Scoring reads every whole text.

Defined results: null and empty texts score as a text without any known word; labels other than 0 and 1
and null labels are not learned from; without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import mixed, normal_words, slices, word_hashes
from earshot.sources.shared import cut, cut_measured

#: Tasks that the sample is dealt to.
PARTS = 16

#: Terms for groups of people that are swapped for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("trans", "cis"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "hindu"), ("jews", "hindus"),
    ("black", "white"), ("asian", "european"), ("african", "american"),
    ("immigrants", "locals"), ("immigrant", "local"), ("refugees", "residents"),
    ("old", "young"), ("disabled", "able"), ("deaf", "hearing"), ("blind", "sighted"),
)


def features(text: str | None) -> set[bytes]:
    """The different words of a text, and their beginnings of four and six bytes with a star."""
    return _with_beginnings(set(normal_words(text)))


def swapped_features(text: str | None, swaps: dict[bytes, bytes]) -> set[bytes]:
    """The features of the text in which each identity term is its counterpart."""
    return _with_beginnings({swaps.get(w, w) for w in normal_words(text)})


def _with_beginnings(words: set[bytes]) -> set[bytes]:
    return words.union([w[:4] + b"*" for w in words if len(w) > 4], [w[:6] + b"*" for w in words if len(w) > 6])


def _swaps(pairs: Sequence[tuple[str, str]]) -> dict[bytes, bytes]:
    out = {}
    for a, b in pairs:
        out[a.encode()], out[b.encode()] = b.encode(), a.encode()
    return out


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    intercept: float
    empty: bool = False

    def score(self, found: set[bytes]) -> float:
        if self.empty:
            return 0.0
        z = self.intercept + sum(map(self.weights.__getitem__, self.weights.keys() & found))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _features(swaps: dict[bytes, bytes], hashes: int = 8):
    """What the fit needs of a text: features, those a swap adds and takes away, and minwise features."""
    seeds = np.random.default_rng(7).integers(0, 2**64, hashes, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for batch in batches:
            for part in slices(batch):
                lists: tuple[list, ...] = ([], [], [], [])
                for text in part.column(0).to_pylist():
                    words, after = features(text), swapped_features(text, swaps)
                    found = sorted(words)
                    h = known.of(found)
                    least = [int(mixed(h ^ s).min()) if len(h) else 2**64 - 1 for s in seeds]
                    for out, x in zip(lists, (found, sorted(after - words), sorted(words - after))):
                        out.append(x)
                    lists[3].append(np.array(least, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        part.column(2),
                        *[pa.array(x, pa.list_(pa.binary())) for x in lists[:3]],
                        pa.array(lists[3], pa.list_(pa.int64())),
                    ],
                    ["mark", "label", "words", "gained", "lost", "least"],
                )

    return run


_SAMPLE = "mark bigint, label int, words array<binary>, gained array<binary>, lost array<binary>, least array<bigint>"


def fit_toxicity(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    label_col: str = "toxic",
    mark_col: str | None = None,
    learn: Column | None = None,
    max_rows: int = 12_000,
    max_words: int = 600,
    min_rows: int = 3,
    swap_penalty: float = 1.0,
    shrink: float = 0.05,
    identity: Sequence[tuple[str, str]] = IDENTITY,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` texts (smallest hashes) of rows where ``learn`` holds.

    ``mark_col`` holds xxhash64 of the text; taken before labels are joined, it spares that join the texts.
    ``max_words`` bounds the chosen words, ``min_rows`` is the least number of (unlike) rows that hold one.
    """
    text, label = F.col(text_col), F.col(label_col)
    mark = F.col(mark_col) if mark_col else F.xxhash64(text)
    rows = labelled.filter(learn) if learn is not None else labelled
    rows = rows.filter(text.isNotNull() & label.isin(0, 1)).select(
        text.alias("text"), label.cast("int").alias("label"), mark.alias("mark")
    )
    # Of equal texts one is kept, with the higher label; so the smallest different hashes are taken, not rows.
    last = rows.select("mark").distinct().orderBy("mark").limit(max_rows).agg(F.max("mark")).first()[0]
    if last is None:
        return ToxicityModel({}, 0.0, empty=True)
    few = rows.filter(F.col("mark") <= last).groupBy("mark").agg(F.first("text").alias("text"), F.max("label").alias("label"))
    chosen = few.select("text", "mark", "label")
    swaps = _swaps(identity)
    sample = cut(chosen.repartition(PARTS, "mark").mapInArrow(_features(swaps), _SAMPLE), "toxicity-sample")
    # Labels and minwise features reach the driver, then words chosen by counts, then the codes of these.
    head = sample.select("mark", "label", "least").toArrow().sort_by("mark")
    y = head.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, 0.0, empty=True)
    share = _shares(head.column("least").combine_chunks().flatten().to_numpy().reshape(len(y), -1))
    weighed = rows.sparkSession.createDataFrame(pa.table({"mark": head.column("mark"), "share": share}))
    kept = _choose(sample, weighed, (share.sum(), share @ y), max_words, min_rows)
    kept += [w for w in sorted(swaps) if w not in set(kept)]
    codes = sample.select("mark", "words", "gained", "lost").mapInArrow(_codes(kept), _CODES).toArrow().sort_by("mark")
    x, gained, lost = (_matrix(codes.column(c), len(kept) + 1) for c in ("words", "gained", "lost"))
    x[:, -1] = 1
    weights = _newton(x, y, share, gained - lost, swap_penalty, shrink)
    model = ToxicityModel(dict(zip(kept, weights[:-1].tolist())), float(weights[-1]))
    del head, codes
    pa.default_memory_pool().release_unused()
    return model


def _choose(
    sample: DataFrame, weighed: DataFrame, totals: tuple[float, float], max_words: int, min_rows: int, margin: float = -4.0
) -> list[bytes]:
    """The words with the highest likelihood ratios; ``totals``: the shares of all rows and of the positive ones."""
    each = sample.join(F.broadcast(weighed), "mark").select("label", "share", F.explode("words").alias("word"))
    counts, seen = cut_measured(
        each.groupBy("word").agg(F.sum("share").alias("n"), F.sum(F.col("share") * F.col("label")).alias("t")),
        "toxicity-words",
        names=F.count(F.lit(1)),
    )

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, t = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            gain = np.round(_likelihood_ratio(n, t, *totals), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain)], ["word", "gain"])

    # Of very many words some look telling by chance; a kept one has to beat their number.
    least = float(np.log(max(1, seen["names"])) + margin)
    often = counts.filter(F.col("n") >= min_rows - 1e-6).mapInArrow(gains, "word binary, gain double")
    best = often.filter(F.col("gain") > max(-1.0, least)).orderBy(F.desc("gain"), "word").limit(max_words)
    return [bytes(r["word"]) for r in best.select("word").collect()]


_CODES = "mark bigint, words array<smallint>, gained array<smallint>, lost array<smallint>"


def _codes(kept: Sequence[bytes]):
    """Places in ``kept`` of the words in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = {w: j for j, w in enumerate(kept)}
        for batch in batches:
            out = [
                pa.array([[column[w] for w in ws if w in column] for ws in batch.column(i).to_pylist()], pa.list_(pa.int16()))
                for i in (1, 2, 3)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["mark", "words", "gained", "lost"])

    return run


def _matrix(codes: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = codes.combine_chunks()
    x = np.zeros((len(lists), width), np.int8)
    x[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = 1
    return x


def _shares(least: np.ndarray) -> np.ndarray:
    """What each row counts: rows that are much alike count as one together.

    Rows with equal minwise words fall into one group per hash; unlike rows soon fall apart, so the smallest
    of a row's groups is about as large as its set of near copies.
    """
    size = np.full(len(least), len(least))
    for values in least.T:
        _, group, n = np.unique(values, return_inverse=True, return_counts=True)
        size = np.minimum(size, n[group])
    # Sums of whole multiples of 2**-32 are exact, in whatever order tasks add them.
    return np.round(2.0**32 / size) / 2.0**32


def _likelihood_ratio(n, t, rows, positives):
    def part(k, m):
        k, m = np.clip(k, 0, None), np.clip(m, 0, None)
        p = np.clip(k / np.maximum(m, 1e-9), 0, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 1e-9, k * np.log(p), 0.0) + np.where(m - k > 1e-9, (m - k) * np.log1p(-p), 0.0)

    return part(t, n) + part(positives - t, rows - n) - part(np.full_like(t, positives), np.full_like(n, rows))


def _newton(x, y, share, change, swap_penalty, shrink, rounds: int = 30):
    """Minimise log loss + swap_penalty * squared change of score under swaps + shrinkage.

    Shrinkage leaves the intercept alone; the step is halved until the objective falls.
    """
    ridge = np.full(x.shape[1], shrink)
    ridge[-1] = 0.0
    fixed = np.diag(ridge)
    # The matrices hold bytes and are widened a block of rows at a time.
    parts = [slice(a, a + 1024) for a in range(0, len(y), 1024)]
    for at in parts:
        moved = change[at].any(axis=1)
        c = change[at][moved].astype(float)
        fixed += 2 * swap_penalty * (c.T @ (c * share[at][moved, None]))
    w = np.zeros(x.shape[1])

    def linear(v):
        return np.concatenate([x[at].astype(float) @ v for at in parts])

    def objective(v):
        z = linear(v)
        return share @ (np.logaddexp(0, z) - y * z) + 0.5 * v @ fixed @ v

    value = objective(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(linear(w), -500, 500)))
        slope, curve = fixed @ w, fixed + 1e-9 * np.eye(len(w))
        for at in parts:
            c = x[at].astype(float)
            slope += c.T @ (share[at] * (p[at] - y[at]))
            curve += (c * (share[at] * p[at] * (1 - p[at]))[:, None]).T @ c
        step, size = np.linalg.solve(curve, slope), 1.0
        while (after := objective(w - size * step)) > value and size > 1e-6:
            size /= 2
        w, before, value = w - size * step, value, after
        if before - after < 1e-7 * abs(before):
            break
    return w


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    at = keep.index(text_col)
    out = docs.select(*keep).withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = np.array([model.score(features(t)) for t in part.column(at).to_pylist()], float)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    part.schema.names,
                )

    return out.mapInArrow(score, out.schema)


def keep_clean(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold."""
    keep = docs.columns
    at = keep.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                ok = [model.score(features(t)) < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(clean, docs.schema)
