"""Row-local text expressions.  Each returns a Column; they work on batch and streaming frames."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions import lexicons as lx

# Unicode white space plus the ASCII separators 1C-1F.  The syntax is valid in Java and in RE2.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# All of these but the blank.  The ranges settle letters and blanks with few comparisons.
_WIDE = rf"[\x{{0}}-\x{{1f}}\x{{7f}}-\x{{10ffff}}&&[{WS}]]"
URL = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"
LEADING_NOISE = rf"^[{WS}.\-_•·]+"
# The byte-order mark FEFF sits at the end of the last block and is left out: it is not a letter.
ARABIC = r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefe}]"
LATIN = "[A-Za-z]"

# Characters beyond ASCII that NFKC leaves alone whatever their neighbours are.  Rows made only of these
# and ASCII skip the Python step, which covers nearly all Latin and Arabic text.
NFKC_STABLE = (
    r"¡-§©«¬®°±¶·»¿À-ıĴ-ľŁ-ňŊ-žƀ-ƃ–—‘’‚“”„•€"
    r"\x{60c}\x{61b}\x{61f}\x{621}-\x{63a}\x{641}-\x{64a}\x{660}-\x{669}\x{66e}-\x{66f}\x{679}-\x{6bf}\x{6d4}"
)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form.  Text already known to be stable reaches the Python worker as NULL only."""
    # The intersection settles ASCII characters with one comparison.
    unstable = F.when(text.rlike(rf"[\x{{80}}-\x{{10ffff}}&&[^{NFKC_STABLE}]]"), text)
    return F.coalesce(_nfkc(unstable), text)


def _blanks(text: Column) -> Column:
    """White-space runs to one blank.  A single blank, which most runs are, is neither matched nor replaced."""
    return F.regexp_replace(F.regexp_replace(text, _WIDE, " "), "  +", " ")


def collapse(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed; NULL stays NULL."""
    return F.trim(_blanks(text))


def clean_text(text: Column, *, normalise: bool = True) -> Column:
    """NFKC, URLs to blanks, white space collapsed, leading dots / dashes / bullets dropped; blank gives ``""``."""
    t = F.coalesce(text, F.lit(""))
    t = nfkc(t) if normalise else t
    t = F.regexp_replace(t, URL, " ")
    return F.trim(F.regexp_replace(_blanks(t), LEADING_NOISE, ""))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is costly to compute.

    A later filter on it stays above the one place that computes it, where a plain projection would have
    the filter pushed below, with the whole expression repeated in it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{WS}]")


def detect_language(
    text: Column,
    *,
    strong: Iterable[str] = lx.STRONG_LANGUAGE_MARKERS,
    weak: Iterable[str] = lx.WEAK_LANGUAGE_MARKERS,
) -> Column:
    """One of blank, mixed, urdu_script, roman_urdu, english, other."""
    arabic, latin = text.rlike(ARABIC), text.rlike(LATIN)
    marked = text.rlike(lx.word_pattern(strong)) | (F.regexp_count(text, F.lit(lx.word_pattern(weak))) >= 2)
    return (
        F.when(is_blank(text), "blank")
        .when(arabic & latin, "mixed")
        .when(arabic, "urdu_script")
        .when(latin & marked, "roman_urdu")
        .when(latin, "english")
        .otherwise("other")
    )


def n_chars(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WS}]+"))


def n_lines(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + (F.length(t) > 0).cast("int")


def clip_text(text: Column, limit: int = 170) -> Column:
    """Collapsed text, cut to ``limit - 1`` characters plus an ellipsis when longer than ``limit``."""
    t = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def has_word(text: Column, words: Iterable[str]) -> Column:
    return F.coalesce(text, F.lit("")).rlike(lx.word_pattern(words))


def risk_signals(text: Column, lexicon: Mapping[str, Iterable[str]] = lx.RISK_SIGNALS) -> dict[str, Column]:
    """``signal_<name>`` 0/1 columns, one per lexicon entry."""
    return {f"signal_{name}": has_word(text, words).cast("int") for name, words in lexicon.items()}


def matching_tags(corpus: Column, lexicon: Mapping[str, Iterable[str]] = lx.SENSITIVITY_TAGS) -> Column:
    """All matching tags in dictionary order; may be empty."""
    return F.array_compact(F.array(*[F.when(has_word(corpus, words), F.lit(tag)) for tag, words in lexicon.items()]))


def tags_or_default(found: Column, default: str = lx.DEFAULT_TAG) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def gram_text(text: Column) -> Column:
    """The form of a text that character n-grams are taken from."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def char_ngrams(cleaned: Column, n: int = 5) -> Column:
    """Distinct n-grams of an already prepared text, in one regex pass (linear in the text length)."""
    grams = F.regexp_extract_all(cleaned, F.lit(rf"(?s)(?=([^\x{{d800}}-\x{{dfff}}].{{{n - 1}}}))"), F.lit(1))
    return (
        F.when(F.length(cleaned) >= n, F.array_distinct(grams))
        .when(F.length(cleaned) > 0, F.array(cleaned))
        .otherwise(F.array().cast("array<string>"))
    )


def gram_summary(prepared: Column, n: int = 5) -> Column:
    """``struct<n_grams, first, last>``: the size, least and greatest element of the set ``char_ngrams`` gives.

    The set is sorted as numbers in the task, so that it takes no string for every gram.
    """

    @F.pandas_udf("n_grams int, first string, last string")
    def summarise(text: pd.Series) -> pd.DataFrame:
        found = _summaries([t or "" for t in text], n)
        return pd.DataFrame(found, columns=["n_grams", "first", "last"]).astype({"n_grams": "int32"})

    return summarise(prepared)


def _summaries(texts: list[str], n: int, step: int = 1 << 18) -> list[tuple[int, str | None, str | None]]:
    """Texts are laid end to end up to ``step`` characters, or one text, and their grams become keys in few calls."""
    out = [(1, t, t) if t else (0, None, None) for t in texts]
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < n:
            continue
        if held and size + len(t) > step:
            _summarise(texts, held, n, out)
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        _summarise(texts, held, n, out)
    return out


def _summarise(texts: list[str], held: list[int], n: int, out: list) -> None:
    joined = "".join([texts[i] for i in held])
    keys = _gram_keys(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), n)
    spans, start = [], 0
    for i in held:
        # Keys of grams that reach into the next text lie between the spans.
        end = start + len(texts[i]) - n + 1
        own = keys[start:end]
        spans.append((i, start, end, int(own.argmin()), int(own.argmax())))
        own.sort()
        start = end + n - 1
    steps = np.cumsum(keys[1:] != keys[:-1])
    steps = np.concatenate([[0], steps])
    for i, start, end, low, high in spans:
        t = texts[i]
        out[i] = (int(steps[end - 1] - steps[start]) + 1, t[low : low + n], t[high : high + n])


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for every ``n`` consecutive characters, equal and in order as the grams are."""
    seen = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen[codes] = True
    ranks = (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[codes].astype(np.uint64)
    bits = max(1, int(ranks.max()).bit_length())
    m = len(codes) - n + 1
    keys, used = ranks[:m].copy(), bits
    for i in range(1, n):
        if used + bits > 64:
            # A large alphabet: what was joined so far is numbered anew, in order.
            keys = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
            used = max(1, int(keys.max()).bit_length())
        keys <<= np.uint64(bits)
        keys |= ranks[i : m + i]
        used += bits
    return keys


def ascii_words(text: Column, min_letters: int = 3) -> Column:
    """Lower-cased words made only of ASCII letters; a word touching another script's letter does not count."""
    word_char = r"[\p{L}\p{N}_]"
    return F.regexp_extract_all(
        F.lower(text), F.lit(rf"(?<!{word_char})[a-z]{{{min_letters},}}(?!{word_char})"), F.lit(0)
    )
