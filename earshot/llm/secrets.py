"""Secret scans with corpus-wide ownership frequency.

A scan finds candidates in every text.  Their hashes are then counted over the whole corpus by distinct
repositories and owners: a value that several owners hold is a widely copied example, one that a single
owner holds in few repositories looks live.  Base candidates are always reported; added ones only if live.

Patterns take time linear in the text, however long.

Defined results: a null text is empty; a null owner or repository counts as one value of its own; rows
that repeat are reported each, and count once for ownership.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import slices
from earshot.sources.shared import cut

# Fixed values of the base scan: kinds in order, patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Further kinds: the text that must occur, and the pattern.
ADDED = (
    ("forge", "gh", re.compile("gh[oprsu]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile("xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", "-----BEGIN", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+")),
    ("opaque", "", re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")),
)
#: Least Shannon entropy, in bits a character, of an ``opaque`` value.
OPAQUE_BITS = 3.75

KINDS = (*BASE_KINDS, *(k for k, _, _ in ADDED))
Span = tuple[int, int, str, str]


def base_spans(text: str) -> list[Span]:
    """``(start, end, kind, value)``, leftmost and non-overlapping per kind, too short ones dropped."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # The pattern is greedy on one class, so runs of 32 or more are exactly the long enough maximal runs.
    out += [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=_place)


def added_spans(text: str, base: Sequence[Span]) -> list[Span]:
    """Candidates of the further kinds that overlap no base span nor one of a kind before theirs."""
    taken = _merged([(s, e) for s, e, _, _ in base])
    out: list[Span] = []
    for kind, must, pattern in ADDED:
        if must not in text:
            continue
        starts = [s for s, _ in taken]
        new: list[Span] = []
        for m in pattern.finditer(text):
            s, e = m.span()
            # Taken places do not overlap, so the last that begins before the end reaches furthest.
            before = bisect_left(starts, e) - 1
            if (before < 0 or taken[before][1] <= s) and (kind != "opaque" or _opaque(m[0])):
                new.append((s, e, kind, m[0]))
        taken = _merged(taken + [(s, e) for s, e, _, _ in new])
        out += new
    return sorted(out, key=_place)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of all spans, in order and without overlaps."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _place(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def _opaque(value: str) -> bool:
    """Mixed in kind and close to random."""
    if not (re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= OPAQUE_BITS


_SPANS = "array<struct<start:int,end:int,kind:string,hash:binary>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.binary())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        found: tuple[list, list] = [], []
        for text in batch.column(0).to_pylist():
            base = base_spans(text or "")
            for spans, out in ((base, found[0]), (added_spans(text or "", base), found[1])):
                out.append(
                    [
                        {"start": s, "end": e, "kind": k, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()}
                        for s, e, k, v in spans
                    ]
                )
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        arrays = [pa.array(x, _SPAN_TYPE) for x in found]
        yield pa.RecordBatch.from_arrays([*rest, *arrays], [*batch.schema.names[1:], "base", "added"])


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_cols: Sequence[str] = ("source",),
    repository_cols: Sequence[str] = ("source", "lang"),
    most_owners: int = 1,
    most_repositories: int = 2,
) -> DataFrame:
    """``(doc_id, base, added, n_live, n_copied)`` per document.

    ``base`` and ``added`` hold (start, end, kind) in code points, in order; ``added`` only what looks live.
    ``n_live`` and ``n_copied`` split the base candidates.
    """
    ident = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    mark = lambda cols: F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in cols])
    rows = docs.select(
        F.col(text_col).alias("text"),
        F.col(id_col).alias("doc_id"),
        mark(owner_cols).alias("owner"),
        mark(repository_cols).alias("repository"),
    )
    scanned = cut(
        rows.mapInArrow(_scan, f"doc_id {ident}, owner bigint, repository bigint, base {_SPANS}, added {_SPANS}").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "secrets",
    )
    spans = F.concat(
        F.transform("base", lambda x: F.struct(x["hash"].alias("hash"), F.lit(True).alias("is_base"), x.alias("span"))),
        F.transform("added", lambda x: F.struct(x["hash"].alias("hash"), F.lit(False).alias("is_base"), x.alias("span"))),
    )
    found = scanned.select("row", "owner", "repository", F.explode(spans).alias("x")).select(
        "row", "owner", "repository", "x.hash", "x.is_base", "x.span"
    )
    # Distinct (hash, owner, repository) first: a value copied everywhere shrinks before it is counted.
    places = found.select("hash", "owner", "repository").distinct()
    owned = places.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    owned = owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    judged = found.join(owned, "hash").withColumn("live", live)
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(~F.col("is_base") & F.col("live"), F.struct("span.start", "span.end", "span.kind"))).alias("added"),
        F.count_if(F.col("is_base") & F.col("live")).alias("n_live"),
        F.count_if(F.col("is_base") & ~F.col("live")).alias("n_copied"),
    )
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = scanned.select("row", "doc_id", plain.alias("base")).join(per_row, "row", "left")
    return joined.select(
        "doc_id",
        "base",
        F.coalesce(F.array_sort("added"), none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
