"""Filter specifications and the predicates they turn into."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx

TAXONOMY = ("raw_topic", "topic", "parent_issue", "child_issue")
# Levels an issue can be looked up at; the last is the tag list.
LEVELS = (*TAXONOMY, "risk_primary")
SEARCH_FIELDS = ("original_feedback", "child_issue", "parent_issue", "topic")
FILTER_FIELDS = ("classification", "topic", "parent_issue", "child_issue", "sentiment", "severity", "raw_topic")

Drill = Mapping[str, Sequence[str]]


def _all(parts: Iterable[Column]) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return F.lit(True) if out is None else out


def level_is(level: str, value: str) -> Column:
    """Rows belonging to one issue."""
    if level == "risk_primary":
        return F.array_contains("risk_tags", value)
    return F.col(level).cast("string") == value


def drill_predicate(drill: Drill, columns: Sequence[str]) -> Column:
    """Field in its allowed values, for every field; an empty list or an unknown field filters nothing.

    ``risk_primary`` asks for any of the values among a record's tags.
    """
    parts = []
    for name, values in drill.items():
        allowed = [str(v) for v in values]
        if not allowed:
            continue
        if name == "risk_primary":
            parts.append(F.arrays_overlap("risk_tags", F.array(*[F.lit(v) for v in allowed])))
        elif name in columns:
            parts.append(F.col(name).cast("string").isin(allowed))
    return _all(parts)


def keyword_predicate(keyword: str, *, fields: Sequence[str] = SEARCH_FIELDS, regex: bool = False) -> Column:
    """Case-insensitive search in any of the fields; literal unless ``regex``.  NULL does not match."""
    q = keyword.strip().lower()
    if not q:
        return F.lit(True)
    out = F.lit(False)
    for f in fields:
        low = F.lower(F.col(f))
        out = out | F.coalesce(low.rlike(q) if regex else low.contains(q), F.lit(False))
    return out


@dataclass(frozen=True)
class FilterSpec:
    """Everything that narrows a view.  All parts are ANDed."""

    keyword: str = ""
    regex: bool = False
    only_negative: bool = False
    only_high: bool = False
    only_parented: bool = False
    only_trust: bool = False
    drill: Drill = field(default_factory=dict)

    def predicate(self, columns: Sequence[str]) -> Column:
        parts = []
        if self.keyword.strip():
            parts.append(keyword_predicate(self.keyword, regex=self.regex))
        if self.only_negative:
            parts.append(F.col("sentiment") == "Negative")
        if self.only_high:
            parts.append(F.col("severity") == "High")
        if self.only_parented:
            parts.append(F.col("parent_issue") != lx.UNASSIGNED_PARENT)
        if self.only_trust:
            parts.append(F.array_contains("risk_tags", lx.TRUST_TAG))
        parts.append(drill_predicate(self.drill, columns))
        return _all(parts)

    def narrowing(self) -> dict[str, list[str]]:
        """Fields that narrow the view outside the category filters, with their values."""
        out: dict[str, list[str]] = {}
        if self.keyword.strip():
            out["search"] = [self.keyword.strip()]
        toggles = {
            "only_negative": self.only_negative,
            "only_high": self.only_high,
            "only_parented": self.only_parented,
            "only_sensitive": self.only_trust,
        }
        out.update({name: ["true"] for name, on in toggles.items() if on})
        return out


def apply_filters(records: DataFrame, spec: FilterSpec) -> DataFrame:
    return records.filter(spec.predicate(records.columns))


def drill_filter(records: DataFrame, drill: Drill) -> DataFrame:
    return records.filter(drill_predicate(drill, records.columns))


def preset(name: str) -> dict[str, list[str]]:
    """The category filters a preset stands for; an unknown name clears all."""
    return {f: list(v) for f, v in lx.PRESETS.get(name, {}).items()}


def quick_filter(name: str) -> dict[str, list[str]]:
    return {f: list(v) for f, v in lx.QUICK_FILTERS[name].items()}


def scope_filter(drill: Drill, level: str, value: str) -> dict[str, list[str]]:
    """Choose one issue: other taxonomy levels are dropped, other fields stay; a blank value chooses none."""
    others = {field: list(v) for field, v in drill.items() if field not in TAXONOMY}
    return others | ({level: [value]} if value.strip() else {})


def name_search(records: DataFrame, text: str, *, stop_after: int = 50, show: int = 30) -> DataFrame:
    """Issue names containing ``text``: level by level, later levels only while fewer than ``stop_after`` were found.

    Distinct names of all levels come from one scan; names of a level are in value order.
    """
    order = ("raw_topic", "child_issue", "parent_issue", "topic")
    pairs = F.array(
        *[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("level"), F.col(c).alias("value")) for i, c in enumerate(order)]
    )
    names = (
        records.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter(F.lower("value").contains(text.strip().lower()))
        .distinct()
    )
    hits = [F.count_if(F.col("ordinal") < i) for i in range(len(order))]
    before = names.agg(F.array(*hits)).scalar()
    return (
        names.withColumn("before", before)
        .filter(F.element_at("before", F.col("ordinal") + 1) < stop_after)
        .orderBy("ordinal", "value")
        .limit(show)
        .select("ordinal", "level", "value")
    )


def filter_options(records: DataFrame, fields: Sequence[str] = FILTER_FIELDS) -> DataFrame:
    """Distinct non-null values of every filter field, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return (
        records.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()
    )
