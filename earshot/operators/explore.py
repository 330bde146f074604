"""Views, counts and drill-downs over classified records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.functions import scoring, text as tx
from earshot.operators import filters, rank
from earshot.sources.shared import cut

MAX_PINS = 12


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def _high() -> Column:
    return F.col("severity") == "High"


def _negative() -> Column:
    return F.col("sentiment") == "Negative"


def fill_defaults(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "parent_issue": F.coalesce("parent_issue", F.lit(lx.UNASSIGNED_PARENT)),
            "original_feedback": F.coalesce("original_feedback", F.lit("")),
        }
    )


def number_records(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``record_id`` 1..n in the given order (end it with a unique column)."""
    return rank.global_rank(records, order, name="record_id")


def derive_records(records: DataFrame, lexicon: Mapping[str, Iterable[str]] = lx.SENSITIVITY_TAGS) -> DataFrame:
    """Fill defaults; add ``risk_tags``, ``risk_primary`` and ``priority_score``.

    Corpus, hits and tags are separate steps so that each is computed once per row.
    """
    corpus = F.concat_ws(" ", "topic", "parent_issue", "child_issue", "original_feedback")
    tagged = (
        fill_defaults(records)
        .withColumn("_corpus", corpus)
        .withColumn("_found", tx.matching_tags(F.col("_corpus"), lexicon))
        .withColumn("risk_tags", tx.tags_or_default(F.col("_found")))
        .drop("_corpus", "_found")
    )
    return tagged.withColumns(
        {
            "risk_primary": F.element_at("risk_tags", 1),
            "priority_score": scoring.record_priority(F.col("severity"), F.col("sentiment"), F.col("risk_tags")),
        }
    )


def kpis(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(_negative()).alias("negative"),
        F.count_if(_high()).alias("high"),
        F.count_if(F.array_contains("risk_tags", lx.TRUST_TAG)).alias("trust"),
        F.count_if(F.array_contains("risk_tags", lx.MONEY_TAG)).alias("money"),
    )


def view_share(records: DataFrame, spec: filters.FilterSpec) -> DataFrame:
    """How much of the table a filter keeps, in one scan."""
    kept = F.count_if(spec.predicate(records.columns))
    return records.agg(
        kept.alias("in_view"),
        F.count("*").alias("total"),
        F.coalesce(F.try_divide(kept * 100.0, F.count("*")), F.lit(0.0)).alias("pct"),
    )


def topic_volume(records: DataFrame) -> DataFrame:
    grouped = (
        records.filter(F.col("raw_topic").isNotNull() & F.col("topic").isNotNull())
        .groupBy("raw_topic", "topic")
        .agg(
            F.count("*").alias("count"),
            _share(_negative()).alias("negative_rate"),
            _share(_high()).alias("high_severity_rate"),
        )
    )
    label = F.concat(tx.clip_text(F.col("topic"), 38), F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
    return grouped.withColumn("label", label)


def _by_issue(records: DataFrame):
    known = F.col("parent_issue").isNotNull() & F.col("child_issue").isNotNull()
    return records.filter(known).groupBy("parent_issue", "child_issue")


def taxonomy_tree(records: DataFrame) -> DataFrame:
    """Both rings of the tree in one pass: a row per (parent, child), and one per parent, whose child is null."""
    known = F.col("parent_issue").isNotNull() & F.col("child_issue").isNotNull()
    level = F.grouping_id()
    rings = records.filter(known).rollup("parent_issue", "child_issue")
    tree = rings.agg(level.alias("level"), F.count("*").alias("count"), _share(_negative()).alias("negative_rate"))
    # Levels of a rollup: 0 for pairs, 1 for parents, 3 for everything.
    return tree.filter("level < 3").withColumn("level", F.when(F.col("level") == 0, "child").otherwise("parent"))


def top_values(records: DataFrame, column: str, n: int) -> DataFrame:
    return (
        records.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
        .limit(n)
    )


def top_children(records: DataFrame, n: int = 30) -> DataFrame:
    return (
        _by_issue(records)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "parent_issue", "child_issue")
        .limit(n)
        .withColumn("label", tx.clip_text(F.col("child_issue"), 55))
    )


PAIN_CELLS = tuple(f"{sev} · {sent}" for sev in ("High", "Medium", "Low") for sent in ("Negative", "Neutral", "Positive"))


def pain_map(records: DataFrame) -> DataFrame:
    """Parent by severity and sentiment counts: nine fixed columns, worst first, plus the row total."""
    cell = F.concat_ws(" · ", "severity", "sentiment")
    known = F.col("parent_issue").isNotNull() & F.col("severity").isNotNull() & F.col("sentiment").isNotNull()
    wide = (
        records.filter(known)
        .select("parent_issue", cell.alias("cell"))
        .groupBy("parent_issue")
        .pivot("cell", list(PAIN_CELLS))
        .agg(F.count(F.lit(1)))
    )
    cells = {c: F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in PAIN_CELLS}
    total = sum(cells.values(), F.lit(0))
    return wide.select("parent_issue", *[v.alias(c) for c, v in cells.items()], total.cast("bigint").alias("total"))


def drill_detail(records: DataFrame, drill: filters.Drill) -> DataFrame:
    """One row about a filtered view."""
    return filters.drill_filter(records, drill).agg(
        F.count("*").alias("count"),
        F.count_distinct("child_issue").alias("unique_children"),
        (_share(_negative()) * 100).alias("negative_pct"),
        (_share(_high()) * 100).alias("high_pct"),
    )


def drill_examples(records: DataFrame, drill: filters.Drill, n: int = 7) -> DataFrame:
    return (
        filters.drill_filter(records, drill)
        .select("record_id", tx.clip_text(F.col("original_feedback"), 190).alias("example"))
        .orderBy("record_id")
        .limit(n)
    )


def _each_tag() -> Column:
    """One row per tag.  Every record has one, so outer changes nothing, but no test of it is pushed to the scan."""
    return F.explode_outer("risk_tags")


def risk_counts(records: DataFrame) -> DataFrame:
    return records.select(_each_tag().alias("risk_domain")).groupBy("risk_domain").agg(
        F.count("*").alias("count")
    )


def escalation_queue(records: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` worst (tag, parent, child) groups with their first comment.

    Groups are ranked on numbers alone; the sample text is fetched for the few that are shown.
    """
    tagged = records.select(
        "record_id", _each_tag().alias("risk_tag"), "parent_issue", "child_issue", "severity", "sentiment"
    )
    score = scoring.queue_score(F.col("risk_tag"), F.col("severity"), F.col("sentiment"))
    top = (
        tagged.filter(F.col("parent_issue").isNotNull() & F.col("child_issue").isNotNull())
        .groupBy("risk_tag", "parent_issue", "child_issue")
        .agg(
            F.count("*").alias("total_count"),
            F.count_if(_high()).alias("high_severity"),
            F.count_if(_negative()).alias("negative"),
            F.avg(score).alias("priority_score"),
            F.min("record_id").alias("record_id"),
        )
        .orderBy(F.desc("priority_score"), F.desc("total_count"), "risk_tag", "parent_issue", "child_issue")
        .limit(n)
    )
    samples = records.select("record_id", tx.clip_text(F.col("original_feedback"), 130).alias("sample_feedback"))
    # At most n rows.
    return samples.join(F.broadcast(top), "record_id").drop("record_id")


def priority_matrix(records: DataFrame, n: int = 120) -> DataFrame:
    grouped = _by_issue(records).agg(
        F.count("*").alias("frequency"),
        _share(_high()).alias("high_severity_rate"),
        _share(_negative()).alias("negative_rate"),
        _share(F.array_contains("risk_tags", lx.TRUST_TAG)).alias("trust_rate"),
    )
    top = grouped.orderBy(F.desc("frequency"), "parent_issue", "child_issue").limit(n)
    return top.withColumns(
        {
            "impact": F.col("frequency"),
            "urgency": scoring.matrix_urgency(
                F.col("high_severity_rate"), F.col("negative_rate"), F.col("trust_rate")
            ),
            "label_short": tx.clip_text(F.col("child_issue"), 42),
        }
    )


# --------------------------------------------------------------------------- issues by (level, value)


def wanted_pins(pins: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pinned (level, value) pairs without repeats; their number is bounded."""
    unique = list(dict.fromkeys(pins))
    if len(unique) > MAX_PINS:
        raise ValueError(f"at most {MAX_PINS} issues can be pinned, got {len(unique)}")
    unknown = [level for level, _ in unique if level not in filters.LEVELS]
    if unknown:
        raise ValueError(f"unknown levels: {unknown}")
    return unique


def pins_frame(spark: SparkSession, pins: Sequence[tuple[str, str]]) -> DataFrame:
    """The pins as a table."""
    rows = [(i, level, value) for i, (level, value) in enumerate(wanted_pins(pins))]
    return spark.createDataFrame(rows, "pin int, level string, value string")


def by_level(
    records: DataFrame, levels: Iterable[str] = filters.LEVELS, *, only: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Records turned to one row per (level, value) they belong to; NULL belongs nowhere.

    With ``only`` (a few literals) a record is copied for these pairs alone.
    """
    wanted = [level for level in filters.LEVELS if level in set(levels)]
    single = [
        F.struct(F.lit(level).alias("level"), F.col(level).cast("string").alias("value"))
        for level in wanted
        if level != "risk_primary"
    ]
    pairs = F.array(*single) if single else None
    if "risk_primary" in wanted:
        tags = F.transform("risk_tags", lambda t: F.struct(F.lit("risk_primary").alias("level"), t.alias("value")))
        pairs = tags if pairs is None else F.concat(pairs, tags)
    if only is not None:
        pairs = F.filter(
            pairs, lambda p: F.exists(F.array(*[_pair(x, y) for x, y in only]), lambda w: (w.level == p.level) & (w.value == p.value))
        ) if only else F.filter(pairs, lambda p: F.lit(False))
    return (
        records.withColumn("_issue", F.explode(pairs))
        .withColumns({"level": F.col("_issue.level"), "value": F.col("_issue.value")})
        .drop("_issue")
        .filter(F.col("value").isNotNull())
    )


def _pair(level: str, value: str) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(value).alias("value"))


CATEGORIES = ("classification", *filters.TAXONOMY, "risk_tags", "severity", "sentiment")


def category_cube(records: DataFrame) -> DataFrame:
    """Row counts ``n`` per combination of all category columns, written once.

    Everything about issues (ranks, rates, modes, distinct counts) follows from this table, so any
    number of issues costs one scan of the records.
    """
    return cut(records.groupBy(*CATEGORIES).agg(F.count("*").alias("n")), "categories")


def level_counts(cube: DataFrame, levels: Iterable[str] = filters.LEVELS) -> DataFrame:
    """``(level, value, n, n_scoped)``: taxonomy levels are scoped to suggestions, tags to everything."""
    scoped = (F.col("level") == "risk_primary") | (F.col("classification") == "Suggestion")
    return by_level(cube, levels).groupBy("level", "value").agg(
        F.sum("n").alias("n"), F.sum(F.when(scoped, F.col("n")).otherwise(0)).alias("n_scoped")
    )


def rank_among(records: DataFrame, pins: Sequence[tuple[str, str]]) -> DataFrame:
    """``(level, value, rank, total)`` for the given issues."""
    wanted = pins_frame(records.sparkSession, pins)
    counts = level_counts(category_cube(records), {level for level, _ in pins})
    return rank.value_ranks(counts, wanted.select("level", "value"))


def _modal(scoped: DataFrame, column: str, name: str) -> DataFrame:
    """Most frequent non-null value per pin, the smallest on ties."""
    counts = scoped.filter(F.col(column).isNotNull()).groupBy("pin", column).agg(F.sum("n").alias("n"))
    most = counts.groupBy("pin").agg(F.max("n").alias("n"))
    return counts.join(most, ["pin", "n"]).groupBy("pin").agg(F.min(column).alias(name))


def issue_details(records: DataFrame, pins: Sequence[tuple[str, str]]) -> DataFrame:
    """Size, rank, modal parent and topic, rates and distinct counts of the given issues, from one scan for all."""
    wanted = pins_frame(records.sparkSession, pins)
    levels = {level for level, _ in pins}
    cube = category_cube(records)
    # At most MAX_PINS rows on the broadcast side, here and below.
    scoped = by_level(cube, levels).join(F.broadcast(wanted), ["level", "value"])
    n = F.col("n")
    main = scoped.groupBy("pin", "level", "value").agg(
        F.sum(n).alias("count"),
        (F.sum(F.when(_high(), n).otherwise(0)) / F.sum(n) * 100).alias("high_pct"),
        (F.sum(F.when(_negative(), n).otherwise(0)) / F.sum(n) * 100).alias("negative_pct"),
        F.count_distinct("child_issue").alias("n_children"),
        F.count_distinct("parent_issue").alias("n_parents"),
    )
    ranks = rank.value_ranks(level_counts(cube, levels), wanted.select("level", "value"))
    return (
        main.join(F.broadcast(ranks), ["level", "value"])
        .join(F.broadcast(_modal(scoped, "parent_issue", "top_parent")), "pin", "left")
        .join(F.broadcast(_modal(scoped, "raw_topic", "top_raw_topic")), "pin", "left")
        .select(
            "pin", "level", "value", "rank", "total", "count", "high_pct", "negative_pct",
            F.coalesce("top_parent", F.lit("—")).alias("top_parent"),
            F.coalesce("top_raw_topic", F.lit("—")).alias("top_raw_topic"),
            "n_children", "n_parents",
        )
    )


def issue_records(records: DataFrame, level: str, value: str, n: int = 200) -> DataFrame:
    """First ``n`` comments of an issue, numbered rows of its detail panel."""
    return (
        records.filter(filters.level_is(level, value))
        .select(
            "record_id",
            tx.clip_text(F.col("original_feedback"), 220).alias("comment"),
            tx.clip_text(F.coalesce("child_issue", "topic"), 36).alias("chip"),
        )
        .orderBy("record_id")
        .limit(n)
    )


def pin_compare(records: DataFrame, pins: Sequence[tuple[str, str]]) -> DataFrame:
    """Side-by-side comparison of pinned issues; pins without comments are left out."""
    d = issue_details(records, pins)
    return d.select(
        "pin",
        tx.clip_text(F.col("value"), 36).alias("issue"),
        "level",
        F.format_string("#%d/%d", "rank", "total").alias("rank"),
        "count",
        "high_pct",
        "negative_pct",
        tx.clip_text(F.col("top_parent"), 28).alias("top_parent"),
    )


def pin_rates_long(compared: DataFrame) -> DataFrame:
    """One row per pinned issue and rate."""
    return compared.select(
        "pin",
        F.col("issue"),
        F.col("high_pct").alias("High severity %"),
        F.col("negative_pct").alias("Negative %"),
    ).unpivot(["pin", "issue"], ["High severity %", "Negative %"], "metric", "pct")


EXPORT = (
    "record_id", "classification", "topic", "parent_issue", "child_issue",
    "severity", "sentiment", "raw_topic", "original_feedback",
)


def pin_export(records: DataFrame, pins: Sequence[tuple[str, str]]) -> DataFrame:
    """Every comment of every pinned issue; a comment under two pins appears twice."""
    slim = records.select(*EXPORT, "risk_tags")
    chosen = wanted_pins(pins)
    return (
        by_level(slim, {level for level, _ in chosen}, only=chosen)
        .select(F.col("level").alias("pinned_level"), F.col("value").alias("pinned_value"), *EXPORT)
    )


EVIDENCE = (
    "record_id", "classification", "topic", "parent_issue", "child_issue",
    "severity", "sentiment", "raw_topic", "risk_primary",
)


def evidence_table(records: DataFrame, limit: int = 150) -> DataFrame:
    return records.select(*EVIDENCE, tx.clip_text(F.col("original_feedback"), limit).alias("original_feedback"))


def record_lookup(records: DataFrame, record_id: int) -> DataFrame:
    return records.filter(F.col("record_id") == record_id).select(
        "record_id", "classification", "topic", "severity", "sentiment", "parent_issue", "child_issue", "raw_topic",
        F.array_join("risk_tags", ", ").alias("tags"), "original_feedback",
    )
