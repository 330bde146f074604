"""What a cluster is about: characteristic terms, representatives, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions import lexicons as lx
from earshot.functions import text as tx
from earshot.operators import vectors as vec
from earshot.operators.blocks import small_side, with_own
from earshot.sources.shared import cut

NOISE = -1

# --------------------------------------------------------------------------- terms


def cluster_terms(
    df: DataFrame,
    *,
    text_col: str = "text_clean",
    cluster_col: str = "cluster_id",
    n_terms: int = 10,
    stop_words: Iterable[str] = lx.STOP_WORDS,
    extra_stop_words: Iterable[str] = lx.EXTRA_STOP_WORDS,
    min_clusters: int = 2,
    n_clusters: Column | None = None,
) -> DataFrame:
    """``(cluster_id, rank, term, weight)``: the terms most characteristic of each cluster.

    Terms are words of three or more ASCII letters and pairs of neighbouring ones, after stop words are
    taken out.  A term has to occur in ``min_clusters`` clusters.  Weight is count times smoothed log inverse cluster frequency, scaled to unit
    length per cluster.  Terms containing an extra stop word are dropped at the end.  Word pairs do not
    cross from one comment into the next.  ``n_clusters``, their number without noise, is counted unless it is given.
    """
    live = df.filter(F.col(cluster_col) != NOISE).select(F.col(cluster_col).alias("cluster_id"), F.col(text_col).alias("t"))
    tf = cut(term_counts(live, stop_words), "terms")
    kept = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_clusters)
    n = live.agg(F.count_distinct("cluster_id")).scalar() if n_clusters is None else n_clusters
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = (
        tf.join(kept, "term")
        .withColumn("n", n)
        .select("cluster_id", "term", (F.col("tf") * idf).alias("w"))
    )
    lengths = weighted.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    extra = set(extra_stop_words)
    clean = ~F.exists(F.split("term", " "), lambda part: part.isin(*extra)) if extra else F.lit(True)
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    return (
        weighted.join(lengths, "cluster_id")
        .withColumn("weight", F.round(F.col("w") / F.col("length"), 12))
        .filter((F.col("weight") > 0) & clean)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n_terms)
        .select("cluster_id", "rank", "term", "weight")
    )


def term_counts(live: DataFrame, stop_words: Iterable[str]) -> DataFrame:
    """``(cluster_id, term, tf)`` over single words and word pairs."""
    stop = list(stop_words)
    words = tx.ascii_words(F.coalesce("t", F.lit("")))
    kept = F.filter("w", lambda x: ~x.isin(*stop)) if stop else F.col("w")
    pairs = F.when(
        F.size("k") > 1,
        F.zip_with(
            F.slice("k", 1, F.size("k") - 1), F.slice("k", 2, F.size("k") - 1), lambda a, b: F.concat(a, F.lit(" "), b)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return (
        live.select("cluster_id", words.alias("w"))
        .select("cluster_id", kept.alias("k"))
        .select("cluster_id", F.explode(F.concat("k", pairs)).alias("term"))
        .groupBy("cluster_id", "term")
        .agg(F.count("*").alias("tf"))
    )


# --------------------------------------------------------------------------- representatives


def representatives(
    df: DataFrame,
    *,
    k: int = 8,
    balance: float = 0.5,
    cluster_col: str = "cluster_id",
    vec_col: str = "embedding",
    id_col: str = "row_id",
    block_bytes: int = vec.BLOCK_BYTES,
) -> DataFrame:
    """``(cluster_id, position, row_id)``: up to ``k`` central yet diverse rows per cluster.

    The first is closest to the centroid; each next one maximises ``balance * closeness - (1 - balance) *
    similarity to the nearest one already picked``.  Clusters of at most ``k`` rows return all, in row
    order.  One scan and one arg-max aggregate per position serve all clusters together.  Vectors are written
    once; a round multiplies each with all picks of its cluster, which go to the tasks while a round's picks stay
    below a measured size.  From then on rows keep their similarity to the nearest pick, and rows and new
    picks are dealt to blocks.
    """
    units = vec.l2_normalize(
        df.filter(F.col(cluster_col) != NOISE).select(
            F.col(cluster_col).alias("cluster_id"), F.col(id_col).alias("row_id"), F.col(vec_col).alias("v")
        ),
        vec_col="v",
    )
    centers = cut(vec.cluster_centroids(units, vec_col="v"), "centers")
    near = vec.with_own_product(units, centers, side_vec="centroid", name="closeness", block_bytes=block_bytes)
    rows = cut(near.join(centers.select("cluster_id", "size"), "cluster_id"), "rows")
    large = rows.filter(F.col("size") > k).withColumn("nearest", F.lit(None).cast("double"))
    picks, sides = [], []
    for position in range(1, k + 1):
        score = F.col("closeness") if position == 1 else F.col("closeness") * balance - F.col("nearest") * (1 - balance)
        # A row that was picked is nearest to itself and marked by infinity.
        left = large.filter(F.coalesce(F.col("nearest") < float("inf"), F.lit(True)))
        best = left.groupBy("cluster_id").agg(
            F.max_by(F.struct("row_id", "v"), F.struct(F.round(score, vec.DIGITS), -F.col("row_id"))).alias("pick")
        )
        pick = cut(best.select("cluster_id", "pick.row_id", "pick.v", F.lit(position).alias("position")), "picks")
        picks.append(pick.select("cluster_id", "position", "row_id"))
        if position == k:
            break
        size = pick.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
        known = dict(n=size["n"], dim=size["dim"] or 0)
        # The picks of one round are as many as those of the first, or fewer.
        side = None if sides is None else small_side(pick, "cluster_id", "v", carry="row_id", block_bytes=block_bytes, **known)
        if side is not None:
            sides.append(side)
            nearest = vec.own_product(rows, sides, vec_col="v", cluster_col="cluster_id", id_col="row_id")
            large = rows.filter(F.col("size") > k).withColumn("nearest", nearest)
        else:
            sides = None
            dealt = with_own(
                large, pick, key="cluster_id", vec_col="v", side_vec="v", name="nearest", id_col="row_id",
                block_bytes=block_bytes, **known,
            )
            large = cut(dealt, "rows")
    chosen = picks[0]
    for pick in picks[1:]:
        chosen = chosen.unionAll(pick)
    # Clusters of at most k rows.
    small = rows.filter(F.col("size") <= k).select("cluster_id", "row_id")
    order = Window.partitionBy("cluster_id").orderBy("row_id")
    return chosen.unionAll(small.select("cluster_id", F.row_number().over(order).alias("position"), "row_id"))


# --------------------------------------------------------------------------- contexts and labels


def cluster_mix(df: DataFrame, column: str, *, cluster_col: str = "cluster_id") -> DataFrame:
    """``(cluster_id, value, n)`` for non-noise clusters."""
    return (
        df.filter((F.col(cluster_col) != NOISE) & F.col(column).isNotNull())
        .groupBy(F.col(cluster_col).alias("cluster_id"), F.col(column).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def _mix_list(facts: DataFrame, column: str, name: str) -> DataFrame:
    """Value counts of a closed domain as an array, most frequent first."""
    counts = facts.filter(F.col(column).isNotNull()).groupBy("cluster_id", column).agg(F.sum("n").alias("n"))
    pairs = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).alias("value")))),
        lambda s: F.struct(s.value.alias("value"), (-s.m).alias("n")),
    )
    return counts.groupBy("cluster_id").agg(pairs.alias(name))


def cluster_contexts(
    df: DataFrame,
    *,
    text_col: str = "comment",
    clean_col: str = "text_clean",
    vec_col: str = "embedding",
    id_col: str = "row_id",
    n_representatives: int = 8,
    n_terms: int = 10,
    balance: float = 0.5,
    **term_options,
) -> DataFrame:
    """``(cluster_id, size, representatives, top_terms, sentiment_mix, severity_mix)`` per non-noise cluster."""
    # What all but the terms and quotes need is written without texts, so that texts are read for those two alone.
    names = list(dict.fromkeys([id_col, "cluster_id", "sentiment", "severity", vec_col]))
    live = cut(df.filter(F.col("cluster_id") != NOISE).select(*names), "live")
    facts = cut(live.groupBy("cluster_id", "sentiment", "severity").agg(F.count("*").alias("n")), "facts")
    sizes = facts.groupBy("cluster_id").agg(F.sum("n").alias("size"))
    picked = representatives(live, k=n_representatives, balance=balance, vec_col=vec_col, id_col=id_col)
    texts = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    # At most n_representatives and n_terms entries per cluster.
    quotes = (
        picked.join(texts, "row_id")
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s.text).alias("representatives"))
    )
    terms = (
        cluster_terms(df, text_col=clean_col, n_terms=n_terms, n_clusters=sizes.agg(F.count(F.lit(1))).scalar(), **term_options)
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s.term).alias("top_terms"))
    )
    none = F.array().cast("array<string>")
    return (
        sizes.join(quotes, "cluster_id", "left")
        .join(terms, "cluster_id", "left")
        .join(_mix_list(facts, "sentiment", "sentiment_mix"), "cluster_id", "left")
        .join(_mix_list(facts, "severity", "severity_mix"), "cluster_id", "left")
        .withColumns(
            {"representatives": F.coalesce("representatives", none), "top_terms": F.coalesce("top_terms", none)}
        )
    )


def term_labels(contexts: DataFrame, *, n_terms: int = 4) -> DataFrame:
    """Deterministic label, description and quote from a cluster's terms and mixes."""
    short = F.when(F.size("top_terms") > 0, F.array_join(F.slice("top_terms", 1, n_terms), ", ")).otherwise("(no terms)")
    top = lambda mix: F.get(F.col(mix), F.lit(0))["value"]
    return contexts.withColumn("label", short).select(
        "cluster_id",
        "label",
        F.format_string(
            lx.CLUSTER_DESCRIPTION,
            "size",
            "label",
            top("sentiment_mix"),
            top("severity_mix"),
        ).alias("description"),
        F.coalesce(F.get("representatives", F.lit(0)), F.lit("")).alias("example_quote"),
        F.lit("").alias("suspected_root_cause"),
        F.lit("terms").alias("label_mode"),
    )


REPLY_KEYS = ("label", "description", "example_quote", "suspected_root_cause")


def prompt_frame(product: str) -> tuple[str, str]:
    """What a prompt begins and ends with."""
    intro = (
        f"Below is one group of alike user comments about {product}. "
        "Name what is affected and what goes wrong with it, for the team that will fix it.\n"
    )
    ask = (
        "\nAnswer with one JSON object and nothing around it. Its keys: label (six English words at most), "
        "description (one sentence), example_quote (one comment from above, unchanged, 200 characters at most), "
        "suspected_root_cause (one short phrase)."
    )
    return intro, ask


def label_prompts(contexts: DataFrame, *, quote_limit: int = 300, product: str = "a consumer app") -> DataFrame:
    """``(cluster_id, prompt)`` to be answered by a labelling service outside Spark."""
    intro, ask = prompt_frame(product)
    mix = lambda name: F.array_join(
        F.transform(F.col(name), lambda m: F.concat_ws("=", m.value, m.n.cast("string"))), ", "
    )
    quotes = F.array_join(F.transform("representatives", lambda q: F.concat(F.lit("- "), F.substring(q, 1, quote_limit))), "\n")
    terms = F.when(F.size("top_terms") > 0, F.array_join("top_terms", ", ")).otherwise("(none)")
    return contexts.select(
        "cluster_id",
        F.concat(
            F.lit(intro),
            F.lit("Comments in the group: "), F.col("size").cast("string"),
            F.lit("\nFrequent terms: "), terms,
            F.lit("\nSentiment: "), mix("sentiment_mix"),
            F.lit("\nSeverity: "), mix("severity_mix"),
            F.lit("\nTypical comments:\n"), quotes,
            F.lit(ask),
        ).alias("prompt"),
    )


def parse_label_replies(replies: DataFrame, *, reply_col: str = "reply", mode: str = "service") -> DataFrame:
    """Parse JSON replies, code fences allowed; missing keys give ``""`` and unreadable replies are flagged."""
    ends = F.lit(rf"^[{tx.WS}]+|[{tx.WS}]+$")
    bare = F.regexp_replace(F.regexp_replace(reply_col, ends, F.lit("")), r"(?m)^```(?:json)?|```$", "")
    body = F.regexp_replace(bare, ends, F.lit(""))
    schema = T.StructType([T.StructField(key, T.StringType()) for key in REPLY_KEYS])
    parsed = replies.withColumn("_j", F.from_json(body, schema, {"mode": "PERMISSIVE"})).withColumn(
        "_ok", F.coalesce(body.rlike(r"(?s)^\{.*\}$") & F.get_json_object(body, "$").isNotNull(), F.lit(False))
    )
    return parsed.select(
        "cluster_id",
        *[F.when(F.col("_ok"), F.coalesce(F.col(f"_j.{key}"), F.lit(""))).alias(key) for key in REPLY_KEYS],
        F.lit(mode).alias("label_mode"),
        (~F.col("_ok")).alias("unreadable"),
    )


def label_table(contexts: DataFrame, *, replies: DataFrame | None = None) -> DataFrame:
    """Labels of every cluster with size and terms; from terms, or from parsed replies where given and readable."""
    labels = term_labels(contexts)
    if replies is not None:
        good = replies.filter(~F.col("unreadable")).drop("unreadable")
        labels = labels.join(good.select("cluster_id"), "cluster_id", "left_anti").unionByName(good)
    facts = contexts.select("cluster_id", "size", F.array_join("top_terms", ", ").alias("top_terms"))
    return labels.join(facts, "cluster_id")


def label_parents(clusters: DataFrame, labels: DataFrame, *, parts: int = 3) -> DataFrame:
    """``(parent_id, rows, n_clusters, label)``: a parent is named by its largest clusters.

    Rows are counted per (parent, cluster) first, so labels meet only the small table.
    """
    sizes = (
        clusters.filter(F.col("parent_id") != NOISE).groupBy("parent_id", "cluster_id").agg(F.count("*").alias("n"))
    )
    named = sizes.join(labels.select("cluster_id", "label", "size"), "cluster_id", "left")
    order = Window.partitionBy("parent_id").orderBy(F.desc("size"), "cluster_id")
    ranked = named.withColumn("r", F.when(F.col("label").isNotNull(), F.row_number().over(order)))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= parts, F.struct("r", "label"))))
    return ranked.groupBy("parent_id").agg(
        F.sum("n").alias("rows"),
        F.count("label").alias("n_clusters"),
        F.coalesce(
            F.nullif(F.array_join(F.transform(top, lambda s: s.label), " · "), F.lit("")), F.lit("(unlabeled)")
        ).alias("label"),
    )
