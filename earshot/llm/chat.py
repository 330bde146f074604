"""Chat formatting of reply trees.

Iterative self-joins follow all root-to-leaf paths: each round joins a jump table with itself, which doubles
its reach and adds up the scores on the way.  Branches are ranked by the mean score of their messages (ties to
the smaller leaf); each chosen path is filled in from the leaf by halving jumps and becomes one conversation.
A tree of depth d takes about 2 log2(d) joins, whatever its shape, and rows grow with messages and chosen paths.

Template, per turn: ``### role: text</turn>`` and a newline.  In texts and roles a backslash precedes
every backslash, ``#`` and ``<``, in roles ``:`` as well, so no text can forge a marker and taking the
backslashes away gives the text back.  The loss mask covers the (escaped) texts of ``assistant`` turns.

Defined results: null texts and roles are empty; a null tree id is a tree of its own; a message whose
parent does not exist starts a tree path; messages without an id, and messages that hang from a cycle,
take no part; rows that repeat an id are further messages at the same place, in the order of role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.shared import cut, cut_measured

LOSS_ROLE = "assistant"
_HEAD, _SEP, _END = "### ", ": ", "</turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    out: list[str] = []
    mask: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = _HEAD + escape(role).replace(":", "\\:") + _SEP, escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, _END)
        at += len(head) + len(body) + len(_END)
    return "".join(out), mask


# Possessive, so nothing is kept for stepping back: a turn of any length takes no memory but its own.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if it does not follow the template."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(tree, node, score, n)``, sum and number of the scores from a node to its root, and the jumps that led there.

    ``nodes`` has ``tree, node, parent, score`` with non-null tree and node, each node once; parents that do not exist
    are null, a null score counts as 0.  Jump k holds ``(tree, node, over)``, 2**k places up, for nodes that have one.
    Every round joins the table with itself and doubles its reach; it ends when a round brings no further node to its
    root, so nodes that hang from a cycle are absent.
    """
    open_nodes = F.count_if(F.col("over").isNotNull())
    state, seen = cut_measured(
        nodes.select("tree", "node", F.col("parent").alias("over"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("bigint").alias("n")),
        "climb",
        left=open_nodes,
    )
    jumps, before = [], None
    while seen["left"] and seen["left"] != before:
        before = seen["left"]
        jumps.append(state.filter("over is not null").select("tree", "node", "over"))
        ahead = state.select("tree", F.col("node").alias("over"), F.col("over").alias("further"), F.col("score").alias("more"), F.col("n").alias("m"))
        there = state.filter("over is null")
        moved = state.filter("over is not null").join(ahead, ["tree", "over"]).select(
            "tree", "node", F.col("further").alias("over"), (F.col("score") + F.col("more")).alias("score"), (F.col("n") + F.col("m")).alias("n")
        )
        state, seen = cut_measured(there.unionByName(moved), "climb", left=open_nodes)
    return state.filter("over is null").drop("over"), jumps


def best_paths(nodes: DataFrame, *, branches: int = 1) -> DataFrame:
    """The ``branches`` best paths of each tree as ``(tree, leaf, node, up, place)``, place 1 the best.

    ``nodes`` as in ``climb``; ``up`` counts from the leaf.  Leaves are ranked by what the jumps added up, so only the
    chosen paths become rows, filled in from the leaf by halving jumps.
    """
    totals, jumps = climb(nodes)
    inner = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = totals.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("n")).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = leaves.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= branches)
    paths = cut(ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up"), "place"), "paths")
    for k in reversed(range(len(jumps))):
        further = paths.join(jumps[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("over").alias("node"), (F.col("up") + (1 << k)).alias("up"), "place"
        )
        paths = cut(paths.unionByName(further), "paths")
    return paths


def format_conversations(
    messages: DataFrame,
    *,
    tree_col: str = "tree_id",
    id_col: str = "message_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = None,
    branches: int = 1,
) -> DataFrame:
    """``(tree_id, place, formatted, loss_spans)``, one row per chosen path."""
    tree, score = F.col(tree_col), F.col(score_col) if score_col else F.lit(0.0)
    rows = cut(
        messages.filter(F.col(id_col).isNotNull()).select(
            F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("")).alias("tree"),
            tree.alias("tree_id"),
            F.col(id_col).alias("node"),
            F.col(parent_col).alias("parent"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            score.cast("double").alias("score"),
        ),
        "messages",
    )
    once = rows.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.avg("score").alias("score"))
    known = once.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = once.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"
    )
    paths = best_paths(cut(nodes, "nodes"), branches=branches)
    turns = paths.join(rows.select("tree", "tree_id", "node", "role", "text"), ["tree", "node"])
    grouped = turns.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"),
        F.first("place").alias("place"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), "role", "text"))).alias("turns"),
    )
    schema = f"tree_id {dict(rows.dtypes)['tree_id']}, place int, formatted string, loss_spans array<struct<start:int,end:int>>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f for f, _ in made], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in m] for _, m in made], kind),
                ],
                ["tree_id", "place", "formatted", "loss_spans"],
            )

    return grouped.select("tree_id", "place", "turns").mapInArrow(build, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, read back from them.

    ``(tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``: all turns as role and
    text with a newline after each, and the unescaped text under the loss mask.
    """
    kind = dict(formatted.dtypes)["tree_id"]
    schema = f"tree_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(_sha("".join(f"{r}\n{t}\n" for r, t in turns)))
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(_sha(loss))
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.string() if "sha" in n else pa.int64()) for n, v in out.items())],
                ["tree_id", *out],
            )

    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
