"""Chat formatting over reply trees.

Messages form trees by parent. Self-joins double every message's pointer to an ancestor until all reach their root, adding
up scores on the way, so a path of n messages takes log2(n) rounds. Each tree's branches (root to leaf) are ranked by that
sum, and the best ones are walked back through the same pointer tables, again in log2(n) joins. Each chosen path becomes
one conversation in the template below, with a loss mask over the assistants' texts.

Template: every turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. In roles and texts a backslash goes behind every
backslash and behind the first character of every control string, so that none is left whole; taking single backslashes
out, and one of each two, gives the text back.

Defined results: a null text or role is empty; a null tree is a tree of its own; a parent that is missing makes a root; a
circle of parents has no root and gives no path; messages with equal place in ``chains`` stand in the order of role and
text; an empty table gives none; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from watchgrid.session import cut_lineage

#: The template's marks and the control strings of common chat templates.
OPEN, SEPARATE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL = re.compile(
    r"\\|<(?=\||/?s>|</?SYS>>|(?:start|end)_of_turn>|[be]os>|pad>|unk>)|\[(?=/?INST\])", re.IGNORECASE
)
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEPARATE) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[int]]:
    """The conversation as one string, and the loss mask as start, end, start, ... in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + SEPARATE, escape(text)
        if role == learned:
            mask += (at + len(head), at + len(head) + len(body))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def chains(messages: DataFrame) -> DataFrame:
    """Reply trees of plain conversations (``conv_id``, ``turn``, ``role``, ``text``): each message answers the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = messages.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    placed = named.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def _met(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on tree (null equals null) and left's ``key`` to right's ``node``; right's columns end in _r."""
    other = right.toDF(*[f"{c}_r" for c in right.columns])
    return left.join(other, F.col("tree").eqNullSafe(F.col("tree_r")) & (F.col(key) == F.col("node_r")), how)


def pointer_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the ancestors 1, 2, 4, ... above each node, and per node with a root the ``total`` score down to it."""
    alone = nodes.select("tree", "node")
    known = _met(nodes.select("tree", "node", "parent", "score"), alone, "parent", "left")
    state = cut_lineage(known.select("tree", "node", F.col("node_r").alias("up"), F.col("score").cast("double").alias("total"), F.lit(1).cast("long").alias("length")))
    size, found = state.count(), []
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        moving = state.where("up IS NOT NULL")
        if 2 ** len(found) > size or moving.isEmpty():
            return found, state.where("up IS NULL").select("tree", "node", "total", "length")
        found.append(moving.select("tree", "node", "up"))
        # Only messages that have not reached their root yet are joined again.
        further = _met(moving, state, "up").select(
            "tree",
            "node",
            F.col("up_r").alias("up"),
            (F.col("total") + F.col("total_r")).alias("total"),
            (F.col("length") + F.col("length_r")).alias("length"),
        )
        state = cut_lineage(state.where("up IS NULL").union(further).coalesce(tasks))


def best_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``tree``, ``branch`` (1: highest score, then longest, then smallest leaf), ``depth`` (from the root), ``node``."""
    tables, totals = pointer_tables(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).distinct()
    leaves = _met(totals, parents, "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "node"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    path = cut_lineage(chosen.select("tree", "branch", (F.col("length") - 1).alias("depth"), "node"))
    for k in range(len(tables) - 1, -1, -1):
        here, above = F.struct("depth", "node"), F.struct((F.col("depth") - 2**k).alias("depth"), F.col("up_r").alias("node"))
        both = F.when(F.col("up_r").isNull(), F.array(here)).otherwise(F.array(here, above))
        found = _met(path, tables[k], "node", "left").select("tree", "branch", F.explode(both).alias("at"))
        path = cut_lineage(found.select("tree", "branch", "at.depth", "at.node"))
    return path


def format_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Per chosen path: ``tree``, ``branch``, ``formatted`` and ``loss_mask``; nodes have tree, node, parent, score, role, text."""
    nodes = cut_lineage(nodes.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    shape = cut_lineage(nodes.select("tree", "node", "parent", "score"))
    said = _met(best_paths(shape, branches), nodes, "node").select("tree", "branch", F.struct("depth", F.col("role_r").alias("role"), F.col("text_r").alias("text")).alias("turn"))
    turns = said.groupBy("tree", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "branch", "formatted", "loss_mask"])

    kind = turns.schema["tree"].dataType.simpleString()
    return turns.mapInArrow(run, f"tree {kind}, branch int, formatted string, loss_mask array<long>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                learned = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2]))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                row = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss_mask").mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
