"""Chat formatting of reply trees.

Messages name their parent. Pointer doubling finds each message's root in a logarithmic number of self-joins;
leaves are ranked by the score of their branch, and every chosen root-to-leaf path is walked back by
self-joins, a level a round, and formatted as one conversation.

Template: each turn is <|im_start|>ROLE, newline, text, <|im_end|>, newline. In roles and texts a backslash,
and the '<' before any '|' (which begins every control string), get a backslash in front; unescaping drops it. So no
text can hold a control string, whatever it says. A newline in a role gets one too. The loss mask covers the assistants' texts.

Rows: null text: empty. Null role: empty, not under the mask. Null conv_id: rows without one are one conversation. Null turn: before the others.
Repeated (conv_id, turn): one conversation holds both, ordered by role and text. Very long texts: whole. Empty table: no conversations.
Trees: a missing parent makes a message a root. Of repeated nodes the one with the smallest (parent, score) counts, a null being the
smallest. Null nodes, and messages on a cycle of parents or below one, have no root and are left out. Ties of branches: best_paths.
Other columns are ignored. A conversation is one row, so its turns have to fit a task; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import stage, unstage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _escaped(column, more: str = ""):
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"\\|<(?=\|)" + more, r"\\$0")


def best_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(root, leaf, node, depth): the nodes of each tree's `keep` best root-to-leaf paths.

    messages: node, parent (null at a root), score. A branch's score is its nodes' mean; ties go to the deeper, then the smaller leaf.
    """
    once = messages.where("node is not null").groupBy("node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("m")).select("node", "m.parent", "m.score")
    known = once.select(F.col("node").alias("at"), F.lit(True).alias("known"))
    # A root looks itself up: were its key null, all roots would meet in one task.
    looked = once.withColumn("at", F.coalesce("parent", "node")).join(known, "at", "left")
    nodes = stage(looked.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "nodes")
    # After each round `up` is twice as far away, and `steps` and `total` cover the way there without it.
    now = stage(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.lit(1).alias("steps"), F.col("score").alias("total")), "paths")
    open_, before = now.where("up is not null").count(), None
    while open_ and open_ != before:  # each round ends some ways; where none ends, all that are left go round a cycle
        far = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        going = now.where("up is not null").join(far, "up", "left").select("node", F.col("up2").alias("up"), F.coalesce("root", "root2").alias("root"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        new = stage(going.unionByName(now.where("up is null")), "paths")  # rows at their root take no part in later joins
        unstage(now)
        now, before = new, open_
        open_ = now.where("up is not null").count()
    leaves = now.where("up is null").join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("root").orderBy((F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= keep)
    # All ancestors of the chosen leaves: the ways known double in length each round, and start from all nodes found so far.
    ways = stage(nodes.where("parent is not null").select("node", F.col("parent").alias("top"), F.lit(1).alias("span")), "ways")
    path = stage(chosen.select("root", F.col("node").alias("leaf"), "node", (F.col("steps") - 1).alias("depth")), "path")
    unstage(now)
    while True:
        new = stage(path.join(ways, "node").select("root", "leaf", F.col("top").alias("node"), (F.col("depth") - F.col("span")).alias("depth")), "path")
        if new.isEmpty():
            break
        path = path.unionByName(new)
        far = ways.select(F.col("node").alias("top"), F.col("top").alias("top2"), F.col("span").alias("span2"))
        longer = stage(ways.join(far, "top").select("node", F.col("top2").alias("top"), (F.col("span") + F.col("span2")).alias("span")), "ways")
        unstage(ways)
        ways = longer
    unstage(nodes, ways)
    return path


def format_paths(path: DataFrame, messages: DataFrame) -> DataFrame:
    """(root, leaf, formatted): one conversation per path; messages: node, role, text, order."""
    turn = F.concat(F.lit(OPEN), _escaped(F.col("role"), r"|\n"), F.lit("\n"), _escaped(F.col("text")), F.lit(CLOSE))
    rows = path.join(messages.select("node", turn.alias("turn")), "node")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "node", "turn"))), lambda x: x["turn"])
    return rows.groupBy("root", "leaf").agg(F.array_join(turns, "").alias("formatted"))


_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n<]+|\\.|<(?!\|))*)\n((?:[^\\<]+|\\.|<(?!\|))*)<\|im_end\|>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append(tuple(_ESCAPE.sub(r"\1", x) for x in found.groups()))
        at = found.end()
    return turns


def _digest(formatted: pd.Series) -> pd.DataFrame:
    rows = []
    for text in formatted:
        turns = read_back(text)
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: str):
    """What the formatted conversations in this column say, read back: a struct of counts and digests."""
    return F.pandas_udf(_digest, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")(formatted)


def messages_of_turns(turns: DataFrame) -> DataFrame:
    """node, parent, score, role, text, conv_id: each turn (conv_id, turn, role, text) answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(order).alias("k"), "role", "text")
    node = lambda k: F.struct("conv_id", k.cast("int").alias("k"))
    k = F.col("k")
    return numbered.select(node(k).alias("node"), F.when(k > 1, node(k - 1)).alias("parent"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text")
