"""Reply trees as training conversations.

Messages point at the message they answer. Self-joins of pointers that double in reach give
every message its root, depth and branch score; the branches (root-to-leaf paths) of a tree are
ranked by score; and each chosen branch is written as one conversation.

In the written text a turn is ``<s>[INST] role [/INST]text</s>``. Control strings inside roles and
texts are broken by a backslash after their first character, and backslashes are doubled, so
that the text can be taken apart again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtender.llm.order import positions
from fairtender.llm.staging import keep

# fixed values: strings that a chat template or tokenizer may take for control marks
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_BROKEN = re.compile(r"\\(.?)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def write_turns(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """One conversation as text, and the loss mask: bounds of assistant texts in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escape(role)} [/INST]", escape(text)
        if role == "assistant":
            mask.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(parts), mask


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a written conversation."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def chain(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees of one branch: tree, node, parent, role, text, score.

    Each turn answers the one before. Turns that share a number stand by role, then text; missing
    values come first. A missing role or text counts as empty.
    """
    rows = messages.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = keep(positions(rows, [F.col(c) for c in ("tree", "turn", "role", "text")], "node"), "turns")
    before = placed.select(F.col("tree").alias("_tree"), (F.col("node") + 1).alias("_next"), F.col("node").alias("parent"))
    joined = placed.join(before, placed["tree"].eqNullSafe(before["_tree"]) & (placed["node"] == before["_next"]), "left")
    return joined.select("tree", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, node: Column, other: Column) -> Column:
    return a["tree"].eqNullSafe(b["_tree"]) & (node == other)


def branches(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Chosen branches: one row per branch and message on it (tree, leaf, rank, depth, node).

    ``messages`` has tree, node, parent and score; node numbers are unique in a tree. A message
    whose parent is missing from its tree is a root; messages on a cycle belong to no branch. A
    branch's score is the mean over its messages (missing: 0); ties go to the smaller leaf. The
    ``top`` branches of a tree are chosen, or all. The number of rounds is the logarithm of the
    greatest depth.
    """
    slim = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = slim.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    held = slim.join(nodes, _same(slim, nodes, slim["parent"], nodes["_node"]), "left")
    # jump: an ancestor, as many steps above as a power of two; total: the score up to below it
    jumps = [keep(held.select("tree", "node", F.col("_node").alias("jump"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "jumps")]
    most = max(1, messages.count())
    while True:
        a = jumps[-1]
        b = a.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("jump").alias("_jump"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        if 1 << (len(jumps) - 1) > most or not a.filter("jump is not null").limit(1).count():
            break
        far = a.join(b, _same(a, b, a["jump"], b["_node"]), "left")
        jumps.append(keep(far.select("tree", "node", F.col("_jump").alias("jump"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total")), "jumps"))
    # what still has an ancestor after more steps than there are messages is on a cycle or below one
    whole = jumps[-1].filter("jump is null")
    answered = slim.select(F.col("tree").alias("_tree"), F.col("parent").alias("_node")).filter("_node is not null").distinct()
    leaves = whole.join(answered, _same(whole, answered, whole["node"], answered["_node"]), "left_anti")
    by = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(by))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    paths = keep(ranked.select("tree", F.col("node").alias("leaf"), "rank", "depth", "node"), "paths")
    for k, step in enumerate(jumps[:-1]):  # each round doubles the lower part of the branches
        up = step.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "jump").filter("jump is not null")
        far = paths.join(up, _same(paths, up, paths["node"], up["_node"]))
        more = far.select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("jump").alias("node"))
        paths = keep(paths.unionByName(more), "paths")
    return paths


def conversations(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Chosen branches of reply trees as conversations: tree, rank, text, mask.

    ``messages`` has tree, node, parent, role, text and score, see ``branches``. The turns of one
    conversation meet in one task, as they make up one text; a conversation is as long as its
    branch. Missing roles and texts count as empty; other columns are left out.
    """
    paths = branches(messages, top)
    turns = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    full = paths.join(turns, _same(paths, turns, paths["node"], turns["_node"]))
    grouped = full.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [write_turns([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            yield pd.DataFrame({"tree": pdf["tree"].astype("Int64"), "rank": pdf["rank"], "text": [d[0] for d in done], "mask": [d[1] for d in done]})

    return grouped.mapInPandas(write, "tree long, rank int, text string, mask array<array<int>>")


def digests(written: DataFrame) -> DataFrame:
    """What written conversations hold, read back from text and mask."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for tree, text, mask in zip(pdf["tree"], pdf["text"], pdf["mask"], strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[a:b]) for a, b in mask)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((tree, len(turns), sha(told), len(loss), sha(loss), len(text)))
            frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.astype({"conv_id": "Int64"})

    return written.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
