"""Operator 9: chat formatting over reply trees.

Messages form trees by parent. Self-joins that double the distance walked give
every message its depth and score sum and every branch its path in a logarithmic
number of rounds; branches are ranked by mean score, and each chosen root-to-leaf
path becomes one conversation with a loss mask over what the assistant said.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quillstream.llm.common import map_rows, written

#: The template: fixed values of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Turns that are put together in one step before their conversation is.
BLOCK = 256


def escaped(text: str) -> str:
    """No control string is left in the result; ``unescaped`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chains(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Messages without parents, each answering the one before it in ``order``: adds (_tree, _node, _parent).

    Places are counted in two steps, so that a long conversation isn't sorted in
    one task. Equal places are ordered by role and a hash of the text; nulls first.
    """
    keyed = rows.withColumn("_tree", F.coalesce(F.col(tree).cast("string"), F.lit("null")))
    keyed = keyed.withColumn("_part", F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(-(2 ** 62))))
    keyed = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_tree", "_part").orderBy(order, "role", F.xxhash64("text"))))
    parts = keyed.groupBy("_tree", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_tree").orderBy("_part")) - F.col("_n")
    placed = keyed.join(parts.select("_tree", "_part", before.alias("_before")), ["_tree", "_part"])
    node = (F.col("_before") + F.col("_in") - 1).cast("bigint")
    return placed.withColumn("_node", node).withColumn("_parent", F.when(node > 0, node - 1)).drop("_part", "_in", "_before")


def _goes_on(jumps: DataFrame) -> bool:
    """Whether the last round settled some messages and left others."""
    state = jumps.agg(F.bool_or(F.col("_up").isNull()).alias("settled"), F.bool_or(F.col("_up").isNotNull()).alias("left")).first()
    return bool(state["settled"] and state["left"])


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(_tree, _path, _node, _depth): the messages of the ``branches`` best root-to-leaf paths of every tree.

    ``nodes`` has (_tree, _node, _parent, _score), _node unique in its tree. A path
    is named by its leaf and ranked by mean score, then smaller leaf. A message
    whose parent is missing is a root; messages on a cycle belong to no path; a
    null score counts as zero.
    """
    score = F.coalesce(F.col("_score").cast("double"), F.lit(0.0))
    known = nodes.select("_tree", F.col("_node").alias("_parent"), F.lit(True).alias("_there"))
    first = nodes.join(known, ["_tree", "_parent"], "left").select(
        "_tree", "_node", F.when(F.col("_there"), F.col("_parent")).alias("_up"), score.alias("_sum"), F.lit(1).cast("bigint").alias("_steps"))
    # A message that has reached its root is settled: later rounds look it up but don't carry it along.
    jumps, settled = [written(first, "reply-jumps")], []
    # A tree has messages at every depth up to its own, so each round settles some of every unfinished one:
    # where a round settled none, what is left lies on cycles or behind them.
    while _goes_on(jumps[-1]):
        a, b = jumps[-1].where(F.col("_up").isNotNull()).alias("a"), reduce(DataFrame.unionByName, settled, jumps[-1]).alias("b")
        doubled = a.join(b, (F.col("a._tree") == F.col("b._tree")) & (F.col("a._up") == F.col("b._node")))
        settled.append(jumps[-1].where(F.col("_up").isNull()))
        jumps.append(written(doubled.select(
            "a._tree", "a._node", F.col("b._up").alias("_up"), (F.col("a._sum") + F.col("b._sum")).alias("_sum"),
            (F.col("a._steps") + F.col("b._steps")).alias("_steps")), "reply-jumps"))
    reached = reduce(DataFrame.unionByName, settled, jumps[-1].where(F.col("_up").isNull()))
    parents = jumps[0].where(F.col("_up").isNotNull()).select("_tree", F.col("_up").alias("_node")).distinct()
    rank = F.row_number().over(Window.partitionBy("_tree").orderBy((F.col("_sum") / F.col("_steps")).desc(), "_node"))
    leaves = reached.join(parents, ["_tree", "_node"], "left_anti").withColumn("_rank", rank).where(F.col("_rank") <= branches)
    found = written(leaves.select("_tree", F.col("_node").alias("_path"), "_node"), "reply-paths")
    # Every distance from a leaf is one sum of different jumps: each ancestor is met once.
    for jump in reversed(jumps[:-1]):
        up = jump.where(F.col("_up").isNotNull()).select("_tree", "_node", "_up")
        higher = found.join(up, ["_tree", "_node"]).select("_tree", "_path", F.col("_up").alias("_node"))
        found = written(found.unionByName(higher), "reply-paths")
    return found.join(reached.select("_tree", "_node", (F.col("_steps") - 1).alias("_depth")), ["_tree", "_node"])


def formatted(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(_tree, _path, formatted, loss): one conversation per chosen path of ``nodes`` (with role and text).

    ``loss`` holds [start, end) of each stretch under the mask, in characters of
    ``formatted``: what the assistant said, without template. A null role or text
    is empty. No messages give no conversations.
    """
    turns = paths(nodes, branches).join(nodes.select("_tree", "_node", "role", "text"), ["_tree", "_node"])
    turn = F.struct("_depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = turns.groupBy("_tree", "_path", F.floor(F.col("_depth") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def write_turns():
        def work(c):
            texts, masks = [], []
            for turns in c["turns"]:
                parts, mask, at = [], [], 0
                for turn in turns:
                    head, body = f"{OPEN}{escaped_role(turn['role'])}\n", escaped(turn["text"])
                    if turn["role"] == LEARNED:
                        mask += [at + len(head), at + len(head) + len(body)]
                    parts.append(f"{head}{body}{CLOSE}\n")
                    at += len(parts[-1])
                texts.append("".join(parts))
                masks.append(mask)
            return {**{k: c[k] for k in ("_tree", "_path", "_block")}, "part": texts, "mask": masks}
        return work

    written_turns = map_rows(blocks, write_turns, "_tree string, _path bigint, _block bigint, part string, mask array<bigint>")
    whole = written_turns.groupBy("_tree", "_path").agg(F.sort_array(F.collect_list(F.struct("_block", "part", "mask"))).alias("parts"))

    def join_parts():
        def work(c):
            texts, masks = [], []
            for parts in c["parts"]:
                at, mask = 0, []
                for part in parts:
                    mask += [x + at for x in part["mask"]]
                    at += len(part["part"])
                texts.append("".join(p["part"] for p in parts))
                masks.append(mask)
            return {"_tree": c["_tree"], "_path": c["_path"], "formatted": texts, "loss": masks}
        return work

    return map_rows(whole, join_parts, "_tree string, _path bigint, formatted string, loss array<bigint>")


def parsed(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    found = []
    for piece in text.split(f"{CLOSE}\n")[:-1]:
        if not piece.startswith(OPEN):
            raise ValueError("not a formatted conversation")
        role, _, body = piece[len(OPEN):].partition("\n")
        found.append((unescaped(role), unescaped(body)))
    return found


def digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, text under the mask, sizes."""
    def make():
        def work(c):
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, mask in zip(c["formatted"], c["loss"]):
                turns = parsed(text)
                learned = "".join(unescaped(text[a:b]) for a, b in zip(mask[::2], mask[1::2]))
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            return {"_tree": c["_tree"], **out}
        return work
    return map_rows(conversations, make, "_tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation_digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation of (conv_id, turn, role, text) as a tree of one branch, formatted and read back.

    Rows of a conversation with equal turns, repeated rows included, follow one
    another; rows with a null conv_id are one conversation.
    """
    nodes = written(chains(rows.select(conv, turn, "role", "text"), conv, turn).withColumn("_score", F.lit(0.0)), "reply-nodes")
    return digests(formatted(nodes)).select(F.when(F.col("_tree") != "null", F.col("_tree")).cast("bigint").alias(conv), *[
        "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
