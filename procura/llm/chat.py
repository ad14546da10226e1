r"""Chat formatting: reply trees, their best root-to-leaf paths, and one training text for each path.

A message knows its parent. Paths are found by iterative self-joins that double their reach:
after round k each message knows the ancestor 2^k steps above it and the scores in
between, so a chain of 400 replies takes 9 rounds. Leaves are ranked in their tree by the score of
their whole branch, and only the chosen branches are then spelled out, again by one
join for each power of two.

A path becomes one text. Each turn stands between ``<s>`` and ``</s>``:

    <s>[INST] a user's text [/INST]</s><s>an assistant's text</s><s>[ROLE] system [/ROLE] a text of any other role</s>

Control strings inside texts and roles are broken by a backslash after their first character, and each
backslash of theirs is doubled, so ``unescape`` gives back what was written. The loss mask is the list of
code-point spans of the assistant's texts in the formatted text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import row_key

USER, ASSISTANT = "user", "assistant"
TURN_OPEN, TURN_CLOSE = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE] "
_ESCAPED = r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])"
_UNESCAPED = r"(<)\\(?=/?s>)|(\[)\\(?=/?(?:INST|ROLE)\])|\\(\\)"

MASK_SCHEMA = "array<struct<start: bigint, stop: bigint>>"


def escape(text: Column) -> Column:
    """The text with its control strings broken. NULL becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _ESCAPED, r"$0\\")


def unescape(text: str) -> str:
    return re.sub(_UNESCAPED, lambda m: m[1] or m[2] or m[3], text)


def reply_paths(messages: DataFrame, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent",
                score_col: str = "score", paths: int | None = 1) -> DataFrame:
    """The best root-to-leaf paths of every reply tree: ``tree``, ``leaf``, ``branch`` (rank of the path in its
    tree, from 1), ``branch_score`` (sum of scores on the path), ``node`` and ``depth`` (0 at the root).

    Paths rank by score, then by the smaller leaf; ``paths`` is how many of a tree are formatted (None: all).

    Cases: a parent that is NULL or no node of the tree makes a root, so a tree may have several. A NULL score
    counts 0. Of rows with the same tree and node one stays (the smallest parent and score). NULL trees and nodes are
    a value like any other. Messages on a cycle of parents, or below one, have no root and are on no path. An empty
    table has no path. Other columns are not read.

    Every join is by (tree, node), so a tree with many messages is spread over tasks."""
    key, up = row_key(F.col(tree_col), F.col(node_col)), row_key(F.col(tree_col), F.col(parent_col))
    found = messages.select(key.alias("key"), F.when(F.col(parent_col).isNotNull(), up).alias("up"), F.col(tree_col).alias("tree"),
                            F.col(node_col).alias("node"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"))
    found = found.groupBy("key").agg(F.min(F.struct("up", "score", "tree", "node")).alias("m")).select("key", "m.*")
    # Rows without a parent get a key of their own that no node has, so they do not meet in one task.
    found = found.withColumn("at", F.coalesce("up", F.concat(F.lit("r"), "key")))
    known = found.select(F.col("key").alias("at"), F.lit(True).alias("there"))
    nodes = materialize(found.join(known, "at", "left").withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there", "at"), "messages")

    # jumps[k]: the ancestor 2^k steps above, of the nodes that have one. Nodes whose root is reached are settled
    # and only looked up from then on, so a round costs what still climbs.
    state = nodes.select("key", "up", F.lit(1).cast("long").alias("length"), "score")
    jumps: list[DataFrame] = []
    settled: list[DataFrame] = []
    most = nodes.count()
    while True:
        climbing = state.filter(F.col("up").isNotNull())
        settled.append(state.filter(F.col("up").isNull()))
        if climbing.isEmpty() or 1 << len(jumps) > 2 * most:  # what still has an ancestor then is on or below a cycle
            break
        jumps.append(climbing.select("key", "up"))
        above = reduce(DataFrame.unionByName, settled, climbing).select(
            F.col("key").alias("up"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("score").alias("sum"))
        state = materialize(climbing.join(above, "up").select(
            "key", F.col("next").alias("up"), (F.col("length") + F.col("more")).alias("length"),
            (F.col("score") + F.col("sum")).alias("score")), "reply_jumps")
    rooted = reduce(DataFrame.unionByName, settled).select("key", "length", F.col("score").alias("branch_score"))

    parents = nodes.filter(F.col("up").isNotNull()).select(F.col("up").alias("key")).distinct()
    leaves = nodes.join(parents, "key", "left_anti").join(rooted, "key") \
        .select("tree", "node", "key", "length", "branch_score")
    best_first = W.partitionBy("tree").orderBy(F.col("branch_score").desc(), F.col("node"), F.col("key"))
    ranked = leaves.withColumn("branch", F.row_number().over(best_first))
    if paths is not None:
        ranked = ranked.filter(F.col("branch") <= paths)
    walk = ranked.select("tree", F.col("node").alias("leaf"), F.col("key").alias("leaf_key"), "branch", "branch_score", "key",
                         (F.col("length") - 1).alias("depth"))
    for k, jump in reversed(list(enumerate(jumps))):  # the longest first, while few nodes are on the walk
        on = F.col("up").isNotNull()
        both = F.array(F.struct("key", "depth"), F.struct(F.col("up").alias("key"), (F.col("depth") - (1 << k)).alias("depth")))
        walk = walk.join(jump, "key", "left").select(
            "tree", "leaf", "leaf_key", "branch", "branch_score", F.inline(F.when(on, both).otherwise(F.slice(both, 1, 1))))
    return walk.join(nodes.select("key", "node"), "key") \
        .select("tree", "leaf", "leaf_key", "branch", "branch_score", "node", F.col("key").alias("node_key"), "depth")


def format_conversations(messages: DataFrame, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent",
                         role_col: str = "role", text_col: str = "text", score_col: str = "score", paths: int | None = 1) -> DataFrame:
    """The chosen paths of every reply tree as formatted conversations.

    Result: one row per path with ``tree``, ``leaf``, ``branch``, ``branch_score``, ``formatted`` (see the module) and
    ``loss_mask`` (spans [start, stop) of the assistant's texts in code points, in order).

    Cases: as :func:`reply_paths`; NULL and empty texts are turns without text; a NULL role is a role without
    name; consecutive turns of one role stay apart. Of rows with the same tree and node one text stays (the smallest
    role and text). A conversation is one row of the result, so one task joins its turns; nothing else is gathered."""
    chosen = reply_paths(messages, tree_col, node_col, parent_col, score_col, paths)
    role, text = F.coalesce(F.col(role_col), F.lit("")), escape(F.col(text_col))
    head = F.when(role == USER, USER_OPEN).when(role == ASSISTANT, "") \
        .otherwise(F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE)))
    tail = F.when(role == USER, USER_CLOSE).otherwise("")
    turns = messages.select(row_key(F.col(tree_col), F.col(node_col)).alias("node_key"), F.struct(
        F.concat(F.lit(TURN_OPEN), head).alias("head"), text.alias("body"), F.concat(tail, F.lit(TURN_CLOSE)).alias("tail"),
        (role == ASSISTANT).alias("learnt")).alias("turn"))
    turns = turns.groupBy("node_key").agg(F.min("turn").alias("turn"))
    laid = chosen.join(turns, "node_key").select("tree", "leaf", "leaf_key", "branch", "branch_score", "depth", "turn.*")
    path = ["leaf_key"]
    size = F.length("head") + F.length("body") + F.length("tail")
    before = F.coalesce(F.sum(size).over(W.partitionBy(*path).orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    laid = laid.withColumn("start", before + F.length("head")).withColumn("stop", F.col("start") + F.length("body"))
    whole = laid.groupBy(*path).agg(
        F.first(F.struct("tree", "leaf", "branch", "branch_score")).alias("p"),
        F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", "tail").alias("turn"), "learnt", "start", "stop"))).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(
        t["start"].cast("long").alias("start"), t["stop"].cast("long").alias("stop")))
    return whole.select("p.*", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), mask.alias("loss_mask"))


_TURN = re.compile(r"<s>(?:(\[INST\] )|\[ROLE\] (.*?) \[/ROLE\] |)(.*?)</s>", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for user, role, body in (m.groups() for m in _TURN.finditer(formatted)):
        if user:
            turns.append((USER, unescape(body.removesuffix(USER_CLOSE))))
        else:
            turns.append((ASSISTANT if role is None else unescape(role), unescape(body)))
    return turns


def read_back(conversations: DataFrame, carry: tuple[str, ...] = ("tree",)) -> DataFrame:
    """What formatted conversations hold: ``carry``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of
    every turn), ``loss_chars`` and ``loss_sha256`` of all text under the loss mask, unescaped, and ``formatted_chars``.
    Everything is read from ``formatted`` and ``loss_mask``."""
    source = conversations.select(*carry, "formatted", "loss_mask")
    digest = T.StructType.fromDDL("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    schema = T.StructType([*(source.schema[c] for c in carry), *digest.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[m["start"]:m["stop"]]) for m in mask)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             schema.names)

    return source.mapInArrow(read, schema)


def chains(turns: DataFrame, tree_col: str, order: list[str], carry: list[str]) -> DataFrame:
    """Plain conversations as reply trees: each row's parent is the row before it (by ``order``), its score 1.

    ``node`` is the row's number in its conversation, from 0."""
    node = (F.row_number().over(W.partitionBy(tree_col).orderBy(*order)) - 1).cast("long")
    return turns.select(F.col(tree_col).alias("tree"), *carry, node.alias("node")).withColumn(
        "parent", F.when(F.col("node") > 0, F.col("node") - 1)).withColumn("score", F.lit(1.0))
