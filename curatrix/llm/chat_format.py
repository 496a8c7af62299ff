"""Chat formatting (3): reply trees to conversations.

Messages point to the message they answer. Runs of messages that are their
parent's only answer are drawn together by pointer jumping, a self-join that
doubles its reach each round; the runs form a much shallower tree, and further
self-joins enumerate its paths from root to leaf. Paths are ranked by the mean
score of their messages and the best of each tree are written as one
conversation each.

The template is ``### role: text</turn>`` and a line end for each turn. In texts
and roles a backslash is put before every backslash, before ``</turn>`` and
before ``###``, in roles also before every colon; reading back takes them away.
The loss mask is the list of spans, in code points of the formatted text, that
hold the assistant's escaped texts.

Defined cases: a null text or role counts as empty. Equal turns of one
conversation are ordered by role, then text. A message whose parent is not there
is a root. Messages that answer each other in a circle are on no path and in no
conversation. A message without an id can answer but not be answered. Of messages
that repeat an id of their tree, the least by parent, role, text and score is the
one that others answer; the rest can only answer. A null tree is a tree. An empty table gives no rows. Other columns
are not read. A conversation is one output row, so its size is bounded by the
conversation's own.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from curatrix.llm.common import col, materialize

END = "</turn>"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(END, "\\" + END).replace("###", "\\###")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {escape(role or '').replace(':', chr(92) + ':')}: "
        body = escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation; an error if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def linear(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply trees of plain conversations: each turn answers the one before."""
    rows = messages.select(
        col(conv_col).alias("tree"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def told_apart(messages: DataFrame) -> DataFrame:
    """``messages`` with ids that differ within their tree: those missing or repeated get new ones below all others."""
    order = ["parent", "role", "text", "score"]
    nth = F.row_number().over(W.partitionBy("tree", "id").orderBy(*order))
    rows = messages.withColumn("own", F.col("id").isNotNull() & (nth == 1))
    least = F.coalesce(F.min("id").over(W.partitionBy("tree")), F.lit(0).cast("long"))
    below = least - F.row_number().over(W.partitionBy("tree", "own").orderBy("id", *order))
    return rows.withColumn("new", F.when(F.col("own"), F.col("id")).otherwise(below)).drop("id", "own").withColumnRenamed("new", "id")


def _runs(nodes: DataFrame) -> DataFrame:
    """(tree, id, parent, score, run, place): each message's run, by its first id, and place there."""
    answers = nodes.groupBy("tree", "parent").agg(F.count(F.lit(1)).alias("n"))
    ids = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    same = F.col("tree").eqNullSafe(F.col("t"))
    joined = nodes.join(answers.withColumnRenamed("tree", "t2").withColumnRenamed("parent", "p2"), F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("p2")), "left")
    joined = joined.join(ids, same & (F.col("parent") == F.col("i")), "left")
    first = F.col("i").isNull() | (F.col("n") > 1)
    state = joined.select(
        "tree", "id", F.when(F.col("i").isNotNull(), F.col("parent")).alias("parent"), "score",
        F.when(first, F.col("id")).otherwise(F.col("parent")).alias("run"), F.when(first, 0).otherwise(1).cast("long").alias("place"), first.alias("done"),
    )
    # Only messages whose run is still open are joined again.
    state = materialize(state, "runs")
    ended, open_ = state.where("done"), state.where("NOT done")
    left = open_.count()
    while left:
        ahead = ended.unionByName(open_).select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("run").alias("r"), F.col("place").alias("p"), F.col("done").alias("d"))
        step = open_.join(ahead, F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("i"))).select(
            "tree", "id", "parent", "score", F.col("r").alias("run"), (F.col("place") + F.col("p")).alias("place"), F.col("d").alias("done")
        )
        step = materialize(step, "runs")
        ended, open_ = ended.unionByName(step.where("done")), step.where("NOT done")
        before, left = left, open_.count()
        if left == before:
            break  # only circles are left
    return ended


def paths(messages: DataFrame, best: int | None = 1) -> tuple[DataFrame, DataFrame]:
    """(tree, leaf, rank, score, place, run): the runs on each chosen path, in order; and the messages' runs.

    ``messages`` has the columns of ``linear``, with ids that differ within a tree. ``best`` paths of each tree are
    chosen, all if it is None.
    """
    nodes = _runs(messages.select("tree", "id", "parent", "score"))
    runs = nodes.groupBy("tree", "run").agg(
        F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("place") == 0, F.col("parent"))).alias("above"), F.max_by("id", "place").alias("last"),
    )
    over = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("run").alias("parent_run"))
    runs = runs.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("above") == F.col("i")), "left").select("tree", "run", "total", "n", "parent_run", "last")
    runs = materialize(runs, "segments")
    inner = runs.where("parent_run IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent_run").alias("r")).distinct()
    runs = materialize(runs.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("r")), "left").select("tree", "run", "total", "n", "parent_run", "last", F.col("r").isNull().alias("leaf")), "segments")
    open_ = runs.where("parent_run IS NULL").select("tree", "run", "leaf", "last", "total", "n", F.array("run").alias("path"))
    done = None
    while True:
        ended = open_.where("leaf").select("tree", F.col("last").alias("leaf"), "total", "n", "path")
        done = ended if done is None else done.unionByName(ended)
        going = open_.where("NOT leaf").select(F.col("tree").alias("t"), F.col("run").alias("r"), F.col("total").alias("so_far"), F.col("n").alias("m"), "path")
        if not going.limit(1).count():
            break
        step = runs.join(going, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent_run") == F.col("r")))
        open_ = materialize(step.select(
            "tree", "run", "leaf", "last", (F.col("total") + F.col("so_far")).alias("total"), (F.col("n") + F.col("m")).alias("n"), F.concat("path", F.array("run")).alias("path")
        ), "paths")
    ranked = done.withColumn("score", F.col("total") / F.col("n"))
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    out = ranked.select("tree", "leaf", "rank", "score", F.posexplode("path").alias("place", "run"))
    return out, nodes


def conversations(messages: DataFrame, best: int | None = 1, numbered: bool = False) -> DataFrame:
    """(tree, leaf, rank, formatted, starts, ends): one row for each chosen path.

    ``numbered`` says that ids are there and differ, as those of ``linear`` do.
    """
    messages = messages if numbered else materialize(told_apart(messages), "messages")
    chosen, nodes = paths(messages, best)
    at = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("run").alias("r"), F.col("place").alias("within"))
    texts = messages.select(F.col("tree").alias("t3"), F.col("id").alias("i3"), "role", "text")
    full = chosen.join(at, F.col("tree").eqNullSafe(F.col("t")) & (F.col("run") == F.col("r")))
    full = full.join(texts, F.col("tree").eqNullSafe(F.col("t3")) & (F.col("i") == F.col("i3")))
    turns = full.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "within", "role", "text"))).alias("turns"))
    return turns.select("tree", "leaf", "rank", arrow_udf(_render, "struct<formatted:string,starts:array<bigint>,ends:array<bigint>>")("turns").alias("f")).select(
        "tree", "leaf", "rank", "f.formatted", "f.starts", "f.ends"
    )


def _render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("formatted", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for turns in batch.to_pylist():
            formatted, spans = render([(t["role"], t["text"]) for t in turns])
            rows.append({"formatted": formatted, "starts": [s for s, _ in spans], "ends": [e for _, e in spans]})
        yield pa.array(rows, type=kind)


def read_back(formatted: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Digests of what a formatted text and its loss mask hold."""
    rows = []
    for text, s, e in zip(formatted.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        turns = parse(text)
        loss = "".join(unescape(text[a:b]) for a, b in zip(s, e))
        rows.append({
            "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text),
        })
    return pa.array(rows, type=pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
