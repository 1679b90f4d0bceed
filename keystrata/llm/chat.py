"""Chat formatting: a prefix tree of conversations.

Each turn is formatted by a template whose control strings cannot occur in
escaped text.  A turn's node is the hash of all turns up to it, so conversations
with the same first turns share their nodes, and each node's text is written once,
depth-first, with the position of its first character in its conversations and the
intervals of the layout that its ancestors take, merged where they touch: what its
characters attend to besides themselves.

The smallest conversation through a node owns it; each conversation owns the end
of its path, its *chain*.  A node's children are visited with its owner's next
turn first, so a chain lies in one piece and the tree of chains gives the order:
chains sort by the list of (depth from the deepest, conversation) at which their
path changes owners, which is short even for long conversations.

Conversations are streamed in order of their turns through tasks that hold one
slice, so neither a long conversation nor a first turn that many share is ever
gathered; offsets come from sums by partition of a range partitioning.

Each node's turn is tokenized once.  Nodes hold its ids, and places, position ids and
ancestor intervals in tokens, for training, and in characters, for reading texts back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freeing, pieces_of, stored
from .tokenizing import tokenizer

HEAD, END = "### ", "</turn>\n"
ASSISTANT = "assistant"
#: Escapes: no control string can be spelled without # or <, nor a role end without a line break.
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
_ROLE_ESCAPES = _ESCAPES | {"\n": "\\n"}
_BACK = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\n": "\n"}
_PLAIN = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<\n]")
_ESCAPED = re.compile(r"\\[\\hln]")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def formatted(role: str, text: str) -> str:
    """One turn: ``### role``, its text, ``</turn>``."""
    return HEAD + _ROLE.sub(lambda m: _ROLE_ESCAPES[m[0]], role) + "\n" + escape(text) + END


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    at = turn.index("\n")
    if not turn.startswith(HEAD) or turn.find(END) != len(turn) - len(END):
        raise ValueError("not a formatted turn")
    return unescape(turn[len(HEAD) : at]), unescape(turn[at + 1 : -len(END)])


def _kinds(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


STEPS = "conv long, depth long, node binary, at long, size long, loss_from long, loss_to long, turn string"
CHAINS = "owner long, chain binary"
TURNS = "node binary, owner long, depth long, size long, loss_from long, loss_to long, turn string, n_tokens long, ids array<int>"
LAID = "part int, owner long, node binary, size long, inside long, n_tokens long, token_inside long"
NODES = (
    "start long, size long, depth long, position long, ancestors_from array<long>, ancestors_to array<long>, "
    "token_start long, n_tokens long, token_position long, token_ancestors_from array<long>, token_ancestors_to array<long>, node binary"
)
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Stands for a null conversation in the tree; such rows are one conversation.
NO_CONV = -(1 << 63)


def _sorted_by_turn(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition(F.col("conv")).sortWithinPartitions("conv", *more)


def _stream(schema: str, step, rows: int = 1024):
    """A function for mapInArrow: ``step`` is made once for a task and gets each row, and None last; it yields rows out."""

    def run(batches):
        kinds, own = _kinds(schema), step()
        for batch in batches:
            for part in pieces_of(batch, rows):
                out = [x for r in part.to_pylist() for x in own(r)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if out := list(own(None)):
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return run


def _walk():
    """Each turn, formatted, with its node and its place."""
    conv, node, depth, at = (), b"", 0, 0

    def step(r):
        nonlocal conv, node, depth, at
        if r is None:
            return
        if (r["conv"],) != conv:
            conv, node, depth, at = (r["conv"],), b"", 0, 0
        turn = formatted(r["role"], r["text"])
        node = hashlib.blake2b(node + turn.encode(), digest_size=16).digest()
        loss = (turn.index("\n") + 1, len(turn) - len(END)) if r["role"] == ASSISTANT else (0, 0)
        yield {"conv": r["conv"], "depth": depth, "node": node, "at": at, "size": len(turn), "loss_from": loss[0], "loss_to": loss[1], "turn": turn}
        depth, at = depth + 1, at + len(turn)

    return step


def _chain():
    """The key of each conversation that owns nodes: 16 bytes for each change of owner along its path."""
    conv, owner, key = None, None, b""

    def step(r):
        nonlocal conv, owner, key
        if r is None or r["conv"] != conv:
            if owner is not None and owner == conv:
                yield {"owner": conv, "chain": key}
            if r is None:
                return
            conv, owner, key = r["conv"], None, b""
        if r["owner"] != owner:
            owner = r["owner"]
            key += ((1 << 63) - 1 - r["depth"]).to_bytes(8, "big") + (owner + (1 << 63)).to_bytes(8, "big")

    return step


def _tokenized(path: str):
    def step_of():
        own = tokenizer(path)

        def step(r):
            if r is not None:
                ids = own.encode(r["turn"], add_special_tokens=False).ids
                yield r | {"n_tokens": len(ids), "ids": ids}

        return step

    return step_of


def _lay():
    part, inside, token_inside = TaskContext.get().partitionId(), 0, 0

    def step(r):
        nonlocal inside, token_inside
        if r is None:
            return
        yield {"part": part, "owner": r["owner"], "node": r["node"], "size": r["size"], "inside": inside, "n_tokens": r["n_tokens"], "token_inside": token_inside}
        inside, token_inside = inside + r["size"], token_inside + r["n_tokens"]

    return step


class _Intervals:
    """Intervals in ascending order, merged where they touch."""

    def __init__(self):
        self.begins, self.ends = [], []

    def add(self, start: int, size: int) -> None:
        if not size:
            return
        if self.ends and self.ends[-1] == start:
            self.ends[-1] += size
        else:
            self.begins.append(start)
            self.ends.append(start + size)


def _ancestors():
    """Each owned node with the merged intervals of the nodes before it on its path."""
    conv, chars, tokens, at = (), _Intervals(), _Intervals(), 0

    def step(r):
        nonlocal conv, chars, tokens, at
        if r is None:
            return
        if (r["conv"],) != conv:
            conv, chars, tokens, at = (r["conv"],), _Intervals(), _Intervals(), 0
        if r["owner"] == r["conv"]:
            yield {
                "start": r["start"], "size": r["size"], "depth": r["depth"], "position": r["at"], "ancestors_from": list(chars.begins), "ancestors_to": list(chars.ends),
                "token_start": r["token_start"], "n_tokens": r["n_tokens"], "token_position": at, "token_ancestors_from": list(tokens.begins), "token_ancestors_to": list(tokens.ends), "node": r["node"],
            }
        chars.add(r["start"], r["size"])
        tokens.add(r["token_start"], r["n_tokens"])
        at += r["n_tokens"]

    return step


def _read():
    conv, n, size, loss, turns, texts = (), 0, 0, 0, None, None

    def step(r):
        nonlocal conv, n, size, loss, turns, texts
        if r is None or (r["conv"],) != conv:
            if conv:
                yield {"conv_id": None if conv[0] == NO_CONV else conv[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss, "loss_sha256": texts.hexdigest(), "formatted_chars": size}
            if r is None:
                return
            conv, n, size, loss, turns, texts = (r["conv"],), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        role, text = parsed(r["turn"])
        turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(r["turn"][r["loss_from"] : r["loss_to"]])
        texts.update(masked.encode())
        n, size, loss = n + 1, size + len(r["turn"]), loss + len(masked)

    return step


def write_tree(turns: DataFrame, path: str, tokenizer_path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> None:
    """Writes ``path``/nodes (each shared turn once, in depth-first order) and ``path``/paths (conv, depth, start: the nodes of each conversation).

    Nodes have the turn's text, its ids by the tokenizer, and in characters and in tokens
    their start in the layout, their position in their conversations and the intervals of their ancestors.

    Null texts and roles are empty.  Null turn numbers come first; rows of the
    same turn follow one another by role and text.  Rows without a conversation
    are one conversation.  An empty table gives no node.  Other columns are left out.
    """
    rows = turns.select(F.coalesce(F.col(f"`{conv}`").cast("long"), F.lit(NO_CONV)).alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    steps = stored(_sorted_by_turn(rows, "turn", "role", "text").mapInArrow(freeing(_stream(STEPS, _walk)), STEPS), "chat-steps")
    first = [F.first(c).alias(c) for c in ("depth", "size", "loss_from", "loss_to")]
    # the texts of a node are equal, so any one is its text: dropped to one for each task before they are shuffled
    owners = steps.groupBy("node").agg(F.min("conv").alias("owner"), *first, F.first("turn").alias("turn"))
    owners = stored(owners.mapInArrow(freeing(_stream(TURNS, _tokenized(tokenizer_path))), TURNS), "chat-turns")
    steps = steps.select("conv", "depth", "node", "at", "size")
    owned = steps.select("conv", "depth", "node").join(owners.select("node", "owner"), "node").select("conv", "depth", "owner")
    chains = _sorted_by_turn(owned, "depth").mapInArrow(freeing(_stream(CHAINS, _chain)), CHAINS)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = owners.select("node", "owner", "depth", "size", "n_tokens").join(chains, "owner").repartitionByRange(parts, "chain", "depth").sortWithinPartitions("chain", "depth")
    laid = stored(order.select("owner", "node", "size", "n_tokens").mapInArrow(freeing(_stream(LAID, _lay)), LAID), "chat-layout")
    begins = laid.groupBy("part").agg(F.sum("size").alias("n"), F.sum("n_tokens").alias("m")).selectExpr("part", "sum(n) over (order by part) - n as begins", "sum(m) over (order by part) - m as token_begins")
    starts = laid.join(F.broadcast(begins), "part").select("node", "owner", (F.col("begins") + F.col("inside")).alias("start"), (F.col("token_begins") + F.col("token_inside")).alias("token_start"), "n_tokens")
    placed = stored(steps.join(starts, "node"), "chat-placed")
    nodes = _sorted_by_turn(placed, "depth").mapInArrow(freeing(_stream(NODES, _ancestors)), NODES)
    nodes = nodes.join(owners.select("node", "loss_from", "loss_to", "turn", "ids"), "node")
    nodes.repartitionByRange(parts, "start").sortWithinPartitions("start").write.parquet(f"{path}/nodes")
    placed.select("conv", "depth", "start").write.parquet(f"{path}/paths")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold: one row a conversation, put together from its path's nodes.

    conv_id, n_turns, turns_sha256 (of role, line break, text, line break for each
    turn), loss_chars and loss_sha256 (of the text under the loss mask), formatted_chars.
    """
    nodes = spark.read.parquet(f"{path}/nodes").select("start", "turn", "loss_from", "loss_to")
    paths = spark.read.parquet(f"{path}/paths")
    return _sorted_by_turn(paths.join(nodes, "start"), "depth").mapInArrow(freeing(_stream(READ, _read)), READ)
