"""Chat formatting over a prefix tree: conversations that share their first turns share the tokens of those turns.

A pack is one training sequence: the turns of its conversations as a tree, each written once, depth-first. Tokens are
code points. Each node has its interval in the pack, the position of its first token (as if only its ancestors stood
before it) and the intervals of its ancestors, which are all that it may attend to besides itself.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Code points, and conversations, after which a pack is closed; a single conversation is never cut.
PACK_CHARS, PACK_CONVERSATIONS = 1 << 18, 2048
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)<\|im_end\|>\n", re.DOTALL)
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODE = pa.struct(
    [("parent", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("ancestors", pa.list_(SPAN))]
)
PACK = pa.schema([("text", pa.string()), ("nodes", pa.list_(NODE)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])
PACK_DDL = (
    "text string, nodes array<struct<parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,ancestors:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:bigint,leaf:int>>"
)


def escape(text: str) -> str:
    """No control string is left in the result, and unescape() gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def joined(spans: list[dict], start: int, end: int) -> list[dict]:
    """spans and one more behind them; spans that touch are one, so a conversation without branches has one however long."""
    if spans and spans[-1]["end"] == start:
        return [*spans[:-1], {"start": spans[-1]["start"], "end": end}]
    return [*spans, {"start": start, "end": end}]


class Pack:
    def __init__(self):
        self.text: list[str] = []
        self.length = 0
        self.nodes: list[dict] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[str, str, int]] = []  # role, text and node of each turn of the last conversation

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        for (role, text, _), turn in zip(self.path, turns, strict=False):
            if (role, text) != turn:
                break
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            parent = self.path[-1][2] if self.path else -1
            above = self.nodes[parent] if self.path else None
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            start, inner = self.length, self.length + len(head)
            self.length = inner + len(body) + len(END)
            self.text += (head, body, END)
            self.nodes.append(
                {
                    "parent": parent,
                    "start": start,
                    "end": self.length,
                    "position": above["position"] + above["end"] - above["start"] if above else 0,
                    "loss_start": inner,
                    "loss_end": inner + len(body) if role == "assistant" else inner,
                    "ancestors": joined(above["ancestors"], above["start"], above["end"]) if above else [],
                }
            )
            self.path.append((role, text, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][2]})

    def full(self) -> bool:
        return self.length >= PACK_CHARS or len(self.conversations) >= PACK_CONVERSATIONS

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.text), "nodes": self.nodes, "conversations": self.conversations}], PACK)


def chat_packs(conversations: DataFrame) -> DataFrame:
    """(text, nodes, conversations), a row for each pack, from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text (repeated rows stay). Conversations are sorted by the hashes of their
    turns, which is depth-first order, and dealt out by ranges of it with conv_id last, so that neither a very common
    first turn nor a very common conversation meets in one task; a tree that spans two packs repeats only the path
    where it was cut. Turns are shared where role and text are equal, not merely their hashes. A conversation is one
    sequence and is held whole. Null role and text count as empty, each row with a null conv_id is a conversation of its
    own, an empty table gives no packs; other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # rows of no conversation never meet in one task
    whole = turns.withColumn("alone", alone).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    ordered = whole.withColumn("path", path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def pack(batches):
        now = Pack()
        for batch in batches:
            for row in batch.to_pylist():
                now.add(row["conv_id"], [(t["role"], t["text"]) for t in row["turns"]])
                if now.full():
                    yield now.batch()
                    now = Pack()
        if now.conversations:
            yield now.batch()

    return ordered.select("conv_id", "turns").mapInArrow(pack, PACK_DDL)


def conversations_of(row: dict):
    """(conv_id, turns as (role, text), text under the loss mask, formatted length) of each conversation of a pack row,
    from its text and intervals alone."""
    text, nodes = row["text"], row["nodes"]
    for c in row["conversations"]:
        path, at = [], c["leaf"]
        while at >= 0:
            path.append(nodes[at])
            at = nodes[at]["parent"]
        turns, loss, length = [], [], 0
        for node in reversed(path):
            found = TURN.fullmatch(text[node["start"] : node["end"]])
            if not found or node["position"] != length:
                raise ValueError(f"conversation {c['conv_id']} cannot be read back")
            turns.append((unescape(found[1]), unescape(found[2])))
            loss.append(unescape(text[node["loss_start"] : node["loss_end"]]))
            length += node["end"] - node["start"]
        yield c["conv_id"], turns, "".join(loss), length


def read_back(packs: DataFrame) -> DataFrame:
    """Digests of every conversation as the packs have it: what it says, what it is trained on, how long it is."""

    def read(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for batch in batches:
            for k in range(batch.num_rows):
                out = [
                    {"conv_id": i, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": n}
                    for i, turns, loss, n in conversations_of(batch.slice(k, 1).to_pylist()[0])
                ]
                yield pa.RecordBatch.from_pylist(out, kind)

    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return packs.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
