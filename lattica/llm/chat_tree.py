"""Chat formatting over prefix trees.

A turn is formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``; backslashes and ``<|``
inside roles and texts are escaped with a backslash (a line break in a role too), so
no text can imitate a control string and every text can be read back.

Conversations that share initial turns share nodes of a prefix tree. They are sorted by
their path of chained turn hashes, which is depth-first order, and packed: within a
pack a shared turn's characters are emitted once; each node has its place in the pack,
the position id of its first character (as if its conversation stood alone), and the
intervals of the pack that its characters attend to besides themselves: those of its
ancestors. Units are characters; the loss mask covers the texts of assistant turns.

A pack holds at most ``pack_chars`` characters unless one conversation is longer. A tree
larger than that is continued in the next pack, with the path to the node repeated, so
a first turn shared by a third of all conversations never gathers in one task; equal
conversations are one leaf with a table of members.

Defined cases: null texts and roles are empty; turns are ordered by turn, role and text
(nulls first), so ties have one order; repeated rows are repeated turns; rows without a
conv_id are one conversation; an empty table gives no packs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


@dataclass(frozen=True)
class ChatParams:
    pack_chars: int = 1 << 16
    loss_role: str = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}"


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = segment[len(START) : -len(END)].partition("\n")
    return unescape_role(role), unescape(text)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, path, segments): each conversation's formatted turns and chained hashes."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, path, segments = [], [], []
            for own in batch.column(1).to_pylist():
                key, keys, texts = b"", [], []
                for t in own:
                    texts.append(format_turn(t["role"], t["text"]))
                    key = hashlib.blake2b(key + texts[-1].encode(), digest_size=16).digest()
                    keys.append(key)
                leaf.append(key)
                path.append(b"".join(keys))
                segments.append(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(leaf, pa.binary()), pa.array(path, pa.binary()), pa.array(segments, pa.list_(pa.string()))],
                names=["conv_id", "leaf", "path", "segments"],
            )

    return grouped.mapInArrow(run, f"conv_id {kind}, leaf binary, path binary, segments array<string>")


_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([
    ("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("role", pa.string()),
    ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(_INTERVAL)), ("leaf", pa.binary()),
])
_PACK = "tokens string, nodes array<struct<start: bigint, end: bigint, parent: int, position: bigint, role: string, loss_start: bigint, loss_end: bigint, attends: array<struct<start: bigint, end: bigint>>, leaf: binary>>"


class Packer:
    """Builds packs from conversations in path order."""

    def __init__(self, p: ChatParams) -> None:
        self.p = p
        self.clear()

    def clear(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.stack: list[tuple[bytes, int]] = []  # keys and nodes of the last path

    def flush(self) -> Iterator[dict]:
        if self.nodes:
            yield {"tokens": "".join(self.parts), "nodes": self.nodes}
        self.clear()

    def add(self, leaf: bytes, path: bytes, segments: list[str]) -> Iterator[dict]:
        keys = [path[i : i + 16] for i in range(0, len(path), 16)]
        shared = self._shared(keys)
        if self.nodes and self.size + sum(map(len, segments[shared:])) > self.p.pack_chars:
            yield from self.flush()
            shared = 0
        del self.stack[shared:]
        for key, text in zip(keys[shared:], segments[shared:], strict=True):
            self._emit(key, text)
        self.nodes[self.stack[-1][1]]["leaf"] = leaf

    def _shared(self, keys: list[bytes]) -> int:
        n = 0
        while n < min(len(keys), len(self.stack)) and keys[n] == self.stack[n][0]:
            n += 1
        return n

    def _emit(self, key: bytes, text: str) -> None:
        parent = self.stack[-1][1] if self.stack else -1
        above = self.nodes[parent] if self.stack else None
        attends = [dict(x) for x in above["attends"]] if above else []
        if above:
            if attends and attends[-1]["end"] == above["start"]:
                attends[-1]["end"] = above["end"]
            else:
                attends.append({"start": above["start"], "end": above["end"]})
        start, end = self.size, self.size + len(text)
        head = text.index("\n") + 1
        role = text[len(START) : head - 1]
        loss = unescape_role(role) == self.p.loss_role
        self.nodes.append({
            "start": start, "end": end, "parent": parent,
            "position": above["position"] + above["end"] - above["start"] if above else 0, "role": unescape_role(role),
            "loss_start": start + head if loss else end, "loss_end": end - len(END) if loss else end,
            "attends": attends, "leaf": None,
        })
        self.parts.append(text)
        self.size = end
        self.stack.append((key, len(self.nodes) - 1))


def pack(conversations: DataFrame, p: ChatParams = ChatParams()) -> DataFrame:
    """Packs (tokens, nodes) of the distinct conversations of :func:`paths`."""
    leaves = conversations.groupBy("leaf").agg(F.first(F.struct("path", "segments")).alias("r")).select("leaf", "r.path", "r.segments")
    ordered = leaves.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(p)
        for batch in batches:
            done: list[dict] = []
            for leaf, path, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done.extend(packer.add(leaf, path, segments))
            yield from _batch(done)
        yield from _batch(list(packer.flush()))

    return ordered.mapInArrow(run, _PACK)


def _batch(packs: list[dict]) -> Iterator[pa.RecordBatch]:
    if packs:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x["tokens"] for x in packs], pa.string()), pa.array([x["nodes"] for x in packs], pa.list_(_NODE))],
            names=["tokens", "nodes"],
        )


def conversations_of(tokens: str, nodes: list[dict]) -> Iterator[tuple[bytes, list[dict]]]:
    """The leaves of a pack with the nodes from their root."""
    for node in nodes:
        if node["leaf"] is not None:
            chain, at = [], node
            while True:
                chain.append(at)
                if at["parent"] < 0:
                    break
                at = nodes[at["parent"]]
            yield node["leaf"], chain[::-1]


def read_back(packs: DataFrame) -> DataFrame:
    """(leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as the packs hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for tokens, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for leaf, chain in conversations_of(tokens, nodes):
                    turns, loss, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0
                    for n in chain:
                        role, text = read_turn(tokens[n["start"] : n["end"]])
                        turns.update(f"{role}\n{text}\n".encode())
                        masked = unescape(tokens[n["loss_start"] : n["loss_end"]])
                        loss.update(masked.encode())
                        chars += len(masked)
                        size += n["end"] - n["start"]
                    rows.append((leaf, len(chain), turns.hexdigest(), chars, loss.hexdigest(), size))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return packs.mapInArrow(
        run, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, leaf): which leaf each conversation ends in."""
    return conversations.select("conv_id", "leaf")
