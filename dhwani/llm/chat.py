"""Chat formatting into packed prefix trees.

Conversations that share initial turns share those turns' tokens. Conversations are sorted by their
path of turns and cut into packs; a pack's tree is written depth-first, every shared turn once. A node
has its span in the pack's text, the position id of its first token, the span under the loss mask, and
the intervals its tokens attend to (its ancestors, adjacent ones joined, then itself causally). A token
is a code point. One first turn shared by any number of conversations is split over packs, each of
which writes it once; packs are bounded by conversations and by size.

Template: ``[INST] x [/INST]`` for user, ``<s> x </s>`` for assistant, ``<<SYS>> x <</SYS>>`` for system,
``[ROLE] r [/ROLE][TURN] x [/TURN]`` for others. A backslash escapes itself and every control string
inside texts and roles, so the output reads back exactly.

Defined results. Null role or text: empty. Rows of a conversation are ordered by turn (nulls first),
ties by role, then text; repeated rows are turns of their own. Rows with a null conversation id form one
conversation. Extra columns are ignored. Empty table: empty result. A conversation is one row in
memory, as any sample is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import bound_batches

#: Fixed values of the template: opening and closing control strings by role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TURN = ("[ROLE]", "[/ROLE]"), ("[TURN]", "[/TURN]")
CONTROLS = [mark for pair in (*MARKS.values(), ROLE, TURN) for mark in pair]
_ESCAPED = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_PAIR = re.compile(r"\\(.)", re.S)
_TOKEN = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROLS)), re.S)
PACK_CONVERSATIONS = 256
PACK_CHARS = 1 << 20

PACK_SCHEMA = (
    "text string, nodes array<struct<start:long,stop:long,position:long,parent:long,loss_start:long,loss_stop:long,"
    "attends:array<struct<start:long,stop:long>>>>, leaves array<struct<conv_id:long,node:long>>"
)
_PACK_ARROW = pa.schema([
    ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([*((n, pa.int64()) for n in ("start", "stop", "position", "parent", "loss_start", "loss_stop")), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))),
    ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int64())]))),
])


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and the span of its text in it."""
    if role in MARKS:
        head, tail = MARKS[role][0] + " ", " " + MARKS[role][1]
    else:
        head, tail = f"{ROLE[0]} {escape(role)} {ROLE[1]}{TURN[0]} ", f" {TURN[1]}"
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    opens = {a: (role, b) for role, (a, b) in MARKS.items()} | {ROLE[0]: (None, ROLE[1]), TURN[0]: ("", TURN[1])}
    turns, other = [], ""
    role, close, at = None, None, 0
    for m in _TOKEN.finditer(text):
        mark = m.group()
        if mark[0] == "\\":
            continue
        if close is None:
            role, close = opens[mark]
            at = m.end() + 1
        elif mark == close:
            body = unescape(text[at : m.start() - 1])
            if role is None:
                other = body
            else:
                turns.append((other if close == TURN[1] else role, body))
            close = None
        else:
            raise ValueError(f"{mark} inside a turn")
    return turns


class Pack:
    """A prefix tree under construction; conversations arrive sorted by path."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            parent = self.path[-1][1] if self.path else -1
            text, a, b = formatted(*turn)
            up = self.nodes[parent] if parent >= 0 else None
            start, stop = self.size, self.size + len(text)
            attends = [dict(x) for x in up["attends"]] if up else []
            if attends and attends[-1]["stop"] == start:
                attends[-1]["stop"] = stop
            else:
                attends.append({"start": start, "stop": stop})
            loss = turn[0] == "assistant"
            self.nodes.append({
                "start": start, "stop": stop, "position": up["position"] + up["stop"] - up["start"] if up else 0, "parent": parent,
                "loss_start": start + a if loss else start, "loss_stop": start + b if loss else start, "attends": attends})
            self.parts.append(text)
            self.size = stop
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves}], _PACK_ARROW)


def packs(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_conversations: int | None = None, pack_chars: int | None = None) -> DataFrame:
    """Packed prefix trees: one row per pack, see ``PACK_SCHEMA``.

    A pack ends at ``pack_conversations`` conversations (by default ``PACK_CONVERSATIONS``) or at ``pack_chars`` characters (``PACK_CHARS``).
    """
    bound_batches(rows.sparkSession)
    most, size = pack_conversations or PACK_CONVERSATIONS, pack_chars or PACK_CHARS
    rows = rows.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t.role, t.text))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"), path.alias("path"))
    whole = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()
        for batch in batches:
            turns = batch.column("turns")
            for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                pack.add(conv_id, [(t["role"], t["text"]) for t in turns[i].as_py()])
                if len(pack.leaves) >= most or pack.size >= size:
                    yield pack.row()
                    pack = Pack()
        if pack.leaves:
            yield pack.row()

    return whole.mapInArrow(run, PACK_SCHEMA)


def read_back(packed: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the packs by the leaves' attention intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out = []
            for pack in batch.to_pylist():
                text, nodes = pack["text"], pack["nodes"]
                for leaf in pack["leaves"]:
                    node = nodes[leaf["node"]]
                    whole = "".join(text[x["start"] : x["stop"]] for x in node["attends"])
                    chain = []
                    at = leaf["node"]
                    while at >= 0:
                        chain.append(text[nodes[at]["loss_start"] : nodes[at]["loss_stop"]])
                        at = nodes[at]["parent"]
                    loss = "".join(map(unescape, reversed(chain)))
                    turns = parse(whole)
                    out.append({
                        "conv_id": leaf["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)),
                        "loss_chars": len(loss), "loss_sha256": sha(loss), "formatted_chars": node["position"] + node["stop"] - node["start"]})
            schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return packed.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"
_CONV = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'"
_ESC = "regexp_replace({}, '(\\\\|\\[/?INST\\]|</?s>|<</?SYS>>|\\[/?ROLE\\]|\\[/?TURN\\])', '\\\\\\1', 'g')"
ORACLE = f"""
WITH c AS ({_CONV}), e AS (SELECT *, length({_ESC.format("text")}) AS tl, length({_ESC.format("role")}) AS rl FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(tl + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 30 + rl END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
