"""Chat formatting: conversations that share initial turns become prefix trees, emitted depth-first into packs of tokens.

A turn reads `### role: text</turn>\n`, with `\\` before each `\\`, `#`, `<` (and `:` in a role), so no text can look like the template.
Header, text and end are encoded apart, so the loss mask ends on token bounds. A pack lists its tokens once; each turn is a
node with its place, the position of its first token on its own path, and the intervals of the pack that its tokens attend to
(those of its ancestors, besides the causal part of its own).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, table
from .token_files import byte_bpe

#: Tokens after which a pack is closed; the next conversation then starts another, with its shared turns again.
PACK_TOKENS = 1 << 17
ASSISTANT = "assistant"
END = "</turn>\n"

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def escape(text: str, also: str = "") -> str:
    return re.sub(rf"[\\#<{also}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def header(role: str) -> str:
    return f"### {escape(role, ':')}: "


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; an error if anything else is in between."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_GATHERED = T.StructType([T.StructField("conv_id", _LONG), T.StructField("path", _TEXT), T.StructField("roles", T.ArrayType(_TEXT)), T.StructField("texts", T.ArrayType(_TEXT))])
_INTERVAL = T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)])
_NODE = T.StructType([T.StructField("parent", _INT), T.StructField("start", _INT), T.StructField("text_start", _INT), T.StructField("text_end", _INT), T.StructField("end", _INT), T.StructField("position", _INT), T.StructField("loss", T.BooleanType()), T.StructField("attends", T.ArrayType(_INTERVAL))])
PACKS = T.StructType([
    T.StructField("pack", _TEXT),
    T.StructField("tokens", T.ArrayType(_INT)),
    T.StructField("positions", T.ArrayType(_INT)),
    T.StructField("nodes", T.ArrayType(_NODE)),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("conv_id", _LONG), T.StructField("node", _INT)]))),
])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn, to one row for each conversation; one conversation is held at a time."""
    schema = to_arrow_schema(_GATHERED)
    key, roles, texts, made, size, begun = None, [], [], [], 0, False

    def row():
        path = "".join(hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for r, t in zip(roles, texts, strict=True))
        return {"conv_id": key, "path": path, "roles": roles, "texts": texts}

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv != key:
                made.append(row())
                roles, texts = [], []
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)
                    made, size = [], 0
            key, begun = conv, True
            roles.append(role or "")
            texts.append(text or "")
            size += len(roles[-1]) + len(texts[-1]) + 64
    if begun:
        made.append(row())
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=schema)


class _Pack:
    def __init__(self):
        self.size, self.tokens, self.positions, self.nodes, self.conversations = 0, [], [], [], []
        self.stack: list[tuple[str, str, int]] = []  # the last conversation's turns and their nodes

    def add(self, conv, roles: list[str], texts: list[str], ids_of: dict[str, np.ndarray]) -> None:
        shared = 0
        while shared < min(len(roles), len(self.stack)) and self.stack[shared][:2] == (roles[shared], texts[shared]):
            shared += 1
        del self.stack[shared:]
        for role, text in zip(roles[shared:], texts[shared:], strict=True):
            parts = [ids_of[x] for x in (header(role), escape(text), END)]
            n = [len(p) for p in parts]
            parent = self.stack[-1][2] if self.stack else -1
            above = self.nodes[parent] if parent >= 0 else None
            position = above["position"] + above["end"] - above["start"] if above else 0
            start = self.size
            attends = []
            if above:
                attends = [dict(x) for x in above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = above["end"]
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            self.size += sum(n)
            self.nodes.append({"parent": parent, "start": start, "text_start": start + n[0], "text_end": start + n[0] + n[1], "end": self.size, "position": position, "loss": role == ASSISTANT, "attends": attends})
            self.tokens += parts
            self.positions.append(np.arange(position, position + sum(n), dtype=np.int32))
            self.stack.append((role, text, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv, "node": self.stack[-1][2] if self.stack else -1})

    def batch(self, name: str) -> pa.RecordBatch:
        lists = [pa.array([np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32)], pa.list_(pa.int32())) for x in (self.tokens, self.positions)]
        schema = to_arrow_schema(PACKS)
        rest = [pa.array([x], schema.field(f).type) for f, x in (("nodes", self.nodes), ("conversations", self.conversations))]
        return pa.RecordBatch.from_arrays([pa.array([name]), *lists, *rest], schema=schema)


def _packer(tokenizer: str, pack_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part, seq = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        pack = _Pack()
        for whole in batches:
            for batch in slices(whole, ["texts"]):
                convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "roles", "texts"))
                ids_of = _encoded(bpe, {END, *(header(r) for x in roles for r in x), *(escape(t) for x in texts for t in x)})
                for conv, said_by, said in zip(convs, roles, texts, strict=True):
                    pack.add(conv, said_by, said, ids_of)
                    if pack.size >= pack_tokens:
                        yield pack.batch(f"{part}-{seq}")
                        pack, seq = _Pack(), seq + 1
        if pack.conversations:
            yield pack.batch(f"{part}-{seq}")

    return run


def _encoded(bpe, distinct: set[str]) -> dict[str, np.ndarray]:
    """Ids of distinct texts, all encoded as one column."""
    names = list(distinct)
    ids, many = bpe.encode_column(pa.array([x.encode("utf-8", "surrogatepass") for x in names], pa.binary()))
    return dict(zip(names, np.split(ids, np.cumsum(many)[:-1]), strict=True))


def pack_conversations(turns: DataFrame, tokenizer: str, pack_tokens: int = PACK_TOKENS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Packs of depth-first token sequences, as PACKS; every conversation is in one pack.

    Turns go by turn (null first), equal turns by role and text; repeated rows are turns of their own. Null text or role:
    empty. Rows without conv_id are one conversation. A hot first turn is no hot task: conversations are ranged by their whole
    path and then by id, and a tree that spans packs repeats only its shared turns in each. One task holds a pack and one
    conversation. Only the four named columns are read. No rows: no packs.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    gathered = rows.mapInArrow(_gather, _GATHERED)
    ordered = gathered.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_packer(tokenizer, pack_tokens), PACKS)


READ = "conv_id long, formatted string, loss array<string>"


def read_packs(packs: DataFrame, tokenizer: str, digest=None, schema: str = READ) -> DataFrame:
    """Each conversation out of its pack: the decoded text on its path, and the decoded texts under the loss mask.

    With `digest(conv_id, formatted, loss)`, rows of `schema` instead.
    """
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = bpe.bytes_of[batch.column(1)[i].values.to_numpy()]
                nodes, conversations = batch.column(3)[i].values, batch.column(4)[i].values
                parent, start, text_start, text_end, end, loss = (nodes.field(f).to_pylist() for f in ("parent", "start", "text_start", "text_end", "end", "loss"))
                texts = [b"".join(tokens[a:b]).decode("utf-8", "replace") for a, b in zip(start, end, strict=True)]
                losses = [b"".join(tokens[a:b]).decode("utf-8", "replace") if x else None for a, b, x in zip(text_start, text_end, loss, strict=True)]
                rows = []
                for conv, at in zip(conversations.field("conv_id").to_pylist(), conversations.field("node").to_pylist(), strict=True):
                    path = []
                    while at >= 0:
                        path.append(at)
                        at = parent[at]
                    found = (conv, "".join(texts[k] for k in reversed(path)), [losses[k] for k in reversed(path) if losses[k] is not None])
                    rows.append(digest(*found) if digest else found)
                    if len(rows) >= 256:
                        yield _rows(rows, fields)
                        rows = []
                if rows:
                    yield _rows(rows, fields)

    return packs.select(*PACKS.names).mapInArrow(run, schema)


def _rows(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def digests(conv, formatted: str, loss: list[str]) -> tuple:
    turns = parse(formatted)
    learned = unescape("".join(loss))
    said = "".join(f"{role}\n{text}\n" for role, text in turns)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return conv, len(turns), sha(said), len(learned), sha(learned), len(formatted)


#: The contract's extra conversation.
EXTRA = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return read_packs(pack_conversations(turns, tokenizer), tokenizer, digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED = r"regexp_replace(coalesce(text, ''), '([\\#<])', '\\\1', 'g')"
_ROLE = r"regexp_replace(coalesce(role, ''), '([\\#<:])', '\\\1', 'g')"
ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ROLE}) + length({_ESCAPED}) + {len('### : </turn>') + 1})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
