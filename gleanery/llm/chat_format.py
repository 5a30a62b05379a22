"""Chat formatting with layouts chosen by schema fingerprint.

The nested field paths of a record, as far as any mapping knows them, are hashed; the hash selects a declarative
mapping, which says where the turns of such records are. Turns in one form are then written by a template that marks
them and escapes, reversibly, whatever in a text could be taken for a mark.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: What is escaped in roles and texts: the openings of marks, control strings of other templates, and the escape itself.
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    r"""A backslash is doubled, and one is put after the first character of a control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout are. Either ``turns``, the path of an array whose elements have the fields ``role``
    and ``text``; or ``parts``: (role, paths), each a turn that joins the texts at the paths by a blank line, left out
    if it has none; or ``row``: fields of a record that is one turn itself, (role, text)."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str] = ("", "")

    def paths(self) -> list[str]:
        if self.turns:
            return [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [*self.row] if self.row[0] else [p for _, paths in self.parts for p in paths]


#: Names of roles in the layouts, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("turn rows", row=("role", "text")),
    Mapping("message list", turns="messages", role="role", text="content"),
    Mapping("speaker list", turns="conversations", role="from", text="value"),
    Mapping("prompt and completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system, instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def fingerprint(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> str:
    """SHA-256 of the paths that any of the mappings knows, sorted: further fields change nothing."""
    known = {p for m in mappings for p in m.paths()}
    return hashlib.sha256("\n".join(sorted(paths & known)).encode()).hexdigest()


def by_fingerprint(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(set(m.paths()), mappings): m for m in mappings}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of the leaves of a schema: fields joined by dots, [] for the elements of an array."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else {at}


def value_paths(value: object, at: str = "") -> set[str]:
    """schema_paths() of one JSON value; what is null has none."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    return {p for v in value for p in value_paths(v, f"{at}[]")} if isinstance(value, list) else set() if value is None else {at}


def _joined(content: object) -> object:
    """Content that is a list of parts, strings or objects with a text, as one text."""
    if not isinstance(content, list):
        return content
    return "\n".join(p if isinstance(p, str) else p["text"] for p in content if isinstance(p, str) or isinstance(p, dict) and isinstance(p.get("text"), str))


def _layout(record: dict, chosen: dict[str, Mapping], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping of a record by its fingerprint: with null fields as fields, or else without them. An empty list of
    turns is told by its name alone."""
    for m in mappings:
        turns = record.get(m.turns) if m.turns else None
        if turns == []:
            return m
        for t in turns if isinstance(turns, list) else ():
            if isinstance(t, dict) and isinstance(t.get(m.text), list):
                t[m.text] = _joined(t[m.text])
    filled = {k: "" if v is None else v for k, v in record.items()}
    return chosen.get(fingerprint(value_paths(filled), mappings)) or chosen.get(fingerprint(value_paths(record), mappings))


def _turns_of(record: dict, m: Mapping) -> list[tuple[str, str]]:
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if m.turns:
        return [(said(t.get(m.role)), said(t.get(m.text))) for t in record[m.turns] if isinstance(t, dict)]
    if m.row[0]:
        return [(said(record[m.row[0]]), said(record[m.row[1]]))]
    joined = [(role, "\n\n".join(x for x in (said(record.get(p)) for p in paths) if x)) for role, paths in m.parts]
    return [(role, text) for role, text in joined if text]


def turns_from_json(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records (conv_id, record), each by its own fingerprint.

    A record that is null, is no JSON object or has no known layout gives one row with a null turn and the layout
    ``unknown``; one whose list of turns is empty gives none. A null field counts as one without a text, or as none if
    only then the layout is known. Content that is a list of parts is their texts, by lines. Roles get their canonical
    names.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chosen = by_fingerprint(mappings)
        for frame in frames:
            out = []
            for conv_id, text in zip(frame["conv_id"], frame["record"], strict=True):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError):
                    record = None
                m = _layout(record, chosen, mappings) if isinstance(record, dict) else None
                if m is None:
                    out.append((conv_id, None, None, None, "unknown"))
                else:
                    out += [(conv_id, i, ROLES.get(role, role), text, m.name) for i, (role, text) in enumerate(_turns_of(record, m))]
            frame = pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "layout"])
            yield frame.astype({"turn": "Int64"})

    kind = records.schema["conv_id"].dataType.simpleString()
    return records.select("conv_id", "record").mapInPandas(task, f"conv_id {kind}, turn long, role string, text string, layout string")


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text) of records whose fields are columns, by the fingerprint of the table's schema.

    Rows that are turns need a column ``turn`` and keep their roles; in other layouts turns are numbered from 0 and
    roles get their canonical names. A null role or text is empty. Unknown layouts raise ValueError, with the paths that were found.
    """
    found = schema_paths(records.schema)
    m = by_fingerprint(mappings).get(fingerprint(found, mappings))
    if m is None:
        raise ValueError(f"no mapping for {sorted(found)}")
    canonical = F.coalesce(*[F.when(F.col("role") == a, F.lit(b)) for a, b in ROLES.items()], "role", F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if m.row[0]:
        rows = records.select("conv_id", F.col("turn").cast("long").alias("turn"), text(m.row[0]).alias("role"), text(m.row[1]).alias("text"))
        return rows  # their roles stay as they are
    elif m.turns:
        rows = records.select("conv_id", F.posexplode(m.turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.col(f"t.{m.role}").alias("role"), text(f"t.{m.text}").alias("text"))
    else:
        said = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[text(p) for p in paths]), lambda x: x != ""), "\n\n").alias("text")) for role, paths in m.parts]
        rows = records.select("conv_id", F.posexplode(F.filter(F.array(*said), lambda t: t["text"] != "")).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    return rows.withColumn("role", canonical)


def escaped(text: Column) -> Column:
    """escape() of a column."""
    opening = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), opening, r"$1\\")


def as_layouts(turns: DataFrame) -> DataFrame:
    """(conv_id, record): conversations (conv_id, turn, role, text) as JSON records in the layouts of message lists and
    speaker lists, by the parity of a hash, with further fields that are null: what exchanges of data bring."""
    said = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = turns.groupBy("conv_id").agg(said.alias("said"))
    back = F.create_map(*[F.lit(x) for x in ("user", "human", "assistant", "gpt")])
    messages = F.to_json(F.struct(F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"), F.lit(None).cast("string").alias("completion")), {"ignoreNullFields": "false"})
    speakers = F.to_json(F.struct(F.transform("said", lambda t: F.struct(F.coalesce(back[t["role"]], t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))
    return whole.select("conv_id", F.when(F.xxhash64("conv_id") % 2 == 0, messages).otherwise(speakers).alias("record"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of turns (conv_id, turn, role, text), in the order of turn, role and text.

    formatted: TURN role SAYS text END for each turn, role and text escaped. loss_mask: (start, end) in characters of
    the escaped text of each turn of an assistant, in order. Turns are written one by one, in parallel; where each
    stands is a running sum over its conversation, which is joined from what is written. A null turn comes first, a
    null conv_id is a conversation, repeated rows are turns like others. An empty table gives no rows.
    """
    each = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = each.withColumn("line", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS), escaped(F.col("text")), F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("to", F.sum(F.char_length("line").cast("long")).over(before))
    body = F.char_length(escaped(F.col("text")))
    said = F.struct((F.col("to") - len(END) - body).cast("int").alias("start"), (F.col("to") - len(END)).cast("int").alias("end"))
    joined = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("to", "line"))).alias("lines"), F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", said))).alias("loss_mask"))
    return joined.select("conv_id", F.array_join(F.transform("lines", lambda t: t["line"]), "").alias("formatted"), "loss_mask")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted() has written, read from its text and mask: conv_id, n_turns, turns_sha256 (of role, newline,
    text, newline for each turn), loss_chars, loss_sha256 (of the text under the mask, unescaped), formatted_chars."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return conversations.mapInArrow(task, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
