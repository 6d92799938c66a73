"""Chat formatting: schema fingerprints select declarative mappings.

A layout is identified by a fingerprint: the hash of its sorted nested field
paths (arrays add ``[]``). ``MAPPINGS`` lists, for each known layout, where the
conversation id and the turns are found; the mapping is compiled to Column
expressions that give canonical rows ``conv_id, turn, role, text``. Tables are
fingerprinted by their schema; JSON records one by one, so that one input may
mix layouts.

The template writes a turn as ``<turn ROLE>TEXT</turn>\\n`` after replacing
``&`` and ``<`` by ``&amp;`` and ``&lt;`` (and ``>`` in roles by ``&gt;``).
Markers are the only place where ``<`` survives, so no text can imitate one
and the escape is undone exactly. The loss mask covers the text of assistant
turns.

A formatted conversation is a run of segments, one a turn, ordered by
``(conv_id, seq)`` inside one partition; readers stream over them, so a very
long conversation never has to fit into one row or one task's memory.

Edge cases: null text is empty, a null role is the empty role, null ``conv_id``
rows form one conversation, a null ``turn`` sorts first, ties in ``turn`` sort
by role and text, repeated rows are repeated turns; texts of any length are one
segment; an empty table gives no rows. A table's further columns are left out by
``select``. A JSON record's further keys are ignored where no other mapping knows
them, a missing conversation id is null, and a record with an empty or null list of
messages gives no turns; any other unknown fingerprint is an error naming the record.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionframe.llm.shared import ARROW, small_batches

ASSISTANT = "assistant"


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def record_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of one JSON value; empty lists and objects name themselves."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {f"{at}[]" if isinstance(value, list) else at}


def fingerprint(paths: object) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    paths: the layout's field paths. rows: one row is one turn, with the
    columns named by ``turn``, ``role`` and ``text``. messages: an array of
    structs with fields ``role`` and ``text``. fixed: (role, field) pairs that
    are turns in this order; a null field is no turn.
    """

    name: str
    paths: tuple[str, ...]
    schema: str
    conv_id: str = "conv_id"
    rows: tuple[str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def print(self) -> str:
        return fingerprint(self.paths)

    def conversation(self, at: Callable[[str], Column]) -> Column:
        """The conversation's id; ``at`` gives the column of a field."""
        return at(self.conv_id).cast("long").alias("conv_id")

    def turns(self, at: Callable[[str], Column]) -> Column:
        """The row's turns as an array of ``turn, role, text``."""
        if self.rows:
            turn, who, text = self.rows
            return F.array(self._turn(at(turn), self._role(at(who)), at(text)))
        if self.messages:
            field, who, text = self.messages
            return F.transform(at(field), lambda m, k: self._turn(k, self._role(m[who]), m[text]))
        return F.filter(F.array(*[self._turn(F.lit(k), F.lit(who), at(field)) for k, (who, field) in enumerate(self.fixed)]), lambda t: t["text"].isNotNull())

    def of_record(self, record: Column) -> Column:
        """``conv_id`` and ``turns`` of a JSON record of this layout."""

        def told(r: Column) -> Column:
            return F.struct(self.conversation(r.getField), self.turns(r.getField).alias("turns"))

        # a one-element array names the parsed record, so that it is parsed once
        return F.transform(F.array(F.from_json(record, self.schema)), told)[0]

    @staticmethod
    def _turn(turn: Column, role: Column, text: Column) -> Column:
        return F.struct(turn.cast("long").alias("turn"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    def canonical(self, df: DataFrame) -> DataFrame:
        """Canonical rows of a table of this layout."""
        if self.rows:
            turn, who, text = self.rows
            return df.select(self.conversation(F.col), F.col(turn).cast("long").alias("turn"), self._role(F.col(who)).alias("role"), F.col(text).cast("string").alias("text"))
        return df.select(self.conversation(F.col), F.inline(self.turns(F.col)))

    def _role(self, col: Column) -> Column:
        for was, is_ in self.roles:
            col = F.when(col == was, F.lit(is_)).otherwise(col)
        return col.cast("string")


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), "conv_id long, turn long, role string, text string", rows=("turn", "role", "text")),
    Mapping("messages", ("conv_id", "messages[].role", "messages[].content"), "conv_id long, messages array<struct<role:string,content:string>>", messages=("messages", "role", "content")),
    Mapping("conversations", ("id", "conversations[].from", "conversations[].value"), "id long, conversations array<struct<`from`:string,value:string>>", conv_id="id", messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", ("id", "instruction", "output"), "id long, instruction string, output string", conv_id="id", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("id", "instruction", "input", "output"), "id long, instruction string, input string, output string", conv_id="id", fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", ("id", "prompt", "completion"), "id long, prompt string, completion string", conv_id="id", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system prompt", ("id", "system", "prompt", "response"), "id long, system string, prompt string, response string", conv_id="id", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
BY_PRINT = {m.print: m for m in MAPPINGS}
KNOWN_PATHS = {p for m in MAPPINGS for p in m.paths}
#: What the path of an empty or null list of messages stands for.
LISTS = {name: [p for p in m.paths if p.startswith(f"{m.messages[0]}[]")] for m in MAPPINGS if m.messages for name in (m.messages[0], f"{m.messages[0]}[]")}


def layout_print(paths: set[str]) -> str:
    """The fingerprint of the known layout that a record's paths fit, else their own.

    The exact path set comes first. Otherwise paths that no mapping knows are left out,
    an empty or null list of messages counts as one of the usual form, and the
    conversation id may be missing.
    """
    own = fingerprint(paths)
    if own in BY_PRINT:
        return own
    told = {q for p in paths for q in LISTS.get(p, (p,)) if q in KNOWN_PATHS}
    tried = (fingerprint({*told, *extra}) for extra in ((), ("id",), ("conv_id",)))
    return next((p for p in tried if p in BY_PRINT), own)


def canonical_table(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose schema has a known fingerprint."""
    paths = schema_paths(df.schema)
    found = BY_PRINT.get(fingerprint(paths))
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    return found.canonical(df)


def canonical_json(records: DataFrame, col: str = "record") -> DataFrame:
    """Canonical turns of JSON records that may mix layouts; ``col`` holds the JSON.

    Records with an unknown fingerprint (also null or broken JSON) raise.
    """

    @F.pandas_udf("string")
    def print_of(values: pd.Series) -> pd.Series:
        def one(text: object) -> str:
            try:
                return layout_print(record_paths(json.loads(text)))
            except (TypeError, ValueError):
                return "broken"

        return values.map(one)

    marked = records.select(F.col(col).alias("record"), print_of(col).alias("print"))
    unknown = F.raise_error(F.concat(F.lit("no mapping for the record layout of "), F.substring(F.coalesce("record", F.lit("null")), 1, 200)))
    made = unknown.cast("struct<conv_id:bigint,turns:array<struct<turn:bigint,role:string,text:string>>>")
    for p, m in BY_PRINT.items():
        made = F.when(F.col("print") == p, m.of_record(F.col("record"))).otherwise(made)
    return marked.select(made.alias("r")).select("r.conv_id", F.inline("r.turns"))


def escaped(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: str) -> str:
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def format_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Segments of the formatted conversations.

    Returns ``conv_id, turn, segment, loss_start, loss_end``: code points of the
    segment under the loss mask are ``[loss_start, loss_end)`` (equal where the
    turn is not the assistant's). Rows of a conversation lie in one partition,
    in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ordered = turns.select("conv_id", "turn", "role", "text")
    ordered = ordered.repartition(partitions, "conv_id") if partitions else ordered.repartition("conv_id")
    head = F.concat(F.lit("<turn "), F.replace(escaped(role), F.lit(">"), F.lit("&gt;")), F.lit(">"))
    made = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "turn", (role == ASSISTANT).alias("learn"), head.alias("head"), escaped(text).alias("body"))
    return made.select(
        "conv_id", "turn", F.concat("head", "body", F.lit("</turn>\n")).alias("segment"),
        F.length("head").alias("loss_start"),
        (F.length("head") + F.when(F.col("learn"), F.length("body")).otherwise(0)).alias("loss_end"))


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    head, _, rest = segment.partition(">")
    if not head.startswith("<turn ") or not rest.endswith("</turn>\n"):
        raise ValueError(f"not a turn: {segment[:80]!r}")
    return unescaped(head[len("<turn "):]), unescaped(rest[: -len("</turn>\n")])


READ_BACK = {"conv_id": "long", "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, parsed from the formatted segments as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = None
        turns = loss = None
        n = loss_chars = chars = 0

        def row() -> list:
            return [at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns is None or conv != at:
                    if turns is not None:
                        done.append(row())
                    at, turns, loss, n, loss_chars, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, text = parsed(segment)
                turns.update(f"{role}\n{text}\n".encode())
                learnt = unescaped(segment[start:end])
                loss.update(learnt.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(learnt), chars + len(segment)
            yield _frame(done)
        if turns is not None:
            yield _frame([row()])

    def _frame(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(READ_BACK)
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, READ_BACK.values(), strict=True)], names=list(READ_BACK))

    small_batches(segments.sparkSession)
    return segments.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in READ_BACK.items()))


#: A conversation of control strings that every formatting query carries along.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def probe(spark: SparkSession) -> DataFrame:
    record = json.dumps({"conv_id": PROBE_ID, "messages": [{"role": r, "content": PROBE_TEXT} for r in ("user", ASSISTANT)]})
    return canonical_json(spark.createDataFrame([(record,)], "record string"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Formats turn rows plus the probe and reads the result back."""
    turns = canonical_table(conversations.select("conv_id", "turn", "role", "text"))
    return read_back(format_turns(turns.unionByName(probe(conversations.sparkSession))))
