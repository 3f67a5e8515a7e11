"""Chat formatting: heterogeneous layouts to canonical turns to marked text.

A layout is recognised by *fingerprints*: hashes of sorted nested field paths
(array elements are ``[]``).  Of a schema's paths those that a mapping speaks of
are hashed, and if that is a fingerprint registered for the mapping, it says
where roles and texts are.  The mapping with the most paths comes first, of
equal ones the one listed first, so foreign columns don't matter, even if they
have names that other mappings use.  A layout is looked up once, not row by row.

Canonical turns are formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside texts and roles are escaped: every ``<`` with any
number of backslashes and a ``|`` after it gets one backslash more, so no
text can hold ``<|``, and taking one away restores it exactly.  In roles,
backslashes and line ends are escaped too.

The formatted output has a row per turn (``conv_id``, ``seq``, ``piece``, and
the span of the piece under the loss mask, in code points; null: none), whose
pieces joined in order of ``seq`` are the conversation.  A conversation is
streamed in order within one partition, never collected, however long.

Null texts and roles are empty; rows without a conversation id form one of
their own; turns of equal number follow each other by role, then text, and
repeated rows stay.  Very long texts are formatted whole.  An empty array of
turns has no element paths, so JSON values with one are of no known layout.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``each``: path of an array whose elements have ``role`` and ``text``; or
    ``fixed``: (role, path) of single fields, in order; or ``rows``: a row is
    a turn, with columns (conversation, turn, role, text).  ``paths`` are the
    layout's own, of which the last ``optional`` may be missing.
    """

    name: str
    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
    optional: int = 0


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages", "messages.[]", "messages.[].role", "messages.[].content"), each="messages", role="role", text="content"),
    Mapping("conversations", ("conversations", "conversations.[]", "conversations.[].from", "conversations.[].value"), each="conversations", role="from", text="value"),
    Mapping("turns", ("turns", "turns.[]", "turns.[].speaker", "turns.[].text"), each="turns", role="speaker", text="text"),
    Mapping("prompt", ("prompt", "response", "system"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=1),
    Mapping("completion", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output", "input"), fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=1),
    Mapping("question", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    """Hash of nested paths, in order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8")).hexdigest()[:16]


def _registry() -> dict[str, Mapping]:
    out = {}
    for m in MAPPINGS:
        for k in range(m.optional + 1):
            out[fingerprint(set(m.paths[: len(m.paths) - k]))] = m
    return out


REGISTRY = _registry()


@lru_cache(maxsize=10_000)
def layout_of(paths: frozenset[str]) -> tuple[str, Mapping | None]:
    """The fingerprint that selects a mapping, and the mapping; of unknown layouts that of all paths."""
    for m in sorted(MAPPINGS, key=lambda m: m.optional - len(m.paths)):
        sign = fingerprint(paths & set(m.paths))
        if REGISTRY.get(sign) is m:
            return sign, m
    return fingerprint(paths), None


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type."""
    out: set[str] = set()
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            p = f"{at}.{f.name}" if at else f.name
            out |= {p} | schema_paths(f.dataType, p)
    elif isinstance(kind, T.ArrayType):
        out |= {f"{at}.[]"} | schema_paths(kind.elementType, f"{at}.[]")
    return out


def value_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            p = f"{at}.{k}" if at else k
            out |= {p} | value_paths(v, p)
    elif isinstance(value, list):
        for v in value:
            out |= {f"{at}.[]"} | value_paths(v, f"{at}.[]")
    return out


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)


def turns_of(value: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of a JSON value's turns."""
    roles = dict(mapping.roles)
    if mapping.each:
        got = [(_text(x.get(mapping.role)), _text(x.get(mapping.text))) for x in value.get(mapping.each) or [] if isinstance(x, dict)]
    else:
        got = [(r, _text(value[p])) for r, p in mapping.fixed if value.get(p) not in (None, "")]
    return [(roles.get(r, r), t) for r, t in got]


def canonical_json(df: DataFrame, column: str, key: str) -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of a column of JSON texts, each by its own layout.

    Unknown layouts and broken JSON have a null ``layout`` and null ``turns``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                sign, m = layout_of(frozenset(value_paths(value))) if isinstance(value, dict) else (None, None)
                known = m is not None and not m.rows
                turns = [{"role": r, "text": t} for r, t in turns_of(value, m)] if known else None
                out.append((k, sign, m.name if known else None, turns))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], names=["conv_id", "fingerprint", "layout", "turns"])

    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField("conv_id", df.schema[key].dataType), T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", T.ArrayType(turn))])
    return df.select(key, column).mapInArrow(run, schema)


def canonical_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose own schema is a known layout."""
    _, m = layout_of(frozenset(schema_paths(df.schema)))
    if m is None:
        raise ValueError(f"unknown layout: {sorted(schema_paths(df.schema))}")
    if m.rows:
        cols = [F.col(c) for c in m.rows]
    else:
        keyed = df.withColumn("_id", F.monotonically_increasing_id()) if "conv_id" not in df.columns else df.withColumn("_id", F.col("conv_id"))
        if m.each:
            exploded = keyed.select("_id", F.posexplode(m.each).alias("_turn", "_x"))
            role = F.col(f"_x.{m.role}")
            for a, b in m.roles:
                role = F.when(F.col(f"_x.{m.role}") == a, b).otherwise(role)
            return exploded.select(F.col("_id").alias("conv_id"), F.col("_turn").cast("long").alias("turn"), role.alias("role"), F.col(f"_x.{m.text}").cast("string").alias("text"))
        parts = [F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for k, (r, p) in enumerate(m.fixed) if p in df.columns]
        got = keyed.select("_id", F.explode(F.array(*parts)).alias("_x")).where("coalesce(_x.text, '') <> ''")
        return got.select(F.col("_id").alias("conv_id"), "_x.turn", "_x.role", "_x.text")
    return df.select(*[c.alias(n) for c, n in zip(cols, ("conv_id", "turn", "role", "text"))])


_PIECES = "conv_id long, seq long, piece string, loss_start int, loss_end int"


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, piece, loss_start, loss_end): the formatted output, a row per turn."""
    n = shuffle_partitions(turns.sparkSession)
    ordered = (
        turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition(n, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = object(), 0
        for batch in batches:
            out = []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if c != now:
                    now, seq = c, 0
                head = f"{START}{_escape_role(role)}\n"
                body = escape(text)
                span = (len(head), len(head) + len(body)) if role == TRAINED else (None, None)
                out.append((c, seq, f"{head}{body}{END}", *span))
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())], names=["conv_id", "seq", "piece", "loss_start", "loss_end"])

    return ordered.select("conv_id", "role", "text").mapInArrow(run, _PIECES)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not piece.startswith(START) or not piece.endswith(END):
        raise ValueError("not a formatted turn")
    role, text = piece[len(START) : -len(END)].split("\n", 1)
    return _unescape_role(role), unescape(text)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output alone."""
    n = shuffle_partitions(formatted.sparkSession)
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = object(), None
        out: list[tuple] = []

        def close() -> None:
            if own is not None:
                out.append((now, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))

        def give() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for c, piece, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if c != now:
                    close()
                    now, own = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(piece)
                own[0] += 1
                own[1].update(f"{role}\n{text}\n".encode("utf-8"))
                own[4] += len(piece)
                if a is not None:
                    loss = unescape(piece[a:b])
                    own[2] += len(loss)
                    own[3].update(loss.encode("utf-8"))
            if len(out) > 10_000:
                yield give()
        close()
        yield give()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
