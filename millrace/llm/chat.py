r"""Conversations as one stream of text in which shared beginnings stand once.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``; inside texts and roles
every ``<``, backslashes, ``|`` gets one backslash more, so that no control string
is left in them, and loses it when read. The tokens of the stream are code
points; the conversations form a prefix tree of turns. Sorted by the hashes of
their turns they come depth first, so a conversation emits the turns it does not
share with the one before, and all of its shared turns have been emitted already.
What it emits is a run, with

- ``start``: its place in the stream, ``position``: that of its first code point
  in the conversation (each next one has one more), ``chars`` and ``text``;
- ``loss``: intervals in the run on which training counts, texts of assistants;
- ``ancestors``: the intervals of the stream that the run attends to besides its
  own earlier code points, each the beginning of an earlier run. Their lengths
  add up to ``position``.

Ranges of sorted conversations are laid out side by side as if each began the
stream. Two conversations of each range, its first and last, then tell what a
range shares with those before; only these reach the driver. A beginning that
any share of all conversations has in common is no larger a row for that. A
conversation itself is handled as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

# Fixed values.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
CLOSE = END + "\n"

# Hexadecimal digits of a turn's hash in a conversation's path, and bytes.
DIGITS = 32
WIDTH = DIGITS // 2

INTERVALS = "array<struct<start: long, stop: long>>"
Intervals = list[tuple[int, int]]


# --- Template --------------------------------------------------------------


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    """Also without line breaks, as the first one ends the role."""
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escaped(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def write_conversations(turns: DataFrame) -> DataFrame:
    """A row per ``conv_id``: its turns by number, written in the template.

    ``conv`` names it (also where the id is NULL), ``path`` has a hash per turn,
    ``chars`` the code points of each turn and ``heads`` those before the text of
    each turn on which training counts, -1 for others. Turns of the same number
    are ordered by role and text, those without one come first, repeated
    rows are turns of their own. NULL as role or text is an empty one.
    """
    said = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    written = F.transform(
        F.array_sort(F.collect_list(said)),
        lambda t: F.struct(
            F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"),
            F.concat(escaped(t["text"]), F.lit(CLOSE)).alias("rest"),
            (t["role"] == LEARNED).alias("learned"),
        ),
    )
    rows = turns.groupBy("conv_id").agg(written.alias("turns"))
    whole = F.transform("turns", lambda t: F.concat(t["head"], t["rest"]))
    hashes = F.transform(whole, lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, DIGITS))
    return rows.select(
        "conv_id",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL")).alias("conv"),
        F.unhex(F.array_join(hashes, "")).alias("path"),
        F.transform(whole, lambda t: F.length(t).cast("long")).alias("chars"),
        F.transform("turns", lambda t: F.when(t["learned"], F.length(t["head"])).otherwise(-1)).alias("heads"),
        F.array_join(whole, "").alias("text"),
    ).withColumn("key", F.sha2("path", 256))


# --- Layout ----------------------------------------------------------------


def shared_turns(one: bytes, other: bytes) -> int:
    """Turns that two paths begin with alike."""
    most = min(len(one), len(other)) // WIDTH
    low = 0
    while low < most:
        middle = (low + most + 1) // 2
        if one[: middle * WIDTH] == other[: middle * WIDTH]:
            low = middle
        else:
            most = middle - 1
    return low


LAYOUT = (
    "key string, conv string, range int, line long, path binary, chars array<long>, "
    f"start long, position long, size long, ancestors {INTERVALS}, loss {INTERVALS}"
)


def _runs_in_range(rows: Iterable[dict], number: int):
    """Runs of the sorted conversations of a range, as if they were all there are."""
    offset, path = 0, b""
    # The turns of the last path by run: first turn, place in the stream.
    held: list[tuple[int, int]] = []
    for line, row in enumerate(rows):
        shared = shared_turns(path, row["path"])
        while held and held[-1][0] >= shared:
            held.pop()
        path, chars = row["path"], row["chars"]
        until = [turn for turn, _ in held[1:]] + [shared]
        ancestors = [
            (start, start + sum(chars[turn:stop]))
            for (turn, start), stop in zip(held, until, strict=False)
        ]
        position, size = sum(chars[:shared]), sum(chars[shared:])
        loss, at = [], 0
        for n, head in zip(chars[shared:], row["heads"][shared:], strict=True):
            if head >= 0:
                loss.append((at + head, at + n - len(CLOSE)))
            at += n
        yield {
            "key": row["key"],
            "conv": row["conv"],
            "range": number,
            "line": line,
            "path": path,
            "chars": chars,
            "start": offset,
            "position": position,
            "size": size,
            "ancestors": ancestors,
            "loss": loss,
        }
        held.append((shared, offset))
        offset += size


@dataclass(frozen=True)
class Before:
    """What a range shares with those before it, and where it begins."""

    base: int
    shared: int
    ancestors: tuple[tuple[int, int], ...]

    def beginning(self, size: int) -> Intervals:
        """The intervals of the first so many of the shared code points."""
        found, left = [], size
        for start, stop in self.ancestors:
            if left > 0:
                found.append((start, min(stop, start + left)))
                left -= stop - start
        return found

    def placed(self, intervals: Iterable[tuple[int, int]]) -> Intervals:
        """Intervals of the range's own stream in that of all.

        The first run of the range began at 0, with the shared code points.
        """
        found = []
        for start, stop in intervals:
            if start == 0:
                found += self.beginning(min(stop, self.shared))
                if stop > self.shared:
                    found.append((self.base, self.base + stop - self.shared))
            else:
                found.append((start - self.shared + self.base, stop - self.shared + self.base))
        return found


def _befores(layout: DataFrame) -> dict[int, Before]:
    """By range; reads the first and the last conversation of each."""
    edge = F.struct("path", "chars", "start", "size", "ancestors")
    edges = layout.groupBy("range").agg(
        F.min_by(edge, "line").alias("first"), F.max_by(edge, "line").alias("last")
    )
    found, base, path, whole = {}, 0, b"", []
    for row in sorted(edges.collect(), key=lambda row: row.range):
        first, last = row.first, row.last
        shared = sum(first.chars[: shared_turns(path, bytes(first.path))])
        before = Before(base, shared, tuple(Before(0, 0, tuple(whole)).beginning(shared)))
        found[row.range] = before
        path = bytes(last.path)
        whole = before.placed([*map(tuple, last.ancestors), (last.start, last.start + last.size)])
        base += last.start + last.size - shared
    return found


def lay_out(written: DataFrame) -> DataFrame:
    """The runs of :func:`write_conversations`, without their text; one per
    different conversation (``key``), whose text ``conv`` has."""
    one = written.groupBy("key").agg(
        F.min("conv").alias("conv"),
        *[F.first(name).alias(name) for name in ("path", "chars", "heads")],
    )

    def in_ranges(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batches(_runs_in_range(rows, TaskContext.get().partitionId()), LAYOUT)

    layout = stored(
        one.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(in_ranges, LAYOUT),
        "chat-layout",
    )
    befores = _befores(layout)

    def placed(batches):
        yield from _batches(
            (_placed(row, befores[row["range"]]) for batch in batches for row in batch.to_pylist()), RUNS
        )

    return layout.select("key", "conv", "range", "line", "start", "position", "size", "ancestors", "loss").mapInArrow(
        placed, RUNS
    )


RUNS = f"key string, conv string, start long, position long, size long, ancestors {INTERVALS}, loss {INTERVALS}"


def _placed(row: dict, before: Before) -> dict:
    def pairs(name):
        return [(i["start"], i["stop"]) for i in row[name]]

    gone = before.shared if row["line"] == 0 else 0
    return {
        "key": row["key"],
        "conv": row["conv"],
        "start": row["start"] + gone - before.shared + before.base,
        "position": row["position"] + gone,
        "size": row["size"] - gone,
        "ancestors": before.beginning(gone) if gone else before.placed(pairs("ancestors")),
        "loss": [(start - gone, stop - gone) for start, stop in pairs("loss") if start >= gone],
    }


def _batches(rows: Iterable[dict], columns: str, most: int = 1000):
    """Rows as Arrow batches; intervals are given as pairs."""
    interval = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = {
        "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), INTERVALS: interval,
    }
    fields = [column.split(" ", 1) for column in re.split(r", (?=\w+ )(?![^<]*>)", columns)]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    spans = [name for name, kind in fields if kind == INTERVALS]
    held = []

    def batch():
        return pa.RecordBatch.from_pylist(held, schema=schema)

    for row in rows:
        held.append(row | {n: [{"start": a, "stop": b} for a, b in row[n]] for n in spans})
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


# --- The operator ----------------------------------------------------------


def pack(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream of conversations, and where each conversation ends in it.

    ``turns`` has conv_id, turn, role and text; other columns are not read. The
    first table has a row per run: ``start, position, size, text, loss,
    ancestors`` (see above); together they cover the stream without gaps. The
    second has a row per ``conv_id``: the ``start`` of the run that it ends
    with. Conversations with the same turns end with the same run.
    """
    written = stored(write_conversations(turns), "chat-written")
    runs = lay_out(written)
    texts = written.select("conv", "text")
    stream = stored(
        runs.join(texts, "conv")
        .withColumn("text", F.substr("text", F.col("position").cast("int") + 1))
        .drop("conv"),
        "chat-stream",
    )
    ends = written.select("conv_id", "key").join(stream.select("key", "start"), "key").drop("key")
    return stream.drop("key"), ends


def unpack(stream: DataFrame, ends: DataFrame) -> DataFrame:
    """``conv_id, text, loss`` of each conversation: its text in the template and
    the intervals on which training counts, gathered from the stream."""
    own = F.struct("start", (F.col("start") + F.col("size")).alias("stop"))
    seen = stream.select("start", F.posexplode(F.concat("ancestors", F.array(own))).alias("number", "part"))
    parts = ends.join(seen, "start").select(
        "conv_id", "number", F.col("part.start").alias("start"), (F.col("part.stop") - F.col("part.start")).alias("taken")
    )
    pieces = parts.join(stream.select("start", "position", "text", "loss"), "start").select(
        "conv_id",
        F.struct(
            "number",
            F.substr("text", F.lit(1), F.col("taken").cast("int")).alias("text"),
            F.transform(
                F.filter("loss", lambda i: i["stop"] <= F.col("taken")),
                lambda i: F.struct(
                    (i["start"] + F.col("position")).alias("start"), (i["stop"] + F.col("position")).alias("stop")
                ),
            ).alias("loss"),
        ).alias("piece"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("pieces.text"), "").alias("text"),
        F.flatten(F.col("pieces.loss")).alias("loss"),
    )


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a conversation in the template."""
    turns = []
    for turn in text.split(START)[1:]:
        role, rest = turn.split("\n", 1)
        if not rest.endswith(CLOSE):
            raise ValueError(f"turn without an end: {rest[-20:]!r}")
        turns.append((unescaped_role(role), unescaped(rest[: -len(CLOSE)])))
    return turns


DIGEST = (
    "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digest(unpacked: DataFrame) -> DataFrame:
    """Hashes of what :func:`unpack` returns."""

    def hashed(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                turns = read_turns(row["text"])
                learned = "".join(unescaped(row["text"][i["start"] : i["stop"]]) for i in row["loss"])
                rows.append(
                    (
                        len(turns),
                        _sha256("".join(f"{role}\n{text}\n" for role, text in turns)),
                        len(learned),
                        _sha256(learned),
                        len(row["text"]),
                    )
                )
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names)

    kind = unpacked.schema["conv_id"].dataType.simpleString()
    names = [column.split()[0] for column in DIGEST.split(", ")]
    kinds = [pa.string() if name.endswith("sha256") else pa.int64() for name in names[1:]]
    return unpacked.mapInArrow(hashed, DIGEST.format(kind=kind))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# A conversation whose texts are control strings.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def with_odd_conversation(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1."""
    odd = turns.sparkSession.range(2).select(
        F.lit(-1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(odd)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_odd_conversation(table(spark, sf_dir, "conversations"))
    return digest(unpack(*pack(turns)))


OP12_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{ODD_TEXT}'
    UNION ALL SELECT -1, 1, '{LEARNED}', '{ODD_TEXT}'
), lined AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS line,
           len('{START}') + len('{END}') + 2 + len(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
           + len(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
                                '<(\\*)\|', '<\\\1|', 'g')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY line)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY line) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM lined GROUP BY conv_id
"""
