"""Find secrets: rules for known forms, Markov models for unknown ones.

One model has seen random strings, the other ordinary text. A run of
characters is taken for a secret if the log-likelihood ratio of the two says
that it is random. Both are tables of character pairs, counted over all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, table

# The rules' patterns and least lengths.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

# Runs that the models judge.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PAIRS = len(ALPHABET) ** 2
# Natural logarithm of the least likelihood ratio, for a run and per character.
LEAST_RATIO = 15.0
LEAST_MEAN = 0.5
# Pairs added to each count; the models then know what they have not seen.
SMOOTHING = 1.0

_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))

SPAN = "array<struct<start:int, end:int, kind:int, value:string>>"
_SPAN = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string())])
)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, end, kind, value)`` of the rules' matches by start, then kind."""
    found = [
        (m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
    ]
    found += [
        (m.start(), m.end(), 1, m[0])
        for m in ACCESS.finditer(text)
        if m.end() - m.start() >= ACCESS_LEAST
    ]
    # A run of fewer digits has no shorter match to try, so the length can be
    # part of the pattern.
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def runs_beside(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs of the alphabet that touch none of the spans."""
    found, inside, reach = [], 0, -1
    for m in RUN.finditer(text):
        while inside < len(taken) and taken[inside][0] < m.end():
            reach = max(reach, taken[inside][1])
            inside += 1
        if m.start() >= reach:
            found.append((m.start(), m.end(), 3, m[0]))
    return found


def pair_codes(text: str) -> np.ndarray:
    """A number per pair of neighbours of which both are in the alphabet."""
    codes = _CODE[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
    left, right = codes[:-1], codes[1:]
    return (left * len(ALPHABET) + right)[(left >= 0) & (right >= 0)]


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the rules' spans ``base`` and the ``runs`` left to judge."""

    def find(batches):
        for batch in batches:
            base, runs = [], []
            for text in batch.column("text").to_pylist():
                base.append(base_spans(text or ""))
                runs.append(runs_beside(text or "", base[-1]))
            as_rows = lambda spans: pa.array(
                [[dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in row] for row in spans],
                _SPAN,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), as_rows(base), as_rows(runs)], ["doc_id", "base", "runs"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, base {SPAN}, runs {SPAN}"
    )


def pair_counts(texts: DataFrame) -> np.ndarray:
    """Pairs of neighbours in all of a table of one text column.

    Each task sends one count per pair and batch, and Spark adds them up: the
    driver gets ``PAIRS`` numbers at most.
    """

    def count(batches):
        for batch in batches:
            total = np.zeros(PAIRS, dtype=np.int64)
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(pair_codes(text), minlength=PAIRS)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int32()), pa.array(total[seen])], ["pair", "n"]
            )

    counts = texts.mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    result = np.zeros(PAIRS)
    for row in counts.collect():
        result[row.pair] = row.n
    return result


def log_transitions(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    table = counts.reshape(len(ALPHABET), -1) + smoothing
    return np.log(table / table.sum(axis=1, keepdims=True))


def fit(random: DataFrame, ordinary: DataFrame) -> np.ndarray:
    """Log-likelihood ratio per pair, from labelled samples of one text column each.

    The random sample is small and of few kinds (hexadecimal, capitals), so it
    is smoothed more: pairs across the kinds are random as well.
    """
    of_random = pair_counts(random)
    smoothing = max(SMOOTHING, of_random.sum() / PAIRS)
    ratio = log_transitions(of_random, smoothing) - log_transitions(pair_counts(ordinary))
    return ratio.ravel()


def is_random(run: str, ratio: np.ndarray) -> bool:
    found = ratio[pair_codes(run)]
    total = float(found.sum())
    return total >= LEAST_RATIO and total >= LEAST_MEAN * max(len(found), 1)


def judge(found: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id, base, added``: of the runs only those taken for random."""

    def test(batches):
        for batch in batches:
            added = pa.array(
                [
                    [run for run in runs if is_random(run["value"], ratio)]
                    for runs in batch.column("runs").to_pylist()
                ],
                _SPAN,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"), added], ["doc_id", "base", "added"]
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(test, f"doc_id {kind}, base {SPAN}, added {SPAN}")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs``; spans in code points, end exclusive.

    What the rules find is the labelled sample of random strings; all text is
    the one of ordinary characters, in which secrets are too rare to count.
    NULL and empty texts have no spans. Rows that repeat an id are scanned
    each. Other columns are not read.
    """
    found = stored(candidates(docs), "secret-candidates")
    labelled = found.select(F.explode("base.value").alias("value"))
    return judge(found, fit(labelled, docs.select("text")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]),
        ),
        ",",
    )


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    # Sorting compares the fields in their order: start, then kind.
    place = lambda s: F.struct(s["start"], s["kind"], s["end"])
    base, added = F.transform("base", place), F.transform("added", place)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(base, added)).alias("spans"),
    )
