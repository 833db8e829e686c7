"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import new_folder

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later jobs then start from files that all executors can reach, whichever
    of them has been lost. Like every scratch table it stays until
    ``millrace.session.remove_scratch`` is called.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def order_hash(*columns: Column) -> Column:
    """A text that orders rows as if shuffled, the same in every run and engine."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def drawn(rows: DataFrame, n: int, *keys: Column) -> DataFrame:
    """``n`` rows, or all if there are no more, in an order by hash of ``keys``.

    Only about as many leave the executors: a bound on the hash comes first, which
    ``n`` rows and some more fall below.
    """
    total, draw = rows.count(), order_hash(*keys)
    if total > n:
        share = (n + 8 * math.sqrt(n) + 20) / total
        rows = rows.filter(F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") < math.ceil(share * 2**32))
    return rows.orderBy(draw).limit(n)


def number_array(values, kind: str = "double") -> Column:
    """Numbers as one constant array: an element costs no expression of its own."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, *keys: str):
    """Tables of sorted rows, cut so that no group of equal keys is in two.

    What is held at a time is a batch and one group.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        cuts = group_starts(held, *keys)
        if len(cuts) > 1:
            yield held.slice(0, cuts[-1]).combine_chunks()
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_starts(rows: pa.Table, *keys: str) -> np.ndarray:
    """The first row of each run of equal keys."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def in_block_pairs(rows: DataFrame, group: str, size: str, member: str, block: int) -> DataFrame:
    """Deal the rows of each group to tasks so that every two of them meet.

    A group of up to ``block`` rows (column ``size`` has how many) is one task's.
    A larger one is cut into blocks by hash, and each pair of blocks meets in a
    task: a row is repeated once per block. Adds ``lo``, ``hi`` (the pair) and
    ``part`` (the row's own block); rows come sorted by group and pair.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    return (
        rows.withColumn("part", F.pmod(F.xxhash64(member), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
        .drop("other", size)
        .repartition(group, "lo", "hi")
        .sortWithinPartitions(group, "lo", "hi", member)
    )


def pairs_in(part: np.ndarray, most: int = 1 << 20):
    """Pairs of row numbers of one task's group, in pieces of about ``most``.

    In a pair of different blocks only rows of different blocks are paired, as
    rows of one block meet elsewhere.
    """
    if not len(part):
        return
    n, cross = len(part), part.min() != part.max()
    step = max(1, most // n)
    for start in range(0, n, step):
        first = np.arange(start, min(n, start + step))
        left, right = np.repeat(first, n), np.tile(np.arange(n), len(first))
        keep = left < right
        if cross:
            keep &= part[left] != part[right]
        yield left[keep], right[keep]


def least_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows 0 to n - 1 the least row that the pairs connect each with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label
