"""Join texts whose sets of word n-grams are alike, pruning with Bayes' rule.

Texts with the same set are one class from the start. Each class has a MinHash
signature; classes that share a band of it are candidates. Their signatures are
compared a few values at a time, and a pair is dropped when the probability that
its similarity reaches the threshold, given the matches so far, is below the
tolerance. What remains connected is verified on the sets themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import (
    group_starts,
    in_block_pairs,
    least_linked,
    pairs_in,
    stored,
    table,
    whole_groups,
)
from millrace.llm.components import components

WORDS = 5
SIMILARITY = 0.8
# A pair at the threshold shares none of the bands once in 300,000 times.
BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP = 16
TOLERANCE = 1e-6
# Rows of a group that one task compares with each other.
SIGNATURE_BLOCK = 2048
TEXT_BLOCK = 512
# Shingles hashed at a time, and words remembered per task.
CHUNK_SHINGLES = 200_000
MAX_REMEMBERED = 500_000

_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, HASHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """The sorted set of hashed ``width``-word runs of a text.

    A text of fewer words has one, all of it; one without words has none.
    """
    words = (text or "").encode().split()  # splits bytes at ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    span = min(n, width)
    total = np.full(n - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = total * _MIX + codes[i : i + len(total)]
    return np.unique(_mixed(total))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One byte per hash function, and a number per band, for sets with members."""
    sizes = np.array([len(s) for s in sets])
    least = np.empty((HASHES, len(sets)), dtype=np.uint64)
    start = 0
    while start < len(sets):
        stop, total = start + 1, sizes[start]
        while stop < len(sets) and total + sizes[stop] <= CHUNK_SHINGLES:
            total += sizes[stop]
            stop += 1
        values = np.concatenate(sets[start:stop])
        starts = np.cumsum(sizes[start:stop]) - sizes[start:stop]
        for h in range(HASHES):
            least[h, start:stop] = np.minimum.reduceat(values * _TIMES[h] + _PLUS[h], starts)
        start = stop
    bands = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, dtype=np.uint64)
        for h in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            key = _mixed(key * _MIX + least[h])
        bands[:, band] = key
    return (_mixed(least) >> np.uint64(56)).astype(np.uint8).T, bands.view(np.int64)


def with_signatures(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``doc_id, digest, signature, bands``; NULL digests for texts without words."""

    def sign(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(text, hashes, width) for text in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, marks = [None] * len(sets), [None] * len(sets)
            bands = [[]] * len(sets)
            if full:
                short, keys = signatures([sets[i] for i in full])
                for i, mark, key in zip(full, short, keys, strict=True):
                    digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    marks[i], bands[i] = mark.tobytes(), key
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(digests, pa.binary()),
                    pa.array(marks, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "signature", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, digest binary, signature binary, bands array<bigint>"
    )


def needed_matches(similarity: float, tolerance: float) -> list[int]:
    """After each step of compared values, the matches a pair must have.

    Every similarity is as likely as any other beforehand. Values match if the
    sets' least members do, or else by chance in one of 256 cases.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    match = grid + (1 - grid) / 256
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        choices = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(n + 1)])
        weight = np.exp(choices[:, None] + m * np.log(match) + (n - m) * np.log1p(-match + 1e-300))
        reached = weight[:, grid >= similarity].sum(axis=1) / weight.sum(axis=1)
        needed.append(int(np.argmax(reached >= tolerance)))
    return needed


def survivors(signature: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[int]):
    """The pairs that incremental comparison does not drop."""
    matches = np.zeros(len(left), dtype=np.int16)
    for step, least in enumerate(needed):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (signature[left, part] == signature[right, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def _compare(similarity: float, tolerance: float):
    """Links between members of a band's task: each with the least it is
    connected with, which keeps together what may be alike."""

    def compare(batches):
        needed = needed_matches(similarity, tolerance)
        for rows in whole_groups(batches, "band", "lo", "hi"):
            marks = rows.column("signature").to_pylist()
            signature = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(-1, HASHES)
            ids, part = rows.column("text_id").to_numpy(), rows.column("part").to_numpy()
            starts = group_starts(rows, "band", "lo", "hi")
            left, right, waiting = [], [], 0
            kept = []
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                for x, y in pairs_in(part[a:b]):
                    left.append(x + a)
                    right.append(y + a)
                    waiting += len(x)
                    if waiting >= 1 << 19:
                        kept.append(survivors(signature, *map(np.concatenate, (left, right)), needed))
                        left, right, waiting = [], [], 0
            if waiting:
                kept.append(survivors(signature, *map(np.concatenate, (left, right)), needed))
            if not kept:
                continue
            x, y = (np.concatenate(side) for side in zip(*kept, strict=True))
            label = least_linked(rows.num_rows, x, y)
            linked = np.flatnonzero(label != np.arange(rows.num_rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[linked], pa.int64()), pa.array(ids[label[linked]], pa.int64())],
                ["a", "b"],
            )

    return compare


def alike(sets: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """Which sets reach the similarity, exactly, as a matrix.

    Shared members are counted as products of 0/1 matrices, some columns at a
    time.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    members, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(members), -1)
    place[shared] = np.arange(len(shared))
    column, row = place[column], np.repeat(np.arange(n), sizes)
    row, column = row[column >= 0], column[column >= 0]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    common = np.zeros((n, n), dtype=np.float32)
    for start in range(0, len(shared), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        has = np.zeros((n, min(columns, len(shared) - start)), dtype=np.float32)
        has[row[a:b], column[a:b] - start] = 1
        common += has @ has.T
    return common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-3


def _verify(similarity: float, width: int):
    """Per member of a task's group: how many documents it is linked with, and
    the least member it is connected with."""

    def verify(batches):
        hashes = WordHashes()
        for rows in whole_groups(batches, "root", "lo", "hi"):
            ids, copies = rows.column("text_id").to_numpy(), rows.column("copies").to_numpy()
            part, texts = rows.column("part").to_numpy(), rows.column("text")
            starts = group_starts(rows, "root", "lo", "hi")
            found, links, least = [], [], []
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                sets = [shingles(t, hashes, width) for t in texts.slice(a, b - a).to_pylist()]
                # Rows that repeat an id and its text are one.
                seen, own = set(), []
                for i, s in enumerate(sets):
                    key = (ids[a + i], s.tobytes()) if ids[a + i] in ids[a : a + i] else (ids[a + i], None)
                    if len(s) and key not in seen:
                        seen.add(key)
                        own.append(i)
                if len(own) < 2:
                    continue
                members = np.array(own) + a
                linked = alike([sets[i] for i in own], similarity)
                linked &= ids[members][:, None] != ids[members][None, :]
                if part[members].min() != part[members].max():
                    linked &= part[members][:, None] != part[members][None, :]
                x, y = np.nonzero(np.triu(linked))
                label = least_linked(len(members), x, y)
                some = np.flatnonzero(linked.any(axis=1))
                found.append(ids[members[some]])
                links.append((linked @ copies[members].astype(float))[some].astype(np.int64))
                least.append(ids[members[label[some]]])
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), pa.int64()) for c in (found, links, least)],
                    ["text_id", "links", "least"],
                )

    return verify


def join_similar(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WORDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``doc_id, text_id, class_id, n_links``, a row per row of ``docs``.

    ``text_id`` is the least id with the same set of ``width``-word runs,
    ``class_id`` the least id that links lead to, and ``n_links`` the documents
    with a similarity of at least ``similarity``, copies included.

    NULL texts and texts without words are linked with nothing. Rows that
    repeat an id are one document: they share their class and, if the texts
    differ, the links of all of them. A row without an id belongs to the class
    of documents with the same set, and to none (NULL) if there are none. Other
    columns are not read. Words are compared as they are.
    """
    signed = stored(with_signatures(docs.withColumn("doc_id", F.col("doc_id").cast("long")), width), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "signature", "bands")).alias("r")
    texts = stored(
        signed.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(least, F.count("*").alias("copies"))
        .select("digest", "copies", F.col("r.doc_id").alias("text_id"), "r.signature", "r.bands"),
        "texts",
    )
    known = texts.filter("text_id IS NOT NULL")

    in_band = known.select("text_id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    candidates = in_band.join(shared, "band").join(known.select("text_id", "signature"), "text_id")
    links = in_block_pairs(candidates, "band", "n", "text_id", SIGNATURE_BLOCK).mapInArrow(
        _compare(similarity, tolerance), "a bigint, b bigint"
    )
    groups = stored(components(links), "candidate-groups")

    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = (
        groups.join(sizes, "root")
        .withColumnRenamed("node", "text_id")
        .join(known.groupBy("text_id").agg(F.sum("copies").alias("copies")), "text_id")
        .join(docs.select(F.col("doc_id").cast("long").alias("text_id"), "text"), "text_id")
    )
    verified = stored(
        in_block_pairs(members, "root", "n", "text_id", TEXT_BLOCK).mapInArrow(
            _verify(similarity, width), "text_id bigint, links bigint, least bigint"
        ),
        "verified",
    )
    counted = verified.groupBy("text_id").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("text_id").alias("a"), F.col("least").alias("b")))

    classes = (
        texts.select("digest", "text_id", "copies")
        .join(roots.withColumnRenamed("node", "text_id"), "text_id", "left")
        .join(counted, "text_id", "left")
        .select(
            "digest",
            "text_id",
            F.coalesce("root", "text_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return (
        signed.select("doc_id", "digest")
        .join(classes, "digest", "left")
        .select(
            "doc_id",
            F.coalesce("text_id", "doc_id").alias("text_id"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def one_per_class(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class; of rows that repeat
    such an id one, the least."""
    kept = joined.filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    kept = kept.select(F.col("doc_id").alias("id"), "n")
    taken = rows.join(kept, "id")
    once, again = taken.filter("n = 1"), taken.filter("n > 1")
    again = again.groupBy("id").agg(F.min("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
