"""A Merkle tree over a table's rows, with a proof for each row.

Rows are hashed in the JVM and sorted by language and id into ranges; the place
of a row within its language is its place in the range plus what the ranges
before hold. ``FAN ** height`` consecutive nodes are a superblock, which one call
reduces to its node. Superblock nodes are nodes of the next tier, and so on up to
one node per language; those nodes are one more branch, whose top is the root.
On the way back each superblock meets the outer nodes that its proofs need, a row
per level, in a cogrouped call that reduces the superblock again, joins the proofs
and folds them. No call holds more than a superblock, however many rows
a language has, and nothing but counts of ranges and the root reaches the driver.

A row without language belongs to the branch of NULL, which comes first. Rows
with the same id are ordered by their hash, those without an id come first. An
empty table has no rows to prove; its root is the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stored, table

# Children of a node, and how a missing value is written.
FAN = 8
MISSING = "-"

# Levels that one call reduces: superblocks of 512 nodes.
HEIGHT = 3

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Digests = list[str]


def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(MISSING))


def leaf_hash(text: Column) -> Column:
    values = [text if name == "text" else F.col(name) for name in LEAF_COLUMNS]
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def is_tampered() -> Column:
    """Rows whose copy ``op13`` tampers with; one without an id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def branch_of(lang: Column) -> Column:
    """A language as a text that sorts as wanted: NULL first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def parent(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def reduce_levels(nodes: Digests, levels: int | None) -> list[Digests]:
    """The nodes, and each level above: so many, or up to a single node.

    In a superblock of several every level counts, also above a single node,
    as on that level there are more nodes beside it.
    """
    rows = [nodes]
    while len(rows) - 1 < levels if levels is not None else len(rows[-1]) > 1:
        below = rows[-1]
        rows.append([parent(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return rows


def own_levels(rows: pd.DataFrame, height: int) -> list[Digests]:
    """The levels of a superblock whose rows are in order."""
    several = rows["size"].iloc[0] > FAN**height
    return reduce_levels(rows["digest"].tolist(), height if several else None)


def siblings(rows: list[Digests], place: int) -> Iterator[tuple[str, str]]:
    """Per level the digests before and after a node's own among its run."""
    for level in rows[:-1]:
        first = place - place % FAN
        yield "".join(level[first:place]), "".join(level[place + 1 : first + FAN])
        place //= FAN


def with_places(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``place`` (from 0 in its ``branch``) and ``size`` (of the branch).

    Rows are sorted into ranges and written with the number of their range. A
    branch's rows in a range follow each other, so what a row needs to know is
    one number for each branch in a range; that join has no key larger than a
    range, whatever a branch holds.
    """
    keys = ["branch", *order]
    ranges = stored(
        nodes.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("range", F.spark_partition_id())
        .withColumn("line", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "manifest-ranges",
    )
    pieces = ranges.groupBy("branch", "range").agg(
        F.count(F.lit(1)).alias("rows"), F.min("line").alias("first")
    )
    # A branch has a piece per range at most, so these windows are small.
    branch = Window.partitionBy("branch")
    before = branch.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "branch",
        "range",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(branch).alias("size"),
    )
    return (
        ranges.join(pieces, ["branch", "range"])
        .withColumn("place", F.col("line") + F.col("shift"))
        .drop("range", "line", "shift")
    )


def in_superblocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / FAN**height))


def reduced(nodes: DataFrame, height: int) -> DataFrame:
    """The next tier: a node per superblock."""

    def node(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        branch, block = key
        top = own_levels(rows.sort_values("place"), height)[-1][0]
        size = -(-int(rows["size"].iloc[0]) // FAN**height)
        return pd.DataFrame({"branch": [branch], "place": [block], "digest": [top], "size": [size]})

    grouped = in_superblocks(nodes, height).select("branch", "block", "place", "digest", "size")
    return grouped.groupBy("branch", "block").applyInPandas(
        node, "branch string, place long, digest string, size long"
    )


def tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, then the superblock nodes, and so on to one node a branch."""
    found = [nodes]
    while True:
        most = found[-1].agg(F.max("size")).first()[0] or 0
        if most <= 1 and len(found) > 1:
            return found
        found.append(stored(reduced(found[-1], height), "manifest-tier"))


OUTER = "branch string, place long, level int, before string, after string, top string"


def outward(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """The outer nodes of each node of a tier, of those of its superblock.

    ``outer`` has rows of the tier above: levels count from 0 at the lowest one;
    the row of level -1 says what top the proof leads to.
    """

    def joined(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        branch, _ = key
        rows = rows.sort_values("place")
        above = above.sort_values("level")
        levels = own_levels(rows, height)
        base = int(rows["place"].iloc[0])
        out = []
        for place in rows["place"].tolist():
            own = list(siblings(levels, place - base))
            own += [(r.before, r.after) for r in above.itertuples() if r.level >= 0]
            top = above["top"].iloc[0]
            out.append((branch, place, -1, "", "", top))
            out += [(branch, place, k, before, after, top) for k, (before, after) in enumerate(own)]
        return pd.DataFrame(out, columns=["branch", "place", "level", "before", "after", "top"])

    blocks = in_superblocks(nodes, height).select("branch", "block", "place", "digest", "size")
    return _meet(blocks, outer, joined, OUTER)


def _meet(blocks: DataFrame, outer: DataFrame, joined, schema: str) -> DataFrame:
    above = outer.withColumnRenamed("place", "block")
    return (
        blocks.groupBy("branch", "block")
        .cogroup(above.groupBy("branch", "block"))
        .applyInPandas(joined, schema)
    )


def climb(levels: list[DataFrame], top: DataFrame, height: int) -> DataFrame:
    """From a tree's top (outer rows of its highest tier) to its first tier's superblocks."""
    outer = top
    for nodes in reversed(levels[1:-1]):
        outer = outward(nodes, outer, height)
    return outer


def prove(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The tree over ``branch, doc_id, leaf, shown`` and each row's proof.

    ``shown`` is the hash that a proof is folded from. Adds ``subroot``, ``root``,
    ``proof_sha256`` (hash of all siblings on the way up), ``folded_root`` and
    ``verified``.
    """
    kind = leaves.schema["doc_id"].dataType.simpleString()
    placed = stored(
        with_places(leaves.withColumn("digest", F.col("leaf")), "doc_id", "leaf", "shown"),
        "manifest-leaves",
    )
    below = tiers(placed, height)
    # One node a language: these are one branch of their own.
    tops = below[-1].select(F.lit("").alias("branch"), F.col("branch").alias("lang"), "digest")
    roots = stored(with_places(tops, "lang"), "manifest-subroots")
    above = tiers(roots, height)
    found = above[-1].first()
    root = found.digest if found else parent([])

    # Of each language's node: the siblings above it. Its top is itself, the subroot.
    summit = above[-1].selectExpr(
        "branch", "place", "-1 AS level", "'' AS before", "'' AS after", f"'{root}' AS top"
    )
    ends = outward(roots, climb(above, summit, height), height)
    names = roots.select("lang", "place", F.col("digest").alias("subroot"))
    top = ends.join(names, "place").select(
        F.col("lang").alias("branch"),
        F.lit(0).cast("long").alias("place"),
        "level",
        "before",
        "after",
        F.col("subroot").alias("top"),
    )
    outer = climb(below, stored(top, "manifest-tops"), height)

    def folded(key: tuple, rows: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        outside = outside.sort_values("level")
        levels = own_levels(rows, height)
        further = [(r.before, r.after) for r in outside.itertuples() if r.level >= 0]
        proofs, ends = [], []
        for place, shown in enumerate(rows["shown"].tolist()):
            steps = [*siblings(levels, place), *further]
            proofs.append(parent(part for step in steps for part in step))
            for before, after in steps:
                shown = parent((before, shown, after))
            ends.append(shown)
        return rows[["doc_id", "leaf"]].assign(
            subroot=outside["top"].iloc[0], root=root, proof_sha256=proofs, folded_root=ends
        )

    # Ids go through pandas as text, where NULL would make them inexact numbers.
    blocks = in_superblocks(placed, height).withColumn("doc_id", F.col("doc_id").cast("string"))
    result = _meet(
        blocks,
        outer,
        folded,
        "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )
    return result.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def manifest(docs: DataFrame, changed: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A row per row of ``docs``: its leaf, proof and whether it still verifies.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns are not
    read. ``changed`` is what the text is when the proof is checked; without it
    every row verifies. NULLs, repeated rows and repeated ids each have leaves.
    One call reduces ``height`` levels.
    """
    text = F.col("text")
    leaves = docs.select(
        branch_of(F.col("lang")).alias("branch"),
        "doc_id",
        leaf_hash(text).alias("leaf"),
        leaf_hash(text if changed is None else changed).alias("shown"),
    )
    return prove(stored(leaves, "manifest-hashes"), height)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    return manifest(docs, F.when(is_tampered(), lower_ascii(text)).otherwise(text))


# Levels that the SQL builds: up to 8^8 rows a language and 8^4 languages.
_SQL_LEVELS, _SQL_TOP_LEVELS = 8, 4


def _sql_leaf(text: str) -> str:
    values = [text if name == "text" else f"CAST({name} AS VARCHAR)" for name in LEAF_COLUMNS]
    return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '{MISSING}')" for v in values)})"


def _sql_tree(name: str, first: str, levels: int) -> str:
    """Levels ``name0`` (query ``first``) and up, and each node's neighbours in its run."""
    parts = [f"{name}0 AS ({first})"]
    for k in range(levels):
        parts.append(
            f"""{name}{k + 1} AS (
    SELECT branch, place // {FAN} AS place, (size + {FAN - 1}) // {FAN} AS size,
           CASE WHEN size > 1 THEN sha256(string_agg(digest, '' ORDER BY place))
                ELSE min(digest) END AS digest
    FROM {name}{k} GROUP BY branch, place // {FAN}, size)"""
        )
        parts.append(
            f"""{name}{k}_run AS (
    SELECT branch, place, size > 1 AS counts,
           coalesce(string_agg(digest, '') OVER (PARTITION BY branch, place // {FAN} ORDER BY place
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '') OVER (PARTITION BY branch, place // {FAN} ORDER BY place
               ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM {name}{k})"""
        )
    return ",\n".join(parts)


def _sql_fold(names: list[str], name: str, branch: str, place: str, levels: int) -> tuple[str, str]:
    """One query after the other that folds a level; the last one's name."""
    parts = []
    for k in range(levels):
        before = names[-1]
        names.append(f"{name}_fold{k}")
        parts.append(
            f"""{names[-1]} AS (
    SELECT f.* EXCLUDE (proof, folded), f.proof || r.before || r.after AS proof,
           CASE WHEN r.counts THEN sha256(r.before || f.folded || r.after) ELSE f.folded END AS folded
    FROM {before} f JOIN {name}{k}_run r
        ON r.branch = f.{branch} AND r.place = f.{place} // {FAN**k})"""
        )
    return ",\n".join(parts), names[-1]


def _sql() -> str:
    leaves = """SELECT doc_id, branch, shown, leaf, leaf AS digest,
           row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS place,
           count(*) OVER (PARTITION BY branch) AS size
    FROM hashed"""
    tops = f"""SELECT '' AS branch, branch AS lang, digest, count(*) OVER () AS size,
           row_number() OVER (ORDER BY encode(branch)) - 1 AS place
    FROM leaf{_SQL_LEVELS}"""
    names = ["begun"]
    inner, _ = _sql_fold(names, "leaf", "branch", "place", _SQL_LEVELS)
    outer, last = _sql_fold(names, "top", "all_langs", "top_place", _SQL_TOP_LEVELS)
    return f"""
WITH table_of_crc AS (
    SELECT list_transform(range(0, 256), lambda x: list_reduce(range(0, 8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t
), crc AS (
    SELECT *, xor(list_reduce(
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295) AS crc
    FROM documents, table_of_crc
), hashed AS (
    SELECT doc_id, coalesce('=' || lang, '') AS branch, {_sql_leaf("text")} AS leaf,
           CASE WHEN crc % 3 = 0
                THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                ELSE {_sql_leaf("text")} END AS shown
    FROM crc
), {_sql_tree("leaf", leaves, _SQL_LEVELS)},
{_sql_tree("top", tops, _SQL_TOP_LEVELS)},
begun AS (
    SELECT l.doc_id, l.branch, l.place, l.leaf, t.place AS top_place, t.digest AS subroot,
           '' AS all_langs, '' AS proof, l.shown AS folded
    FROM leaf0 l JOIN top0 t ON t.lang = l.branch
),
{inner},
{outer}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = digest AS verified
FROM {last}, (SELECT digest FROM top{_SQL_TOP_LEVELS})
"""


OP13_SQL = _sql()
