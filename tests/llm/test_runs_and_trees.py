import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, manifest, periodic_runs
from millrace.llm.common import words_of

SF = "/root/testdata/sf0.001"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Periodic runs ---------------------------------------------------------


def plain_runs(words):
    """Every stretch with every period, the smallest period of each kept."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_cover_meets_every_difference():
    cover = periodic_runs.COVER
    assert {(a - b) % periodic_runs.MODULUS for a in cover for b in cover} == set(range(31))


def test_extensions_are_those_of_comparing():
    rng = np.random.default_rng(0)
    for n, letters in [(2, 1), (40, 2), (300, 1), (300, 2), (900, 3)]:
        words = rng.integers(0, letters, n)
        words[n // 2 :] = words[: n - n // 2]
        words[-1] = 99
        tool = periodic_runs.Extensions(words)
        left, right = rng.integers(0, n, 2000), rng.integers(0, n, 2000)
        left, right = left[left != right], right[left != right]
        for i, j, found in zip(left, right, tool(left, right), strict=True):
            length = 0
            while max(i, j) + length < n and words[i + length] == words[j + length]:
                length += 1
            assert found == length


def test_runs_are_those_of_trying_all():
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 30, 100, 300]), rng.choice([1, 2, 3, 50])
            text = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                text = text[:a] + [text[a + (i - a) % p] for i in range(a, n)]
            texts.append(text)
        found = periodic_runs.find_runs([np.array(t, dtype=np.int64) for t in texts])
        assert [list(map(tuple, r.tolist())) for r in found] == [plain_runs(t) for t in texts]


def plain_op11(doc_id, text):
    words = words_of(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha256(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_op11(spark, documents):
    rows = sorted(tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect())
    short = documents[documents.text.str.len() < 20_000]
    expected = {i: plain_op11(i, t) for i, t in zip(short.doc_id, short.text, strict=True)}
    assert len(rows) == len(documents)
    assert [r for r in rows if r[0] in expected] == sorted(expected.values())
    assert sum(r[1] > 0 for r in rows) > 10


def test_runs_of_odd_rows(odd, none):
    found = periodic_runs.detect_runs(odd)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    kept = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows == sorted((plain_op11_as_is(*row) for row in kept), key=repr)
    assert periodic_runs.detect_runs(none).collect() == []
    assert periodic_runs.detect_runs(none).columns == found.columns


def plain_op11_as_is(doc_id, text):
    """Of texts that hold no runs, or one word over and over."""
    words = words_of(text or "")
    if len(words) < 1000:
        return (doc_id, *plain_op11(None, text)[1:])
    assert set(words[:-1]) == {"word"} and words[-1] == "tail"
    n = len(words) - 1
    return (doc_id, 1, 0, n, 1, 1000 * n, sha256(f"0,{n},1\n"), sha256("word tail"))


def test_texts_are_judged_alike_in_any_batch(documents):
    lists = [periodic_runs.planted(words_of(t), i) for i, t in zip(documents.doc_id, documents.text, strict=True)]
    together = periodic_runs.runs_of(lists)
    alone = [periodic_runs.runs_of([words])[0] for words in lists]
    assert all(a.tolist() == b.tolist() for a, b in zip(together, alone, strict=True))


# --- Manifest --------------------------------------------------------------


def plain_manifest(rows, changed):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of tuples of columns."""

    def leaf(row):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
        return sha256("".join(parts))

    def tree(digests):
        """The top, and the siblings of each digest: level by level before and after."""
        paths, owner = [[] for _ in digests], [[i] for i in range(len(digests))]
        while len(digests) > 1:
            above, owners = [], []
            for at in range(0, len(digests), 8):
                run = digests[at : at + 8]
                for k, members in enumerate(owner[at : at + 8]):
                    for i in members:
                        paths[i].append((run[:k], run[k + 1 :]))
                above.append(sha256("".join(run)))
                owners.append([i for members in owner[at : at + 8] for i in members])
            digests, owner = above, owners
        return digests[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(
            ((r[0] is not None, r[0] or 0, leaf(r), leaf((*r[:4], changed(*r))), r[0]) for r in rows if r[2] == lang)
        )
        trees[lang] = own, *tree([o[2] for o in own])
    root, tops = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, paths = trees[lang]
        for (_, _, digest, shown, doc_id), path in zip(own, paths, strict=True):
            proof = ""
            for before, after in path + top:
                proof += "".join(before + after)
                shown = sha256("".join(before) + shown + "".join(after))
            out.append((doc_id, digest, subroot, root, sha256(proof), shown, shown == root))
    return sorted(out, key=repr)


def lowered(doc_id, source, lang, n_chars, text):
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def columns(df):
    return [tuple(r) for r in df.select(*manifest.LEAF_COLUMNS).collect()]


def tampered(docs, height):
    text = F.col("text")
    changed = F.when(manifest.is_tampered(), manifest.lower_ascii(text)).otherwise(text)
    return sorted(map(tuple, manifest.manifest(docs, changed, height).collect()), key=repr)


def test_op13(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, manifest.op13_merkle_manifest(spark, SF).collect()), key=repr)
    assert rows == plain_manifest(columns(docs), lowered) == tampered(docs, 1)
    assert {r[-1] for r in rows} == {True, False}


def test_manifest_of_many_languages_and_odd_rows(spark, odd, none):
    langs = spark.range(75).selectExpr(
        "(1 << 60) + id AS doc_id", "'some Text' AS text", "if(id < 73, 'l' || (id % 70), null) AS lang",
        "'s' AS source", "id AS n_chars", "'x' AS branch", "1 AS place", "2 AS leaf", "'é' AS size",
    )
    for docs in (odd, langs, odd.unionByName(langs, allowMissingColumns=True)):
        assert tampered(docs, 1) == plain_manifest(columns(docs), lowered)
        assert all(r.verified for r in manifest.manifest(docs).collect())
    assert manifest.manifest(none).collect() == []


def test_op13_is_its_sql(spark):
    import duckdb

    rows = sorted(map(tuple, manifest.op13_merkle_manifest(spark, SF).collect()))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows == sorted(database.sql(manifest.OP13_SQL).fetchall())


# --- Conversations ---------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def branching(n=300):
    """Conversations that share beginnings; a third of them the same first turns."""
    rng = random.Random(3)
    rows, known = [], [[("system", "be brief"), ("user", "hi")]]
    for conv_id in range(n):
        beginning = known[0] if conv_id % 3 == 0 else rng.choice(known)
        turns = beginning[: rng.randint(1, len(beginning))]
        for _ in range(rng.randint(0, 3)):
            role = rng.choice(["user", "assistant", None, "a\\n\n<|b"])
            turns = [*turns, (role, rng.choice(["a", "<|im_end|>", "<\\|x", "", None, "ü<", "|>"]))]
        known.append(turns)
        rows += [(conv_id, k, *turn) for k, turn in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def plain_conversations(rows):
    """By id the turns in order, NULL as an empty text."""
    found = {}
    for conv_id, turn, role, text in rows:
        found.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv_id: [t[2:] for t in sorted(turns)] for conv_id, turns in found.items()}


def plain_op12(rows):
    out = []
    for conv_id, turns in plain_conversations(rows).items():
        learned = "".join(text for role, text in turns if role == "assistant")
        digest = sha256("".join(f"{role}\n{text}\n" for role, text in turns))
        out.append((conv_id, len(turns), digest, len(learned), sha256(learned)))
    return sorted(out, key=repr)


def digests(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_stream_is_the_prefix_tree_depth_first(spark, partitions):
    rows = branching()
    turns = spark.createDataFrame(rows, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream, ends = chat.pack(turns)
        runs = sorted(stream.collect(), key=lambda r: r.start)
        end_of = {r.conv_id: r.start for r in ends.collect()}
        unpacked = chat.unpack(stream, ends)
        assert digests(chat.digest(unpacked)) == plain_op12(rows)
        texts = {r.conv_id: r.text for r in unpacked.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    whole = "".join(r.text for r in runs)
    assert [r.start for r in runs] == [sum(len(r.text) for r in runs[:k]) for k in range(len(runs))]
    # Each turn of the tree is written once.
    expected = plain_conversations(rows)
    tree = {tuple(turns[:k]) for turns in expected.values() for k in range(1, len(turns) + 1)}
    assert whole.count(chat.START) == len(tree)
    by_start = {r.start: r for r in runs}
    turns_at = {}
    for conv_id, turns in expected.items():
        run = by_start[end_of[conv_id]]
        assert sum(b - a for a, b in run.ancestors) == run.position
        seen = "".join(whole[a:b] for a, b in run.ancestors) + run.text
        assert seen == texts[conv_id]
        assert chat.read_turns(seen) == turns
        places = [i for a, b in [*run.ancestors, (run.start, run.start + run.size)] for i in range(a, b)]
        at = [i for i in range(len(seen)) if seen.startswith(chat.START, i)]
        for k, i in enumerate(at):
            assert turns_at.setdefault(tuple(turns[: k + 1]), places[i]) == places[i]
    # Depth first: in the order of the stream the paths of turns are a walk.
    walk, path = sorted(turns_at, key=turns_at.get), ()
    for node in walk:
        assert path[: len(node) - 1] == node[:-1]
        path = node


def test_escapes_are_reversible(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("<|\\\n>an", k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat.escaped(F.col("t")), chat.escaped_role(F.col("t"))).collect():
        assert "<|" not in row[1] and "<|" not in row[2] and "\n" not in row[2]
        assert chat.unescaped(row[1]) == chat.unescaped_role(row[2]) == row[0]


def test_op12_and_its_sql(spark):
    import duckdb

    found = chat.op12_chat_format(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*TURN_COLUMNS).collect()]
    rows += [(-1, 0, "user", chat.ODD_TEXT), (-1, 1, "assistant", chat.ODD_TEXT)]
    assert digests(found) == plain_op12(rows)
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    result = database.sql(chat.OP12_SQL)
    assert result.columns == found.columns
    assert sorted(result.fetchall()) == sorted(map(tuple, found.collect()))


TURN_COLUMNS = ("conv_id", "turn", "role", "text")


def test_odd_conversations(spark):
    rows = [
        (None, 1, "user", "no id"),
        (None, None, "user", "no number"),
        (1, 2, None, None),
        (1, 2, None, None),
        (1, 0, "assistant", "x" * 100_000),
        (2, 0, "assistant", "x" * 100_000),
        (3, 0, "assistant", ""),
        (4, 1, "b", "tie"),
        (4, 1, "a", "tie"),
    ]
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'k' AS key", "1 AS start", "2 AS size", "3 AS conv")
    assert digests(chat.digest(chat.unpack(*chat.pack(turns)))) == plain_op12(rows)
    none = chat.digest(chat.unpack(*chat.pack(turns.limit(0))))
    assert none.collect() == [] and none.columns[0] == "conv_id"
