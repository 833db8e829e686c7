import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, lm, mixing
from millrace.llm.common import remainder

SF = "/root/testdata/sf0.001"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABC  '0129.,!?#éßÜıİΣσς中文\u0301\x1c\x85\xa0\u200b\U0001f600\U0001d49c"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_encoder_is_the_library(library, documents):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choices("eatinshr", k=rng.randint(1, 30))) for _ in range(3000)]
    texts += ["don't <|endoftext|>ABC<|startoftext|>", "", None, "a" * 5000, "ab" * 3000, *documents.text]
    tool = bpe.Encoder(bpe.default_vocabulary())
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    found = tool.encode(texts)
    assert found == [e.ids for e in expected]
    for ids, e in zip(found[:500], expected, strict=False):
        assert tool.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_leaves():
    tool = bpe.Encoder(bpe.default_vocabulary())
    rng = random.Random(2)
    inner = [n for n in tool.guesses if not n.endswith(tool.end) and n.isascii()]
    outer = [n for n in tool.guesses if n.endswith(tool.end) and n != tool.end and n.isascii()]
    pairs = [(rng.choice(inner), rng.choice(outer)) for _ in range(3000)]
    ids = np.array([[tool.ids[a], tool.ids[b]] for a, b in pairs])
    fine = tool.compatible(ids[:, 0], ids[:, 1])
    merged = [tool.merge(a + b[: -len(tool.end)]) == tuple(i) for (a, b), i in zip(pairs, ids.tolist(), strict=True)]
    assert fine.tolist() == merged and 0 < sum(merged) < len(merged)


def test_memory_of_words_is_bounded(monkeypatch, documents):
    tool = bpe.Encoder(bpe.default_vocabulary())
    expected = tool.encode(documents.text.tolist())
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 50)
    small = bpe.Encoder(bpe.default_vocabulary())
    assert [small.encode([t])[0] for t in documents.text] == expected


def test_op7(spark, documents, library):
    rows = {r.doc_id: r for r in bpe.op7_bpe(spark, SF).collect()}
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert rows[doc_id].n_tokens == len(ids)
        assert rows[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert rows[doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_tokens_on_odd_rows(spark, odd, none):
    rows = bpe.digest(bpe.encode(odd, bpe.default_vocabulary())).collect()
    assert len(rows) == 7 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.encode(none, bpe.default_vocabulary()).count() == 0


def test_op6_base_scores(spark, documents):
    rows = {r.doc_id: r for r in lm.op6_lm_score(spark, SF).collect()}
    counts = Counter()
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        if zlib.crc32(str(doc_id).encode()) % 10:
            counts.update(lm.tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        row, tokens = rows[doc_id], lm.tokens_of(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert row.base_score == pytest.approx(base)
        assert (row.n_tokens, row.n_known) == (len(tokens), sum(counts[t] > 0 for t in tokens))
        assert row.train_tokens == n and row.score < 0


def test_rare_words_are_joined(spark, documents, monkeypatch):
    docs = spark.createDataFrame(documents[["doc_id", "text"]])
    fitted = lm.fit(spark, docs.select("text"))
    counts, head, model = fitted
    whole = {r.doc_id: r for r in lm.score(docs, counts, head, model).collect()}
    # The same model with few words at hand: all others come by the join.
    kept = {w: i for w, i in head.ids.items() if i < head.vocabulary}
    small = lm.Head(kept, head.counts[: head.vocabulary], head.train_tokens, head.distinct, head.vocabulary)
    for r in lm.score(docs, counts, small, model).collect():
        assert r.base_score == pytest.approx(whole[r.doc_id].base_score)
        assert r.score == pytest.approx(whole[r.doc_id].score)


def test_every_word_is_modelled(spark):
    # 3000 words, each followed by its partner; far more than the 1024 of an older model.
    rng = random.Random(6)
    pairs = [(f"a{i}", f"b{i}") for i in range(1500)]
    texts = [" ".join(w for p in rng.choices(pairs, k=60) for w in p) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for head in (lm.HEAD, 100):
        counts = lm.stored(lm.count_words(docs.select("text")), "counts").cache()
        held = lm.head_of(counts, head=head)
        model = lm.train(docs.select("text"), held)
        assert np.exp(held.log_unigram()).sum() == pytest.approx(1) and model.start > held.vocabulary
        asked = [(0, "a7 b7 a900 b900"), (1, "b7 a7 b900 a900"), (2, "a7 b7 a1400 b1400"), (3, "a1400 b1400 a7 b7")]
        rows = lm.score(spark.createDataFrame(asked, "doc_id long, text string"), counts, held, model).collect()
        scores = {r.doc_id: r.score for r in rows}
        # The order of words is seen for each of them.
        assert abs(scores[0] - scores[1]) > 1e-4 and abs(scores[2] - scores[3]) > 1e-6
        rows = lm.score(docs, counts, held, model).agg({"score": "sum", "base_score": "sum"}).first()
        assert rows["sum(score)"] > rows["sum(base_score)"]


def test_held_out_texts_score_above_their_unigrams(spark):
    rows = lm.op6_lm_score(spark, SF).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(0)
    # Each token is followed by the next one, mostly.
    ids = np.zeros(40_000, dtype=np.int64)
    for i in range(1, len(ids)):
        ids[i] = (ids[i - 1] + 1) % 8 if rng.random() < 0.9 else rng.integers(8)
    before = lm.contexts(ids, np.array([len(ids)]), 8)
    trainer = lm.Trainer(lm.Model(np.log(np.full(8, 1 / 8))))
    for _ in range(40):
        trainer.learn(before, ids)
    model = trainer.model
    model.set_parameters(model.parameters())
    every = np.stack([model.log_probability(before[:50], np.full(50, t)) for t in range(8)])
    assert np.exp(every).sum(axis=0) == pytest.approx(np.ones(50), abs=1e-4)
    assert model.log_probability(before, ids).mean() > np.log(1 / 8) + 0.5


def test_contexts_stop_at_the_start_of_a_text():
    ids, ends = np.array([1, 2, 3, 4]), np.array([3, 4])
    assert lm.contexts(ids, ends, 9).tolist() == [[9, 9], [1, 9], [2, 1], [9, 9]]


def test_tokens_of_many_texts_are_those_of_each():
    rng = random.Random(9)
    signs = [chr(c) for c in range(128)] + list("  \nA\x85\xa0İé")
    texts = ["", None, " ", "a", " A", "a ", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(2000))]
    expected = [lm.tokens_of(text) for text in texts]
    pieces = list(lm._pieces(pa.array(texts), 300))
    assert len(pieces) > 50 and pa.concat_arrays(pieces).to_pylist() == texts
    for some in pieces:
        words, places, ends = lm._tokenized(some)
        words = words.to_pylist()
        assert len(set(words)) == len(words)  # a word is looked up once, however often it occurs
        cuts = [0, *ends.tolist()]
        found = [[words[i] for i in places[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        assert found == expected[: len(some)]
        del expected[: len(some)]


@pytest.mark.parametrize("most", [lm.MAX_COUNTED, 40])
def test_words_are_counted_in_pieces(most):
    texts = [f"a B{i % 30} c{i} a" for i in range(1000)]
    sent = list(lm._counted([pa.record_batch({"text": texts[:600]}), pa.record_batch({"text": texts[600:]})], most, 200))
    counts = Counter()
    for batch in sent:
        for row in batch.to_pylist():
            counts[row["word"]] += row["n"]
    assert counts == Counter(t for text in texts for t in lm.tokens_of(text))
    # Words are sent when many are held, and what is sent names each once.
    assert all(len(set(b.column("word").to_pylist())) == b.num_rows for b in sent) and (len(sent) > 1) == (most == 40)


def test_a_model_takes_little_memory_beside_its_table():
    log_unigram = np.log(np.full(20_000, 1 / 20_000))
    tracemalloc.start()
    try:
        model = lm.Model(log_unigram)
        size, peak = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        lm.Model(log_unigram, rows=model.rows)
        with_rows = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * model.rows.nbytes and with_rows < size + 0.5 * model.rows.nbytes


def test_steps_prepared_together_are_those_one_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50, 5 * lm.BATCH + 100) ** 2 // 50
    before = lm.contexts(ids, np.array([700, len(ids)]), 50)
    found = []
    for steps in (lm.STEPS, 2, 1):
        monkeypatch.setattr(lm, "STEPS", steps)
        trainer = lm.Trainer(lm.Model(np.log(np.full(50, 1 / 50))))
        trainer.learn(before, ids)
        found.append(trainer.table.copy())
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()


def test_lm_on_odd_rows(spark, odd, none):
    fitted = lm.fit(spark, odd.select("text"))
    rows = lm.score(odd, *fitted).collect()
    assert len(rows) == 7 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    empty = lm.fit(spark, none.select("text"))
    assert lm.score(none, *empty).count() == 0
    assert [r.base_score for r in lm.score(odd.filter("doc_id = 2"), *empty).collect()] == [0.0]


def test_pipeline_stages(spark, odd):
    folder = SF
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == odd.columns, name
        docs.count()
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, odd.limit(0), folder)
        assert empty.count() == 0, name


def test_pipeline_gives_each_row_its_place_in_training(spark, documents):
    docs = spark.createDataFrame(documents)
    plan = mixing.mix(docs).collect()
    expected = [i for _, _, i in sorted((t, r.draw, r.doc_id) for r in plan for t in r.positions)]
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "7",
        "spark.sql.files.maxRecordsPerFile": "20",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        mixed = corpus_pipeline.stored(corpus_pipeline.mix_sources(spark, docs, SF), "mixed")
        assert len(mixed.inputFiles()) > 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = corpus_pipeline.encode_tokens(spark, mixed, SF).collect()
    assert len({r.position for r in rows}) == len(rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == expected


def test_pipeline_runs(spark, documents, library):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = set(documents.doc_id)
    times = Counter(r.doc_id for r in rows)
    assert rows and set(times) <= texts and max(times.values()) <= 2
    for r in rows:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_the_model_does_not_depend_on_partitions(spark):
    """Held-out gain over the unigrams, in nats a token, for one file and for many."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    held_out = remainder(F.col("doc_id"), 10) == 0
    gains = []
    for partitions in (1, 16):
        dealt = docs.repartition(partitions, "doc_id")
        fitted = lm.fit(spark, dealt.filter(~held_out).select("text"))
        sums = lm.score(dealt.filter(held_out), *fitted).agg(
            F.sum(F.col("score") - F.col("base_score")).alias("gain"), F.sum("n_tokens").alias("n")
        )
        found = sums.first()
        gains.append(found.gain / found.n * math.log(10))
    assert min(gains) > 0.5 and max(gains) < 1.1 * min(gains)
