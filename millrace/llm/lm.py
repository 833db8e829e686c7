"""Score texts with a log-bilinear language model.

The words before a token give a vector, the sum of a vector per word and
distance; its product with a token's vector, plus a bias, is the token's score.
Tokens stand in blocks: a token's probability is that of its block among all
blocks times its own within the block, both normalised exactly, so a token costs
the square root of the vocabulary. Training is noise-contrastive: tell the block
and the token that followed from ones drawn at random. Every task trains on the
text of its partition, from the same start, and the results are averaged by how
often each row of parameters was used, so all text is learned from and no task
or driver gathers it.

Every word is modelled, as token and as context. The most frequent have entries
of their own; the others share entries by hash, whose number grows with the
square root of that of such words. What a shared entry is given is dealt to its
words by unigram counts, which are exact for every word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat
from math import ceil, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import remainder, stored, table

# Words with an entry of their own, whose counts every task holds: bounded in
# number and length, whatever the corpus.
HEAD = 131_072
HEAD_CHARS = 64
# Shared entries per square root of the number of other words.
SHARED = 16
SIZE = 16
CONTEXT = 2
NOISE = 24
BATCH = 512
# Steps prepared at a time.
STEPS = 64
EPOCHS = 1
RATE = 0.1
# Training starts from the last average so often, with about so many tokens a task.
ROUNDS = 2
TASK_TOKENS = 5_000_000
SEED = 4
LEAST_SQUARE = 1e-6
# Bytes of text handled at a time (of prose about 150,000 tokens), different words
# counted before they are sent.
CHUNK_BYTES = 1_000_000
MAX_COUNTED = 300_000
SMOOTHING = 0.1
# The end of a text is a token; no word is empty.
END = b""
# Rows of parameters sent in one row.
PART = 1024


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end; bytes know no other letters."""
    tokens = (text or "").encode().lower().split()
    tokens.append(END)
    return tokens


def _tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What ``tokens_of`` gives for each text, put end to end: the different tokens,
    each token's place among them, and where each text ends."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # A space at the end is followed by an empty word, which is the end's token.
    spaced = pc.binary_join_element_wise(texts, "", " ")
    tokens = pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, spaced))
    ends = np.cumsum(tokens.value_lengths().to_numpy(), dtype=np.int64)
    tokens = tokens.flatten().dictionary_encode()
    return tokens.dictionary.cast(pa.binary()), tokens.indices.to_numpy(), ends


def _pieces(texts: pa.Array, chunk: int = CHUNK_BYTES):
    """Consecutive texts, about ``chunk`` bytes at a time."""
    reach = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy() + 1, dtype=np.int64)
    start = 0
    while start < len(texts):
        done = reach[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, done + chunk, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def count_words(texts: DataFrame) -> DataFrame:
    """``word binary, n`` for every token of a table of one text column."""
    counted = texts.mapInArrow(_counted, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(batches, most: int = MAX_COUNTED, chunk: int = CHUNK_BYTES):
    """``word, n`` of the tokens in batches of one text column, sent when ``most`` are held."""

    def summed(counts):
        # One thread, as a task has one core.
        sums = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"])

    held, size = [], 0
    for batch in batches:
        for some in _pieces(batch.column(0), chunk):
            words, places, _ = _tokenized(some)
            held.append(pa.table({"word": words, "n": np.bincount(places)}))
            size += len(words)
            if size >= 2 * most:
                held = [summed(held)]
                size = len(held[0])
            if len(held) == 1 and size >= most:
                yield from held[0].combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from summed(held).combine_chunks().to_batches()


@dataclass
class Head:
    """Exact counts of the most frequent tokens; the first have entries of the
    model. ``others`` are the smoothed counts of the entries that words share."""

    ids: dict[bytes, int]
    counts: np.ndarray
    train_tokens: int
    distinct: int
    vocabulary: int
    others: np.ndarray | None = None

    @property
    def total(self) -> float:
        """What the smoothed counts of all tokens, and one unseen, sum to."""
        return self.train_tokens + SMOOTHING * (self.distinct + 1)

    def log_unigram(self) -> np.ndarray:
        """Natural logarithm per entry, shared ones last; each has one unseen word."""
        mass = np.append(self.counts[: self.vocabulary] + SMOOTHING, self.others)
        return np.log(mass / self.entries_total(len(self.others)))

    def entries_total(self, shared: int) -> float:
        return self.train_tokens + SMOOTHING * (self.distinct + shared)

    def entries(self, shared: int) -> np.ndarray:
        """The entry of each of the head's words."""
        rest = list(self.ids)[self.vocabulary :]
        own = np.arange(self.vocabulary)
        return np.append(own, [self.vocabulary + crc32(w) % shared for w in rest]).astype(np.int64)


def _least_count(counts: DataFrame, head: int) -> int:
    """A count that ``head`` words and not many more reach, or 0.

    From the numbers of words by powers of 2 to the eighth, so that it is no task's
    work to find the most frequent words among all of its own.
    """
    step = F.floor(F.log2("n") * 8)
    bins = (
        counts.filter(F.octet_length("word") <= HEAD_CHARS)
        .groupBy(step.alias("step"))
        .agg(F.count("*").alias("words"), F.min("n").alias("least"))
        .collect()
    )
    words = 0
    for row in sorted(bins, key=lambda row: -row.step):
        words += row.words
        if words >= head:
            return row.least
    return 0


def head_of(counts: DataFrame, vocabulary: int = HEAD, head: int = HEAD) -> Head:
    """``counts`` has ``word, n``. A longer word is looked up like a rare one."""
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    rows = (
        counts.filter((F.octet_length("word") <= HEAD_CHARS) & (F.col("n") >= _least_count(counts, head)))
        .orderBy(F.desc("n"), "word")
        .limit(head)
        .toArrow()
    )
    words = [bytes(word) for word in rows.column("word").to_pylist()]
    n = rows.column("n").to_numpy()
    vocabulary = min(vocabulary, len(words))
    shared = max(1, ceil(SHARED * sqrt(sums.words - vocabulary)))
    # All words by hash, less those with an entry of their own: whole numbers.
    by_hash = (
        counts.groupBy((F.crc32("word") % shared).alias("entry"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("words"))
        .toArrow()
    )
    sizes = np.zeros((shared, 2), dtype=np.int64)
    sizes[by_hash.column("entry").to_numpy()] = np.stack(
        [by_hash.column("n").to_numpy(), by_hash.column("words").to_numpy()], axis=1
    )
    for word, times in zip(words[:vocabulary], n[:vocabulary].tolist(), strict=True):
        sizes[crc32(word) % shared] -= (times, 1)
    return Head(
        {word: i for i, word in enumerate(words)},
        n.astype(float),
        sums.n or 0,
        sums.words,
        vocabulary,
        sizes[:, 0] + SMOOTHING * (sizes[:, 1] + 1),
    )


class Model:
    """Entries of tokens, in blocks; as context there is one more,
    for what lies before the text.

    All parameters are rows of one table: blocks, entries, and entries as context
    at each distance. The last place of a row is the bias; contexts have 0 there.
    """

    def __init__(
        self, log_unigram: np.ndarray, size: int = SIZE, seed: int = 3, rows: np.ndarray | None = None
    ):
        """With the parameters ``rows``, or as they are before training."""
        n = len(log_unigram)
        self.noise = log_unigram
        # A case costs a product per block and per entry of its block: for the least
        # sum a block has as many entries as 1 / sqrt(share of one of them).
        share = np.exp(log_unigram)
        _, first, self.block_of = np.unique(
            np.floor(np.cumsum(np.sqrt(share))), return_index=True, return_inverse=True
        )
        self.blocks = len(first)
        self.block_noise = np.log(np.add.reduceat(share, first))
        # Rows of each block's entries begin here, and end with the next one's.
        self.cuts = self.blocks + np.append(first, n)
        # The first row of contexts at each distance.
        self.at = self.blocks + n + np.arange(CONTEXT) * (n + 1)
        if rows is None:
            rows = np.zeros((self.blocks + n + CONTEXT * (n + 1), size + 1), dtype=np.float32)
            random = np.random.default_rng(seed)
            # Part by part, as a task has little memory beside the table.
            for i in range(0, len(rows), PART):
                some = rows[i : i + PART, :-1]
                some[:] = random.standard_normal(some.shape, dtype=np.float32) * 0.1
            rows[: self.blocks + n, -1] = np.append(self.block_noise, log_unigram)
        self.rows = rows

    @property
    def start(self) -> int:
        return len(self.noise)

    @property
    def width(self) -> int:
        return self.rows.shape[1]

    def parameters(self) -> np.ndarray:
        return self.rows.ravel()

    def set_parameters(self, flat: np.ndarray) -> None:
        self.rows = flat.reshape(self.rows.shape)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        vector = sum(self.rows.take(self.at[k] + before[:, k], axis=0) for k in range(CONTEXT))
        vector[:, -1] = 1
        return vector

    def coded(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Each case as one number, of 64 bits up to two million entries."""
        width = self.start + 1
        return sum(before[:, k] * width ** (k + 1) for k in range(CONTEXT)) + token

    def split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest, token = np.divmod(codes, self.start + 1)
        before = np.empty((CONTEXT, len(codes)), dtype=np.int64)
        for k in range(CONTEXT):
            rest, before[k] = np.divmod(rest, self.start + 1)
        return before.T, token

    def log_probability(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Equal cases are computed once."""
        codes, back = np.unique(self.coded(before, token), return_inverse=True)
        before, token = self.split(codes)
        # Cases come sorted by context, so that each context is a run of them.
        context = codes // (self.start + 1)
        new = np.append(True, context[1:] != context[:-1])[: len(codes)]
        of_context = self.predicted(before[new])
        of_blocks = _log_sum(of_context, self.rows[: self.blocks])
        # Then by block. The sort of small numbers is much the faster one.
        block = self.block_of.take(token)
        order = np.argsort(block.astype(np.min_scalar_type(self.blocks)), kind="stable")
        block, token, context = block.take(order), token.take(order), (np.cumsum(new) - 1).take(order)
        vector, log_z = of_context.take(context, axis=0), of_blocks.take(context)
        cuts = np.searchsorted(block, np.arange(self.blocks + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            cases = slice(cuts[b], cuts[b + 1])
            log_z[cases] += _log_sum(vector[cases], self.rows[self.cuts[b] : self.cuts[b + 1]])
        rows = self.rows.take(block, axis=0)
        rows += self.rows.take(self.blocks + token, axis=0)
        found = np.empty(len(codes))
        found[order] = np.einsum("ij,ij->i", vector, rows) - log_z
        return found.take(back)


def _log_sum(vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of the exponentials of each vector's products."""
    found = np.empty(len(vector), dtype=np.float32)
    ones, step = np.ones(len(rows), dtype=np.float32), max(64, (1 << 16) // len(rows))
    held = np.empty((min(step, len(vector)), len(rows)), dtype=np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(0, len(vector), step):
            some = vector[i : i + step]
            scores = np.matmul(some, rows.T, out=held[: len(some)])
            np.matmul(np.exp(scores, out=scores), ones, out=found[i : i + step])
        np.log(found, out=found)
    # Sums beyond what a float holds are shifted by the largest product.
    odd = np.flatnonzero(~np.isfinite(found))
    if len(odd):
        scores = vector[odd] @ rows.T
        top = scores.max(axis=1)
        found[odd] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return found


class Trainer:
    """Noise-contrastive steps with a rate per parameter."""

    def __init__(self, model: Model, seed: int = SEED):
        self.model, self.random = model, np.random.default_rng(seed)
        # The model's rows and, beside each, the sums of its squared slopes.
        self.table = np.full((len(model.rows), 2 * model.width), LEAST_SQUARE, dtype=np.float32)
        self.table[:, : model.width] = model.rows
        model.rows, self.squares = self.table[:, : model.width], self.table[:, model.width :]
        # A row of the table as one value, which is stored in one piece.
        self.whole = self.table.view(f"V{self.table.strides[0]}").ravel()
        # How often each row of parameters was used.
        self.used = np.zeros(len(model.rows), dtype=np.float32)
        self.shares = [np.cumsum(np.exp(noise)) for noise in (model.block_noise, model.noise)]
        expected = np.append(model.block_noise, model.noise) + np.log(NOISE)
        self.expected = expected.astype(np.float32)

    def learn(self, before: np.ndarray, token: np.ndarray) -> None:
        """Equal cases are counted once and weighed, in an order drawn at random."""
        codes, times = np.unique(self.model.coded(before, token), return_counts=True)
        before, token = self.model.split(codes)
        model, times = self.model, times.astype(np.float32)
        # Per case the rows of its block, its token and its context.
        rows = np.column_stack([model.block_of[token], model.blocks + token, model.at + before])
        rows = rows.astype(np.int32)
        for _ in range(EPOCHS):
            order = self.random.permutation(len(token))
            rows, times = rows.take(order, axis=0), times.take(order)
            noise = self.noise_rows(ceil(len(token) / BATCH))
            # Steps of full batches some at a time, then the rest.
            full = len(token) // BATCH
            cuts = [*range(0, full, STEPS), full, len(noise)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                cases = slice(first * BATCH, last * BATCH)
                if last > first:
                    self.steps(
                        rows[cases].reshape(last - first, -1, rows.shape[1]),
                        noise[first:last],
                        times[cases].reshape(last - first, -1),
                    )
            used = np.append(rows.ravel(), noise.ravel())
            self.used += np.bincount(used, minlength=len(self.used))

    def noise_rows(self, steps: int) -> np.ndarray:
        """For each step the rows of blocks, then of tokens, drawn by their shares."""
        drawn = [
            np.searchsorted(c, self.random.random((steps, NOISE)) * c[-1], side="right").clip(max=len(c) - 1)
            for c in self.shares
        ]
        return np.concatenate([drawn[0], self.model.blocks + drawn[1]], axis=1).astype(np.int32)

    def steps(self, cases: np.ndarray, noise: np.ndarray, weight: np.ndarray) -> None:
        """A step per first index. Which rows each needs, and how often, is found for all at once."""
        by_kind, n = cases.transpose(0, 2, 1), len(cases)
        true = by_kind[:, :2].reshape(n, -1)
        at = np.concatenate([true, noise, by_kind[:, 2:].reshape(n, -1)], axis=1)
        order = np.argsort(at, axis=1)
        ranked = np.take_along_axis(at, order, axis=1)
        new = np.ones(at.shape, dtype=bool)
        new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        # Places that share their row with a neighbour.
        shared = ~new
        shared[:, :-1] |= shared[:, 1:]
        rank = np.cumsum(new, axis=1) - 1
        place = np.empty_like(rank)
        np.put_along_axis(place, order, rank, axis=1)
        weight = weight / weight.sum(axis=1, keepdims=True)
        of_true, of_noise = self.expected[true], self.expected[noise]
        with np.errstate(over="ignore"):
            for k in range(n):
                first, several = np.flatnonzero(new[k]), np.flatnonzero(shared[k])
                starts = np.flatnonzero(new[k].take(several))
                sums = order[k].take(first), order[k].take(several), starts, rank[k].take(several.take(starts))
                self.step(ranked[k].take(first), place[k], sums, weight[k], of_true[k], of_noise[k])

    def step(
        self,
        used: np.ndarray,
        place: np.ndarray,
        sums: tuple[np.ndarray, ...],
        weight: np.ndarray,
        of_true: np.ndarray,
        of_noise: np.ndarray,
    ) -> None:
        """One set of noise blocks and one of noise tokens serve the whole batch."""
        model, n, m = self.model, len(weight), len(of_noise)
        # The table is large: each of its rows is fetched and stored once a step.
        near = self.whole.take(used).view(np.float32).reshape(len(used), -1)
        near, squares = near[:, : model.width].copy(), near[:, model.width :].copy()

        fetched = near.take(place, axis=0)
        vector = sum(fetched[i : i + n] for i in range(2 * n + m, len(place), n))
        vector[:, -1] = 1
        twice = np.concatenate([vector, vector])
        true_rows, noise_rows = fetched[: 2 * n], fetched[2 * n : 2 * n + m]

        off_true = _share(of_true - np.einsum("ij,ij->i", twice, true_rows)) - 1
        off_true *= np.concatenate([weight, weight])
        off_noise = vector @ noise_rows.T
        off_noise = _share(np.subtract(of_noise, off_noise, out=off_noise))
        off_noise *= weight[:, None]

        twice *= off_true[:, None]
        true_rows *= off_true[:, None]
        d_vector = off_noise @ noise_rows
        d_vector += true_rows[:n]
        d_vector += true_rows[n:]
        d_vector[:, -1] = 0
        d = np.concatenate([twice, off_noise.T @ vector, *[d_vector] * CONTEXT])
        d = _sums(d, *sums)
        squares += d * d
        d *= RATE
        d /= np.sqrt(squares)
        near -= d
        table = np.concatenate([near, squares], axis=1)
        self.whole.put(used, table.view(self.whole.dtype).ravel())


def _sums(
    rows: np.ndarray, first: np.ndarray, several: np.ndarray, starts: np.ndarray, place: np.ndarray
) -> np.ndarray:
    """``rows[first]``; but those at ``place`` are sums of ``rows[several]`` from ``starts`` on."""
    sums = rows.take(first, axis=0)
    if len(starts):
        sums[place] = np.add.reduceat(rows.take(several, axis=0), starts, axis=0)
    return sums


def _share(minus: np.ndarray) -> np.ndarray:
    """The logistic function of ``-minus``, in its place."""
    np.exp(minus, out=minus)
    minus += 1
    return np.reciprocal(minus, out=minus)


def contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """For each token of texts put end to end the tokens before it, nearest first."""
    before = np.full((CONTEXT, len(ids)), start, dtype=np.int64)
    first = np.append(0, ends[:-1])
    for k in range(1, CONTEXT + 1):
        before[k - 1, k:] = ids[:-k]
        for place in range(k):
            # Beyond a shorter text this is a place of the next one that is as near its start.
            at = first + place
            before[k - 1, at[at < len(ids)]] = start
    return before.T


def _numbered(words: pa.Array, ids: dict[bytes, int], shared: int) -> np.ndarray:
    """Numbers of the head's words; others have -1 less their shared entry."""
    words = words.to_numpy(zero_copy_only=False).tolist()
    numbers = np.fromiter(map(ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    others = np.flatnonzero(numbers < 0)
    numbers[others] = [-1 - crc32(words[i]) % shared for i in others.tolist()]
    return numbers


def _entries(numbers: np.ndarray, of_head: np.ndarray, vocabulary: int) -> np.ndarray:
    # Any place of the head's for words outside of it; there may be none.
    known = np.append(of_head, 0)[np.maximum(numbers, -1)]
    return np.where(numbers >= 0, known, vocabulary - 1 - numbers)


def train(texts: DataFrame, head: Head, rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> Model:
    """Models that tasks train on shares of ``texts``, averaged in each round.

    A round takes the next share of the texts and starts from the last average.
    A task gets about ``task_tokens`` tokens, however the texts are dealt to
    files: few tokens would leave a model close to where it began. It sends the
    rows of parameters that it used, in parts, and how often it used each; a
    row's average is weighed by that. Unused rows stay as they were.
    """
    log_unigram = head.log_unigram()
    tasks = max(1, ceil(head.train_tokens / rounds / task_tokens))
    model, squares = Model(log_unigram), None
    for number in range(rounds):
        share = texts.filter(F.pmod(F.xxhash64(texts.columns[0]), F.lit(rounds)) == number)
        found = _trained(share.coalesce(tasks), head, model if number else None, squares, number)
        if squares is None:
            squares = np.full(len(model.rows), LEAST_SQUARE, dtype=np.float32)
        for part, rows in zip(*(c.to_pylist() for c in found.columns), strict=True):
            places, rows, square, _ = _received(rows)
            model.rows[part * PART + places] = rows
            squares[part * PART + places] = square
    return model


def _trained(
    texts: DataFrame, head: Head, start: Model | None, squares: np.ndarray | None, number: int
) -> pa.Table:
    """Rows of parameters by part, averaged over the tasks that ``texts`` has."""
    log_unigram, held, shared = head.log_unigram(), head, len(head.others)
    rows_before = None if start is None else start.rows

    def learn(batches):
        ids, of_head = held.ids, held.entries(shared)
        trainer = Trainer(Model(log_unigram, rows=rows_before), SEED + number)
        if squares is not None:
            trainer.squares[:] = squares[:, None]
        for batch in batches:
            for some in _pieces(batch.column(0)):
                words, places, ends = _tokenized(some)
                entries = _entries(_numbered(words, ids, shared), of_head, held.vocabulary).take(places)
                trainer.learn(contexts(entries, ends, trainer.model.start), entries)
        rows, used, square = trainer.model.rows, trainer.used, trainer.squares.mean(axis=1)
        for part, i in enumerate(range(0, len(rows), PART)):
            own = slice(i, i + PART)
            if used[own].any():
                yield _sent(part, rows[own], square[own], used[own])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places, rows, square, times = _received(sent)
                if part not in sums:
                    sums[part] = np.zeros((PART, rows.shape[1] + 1)), np.zeros(PART)
                sums[part][0][places] += np.column_stack([rows, square]) * times[:, None]
                sums[part][1][places] += times
        for part, (values, times) in sums.items():
            values /= np.maximum(times, 1)[:, None]
            yield _sent(part, values[:, :-1], values[:, -1], times)

    kind = "part int, rows binary"
    return texts.mapInArrow(learn, kind).repartition("part").mapInArrow(add, kind).toArrow()


def _sent(part: int, rows: np.ndarray, square: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    """The used rows of a part: place in it, values, mean square, times used."""
    places = np.flatnonzero(used)
    values = np.column_stack([places, rows[places], square[places], used[places]]).astype(np.float32)
    columns = [pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "rows"])


def _received(values: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(values, dtype=np.float32).reshape(-1, SIZE + 4)
    return rows[:, 0].astype(np.int64), rows[:, 1:-2], rows[:, -2], rows[:, -1]


ROW = (
    "n_tokens bigint, n_known bigint, base double, neural double, other double, "
    "rare array<binary>, rare_times array<int>"
)


def _rows_scored(docs: DataFrame, head: Head, model: Model) -> DataFrame:
    """Per row what the head's counts and the model say, and its other words.

    ``base`` sums log10 of the smoothed counts, ``neural`` of the model's
    probabilities, for a word of a shared entry per smoothed count of the entry,
    and ``other`` of the smoothed counts of such words.
    """
    log_unigram, rows = model.noise, model.rows
    held, shared = head, model.start - head.vocabulary
    log_mass = np.log10(head.entries_total(shared)) + log_unigram / np.log(10)
    log_mass[: head.vocabulary] = 0.0

    def score(batches):
        ids, of_head = held.ids, held.entries(shared)
        model = Model(log_unigram, rows=rows)
        log_count = np.append(np.log10(held.counts + SMOOTHING), 0.0)  # the last: not here
        for batch in batches:
            done = 0
            for some in _pieces(batch.column("text")):
                words, places, ends = _tokenized(some)
                numbers = _numbered(words, ids, shared)
                of_word = _entries(numbers, of_head, held.vocabulary)
                entries, starts = of_word.take(places), np.concatenate([[0], ends[:-1]])
                before = contexts(entries, ends, model.start)
                neural = model.log_probability(before, entries) / np.log(10) - log_mass.take(entries)
                counted = log_count[np.maximum(numbers, -1)]
                shares = np.where(of_word >= held.vocabulary, counted, 0.0)
                total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                # Words outside of the head, once per text.
                outside = np.flatnonzero((numbers < 0).take(places))
                text_of = np.searchsorted(ends, outside, side="right")
                rare, times = np.unique(text_of * len(words) + places[outside], return_counts=True)
                cuts = pa.array(np.searchsorted(rare, np.arange(len(ends) + 1) * len(words)), pa.int32())
                rare = words.take(pa.array(rare % len(words)))
                columns = [
                    pa.array(ends - starts, pa.int64()),
                    pa.array(total((numbers >= 0).astype(np.int64).take(places)), pa.int64()),
                    pa.array(total(counted.take(places))),
                    pa.array(total(neural)),
                    pa.array(total(shares.take(places))),
                    pa.ListArray.from_arrays(cuts, rare),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                ]
                names = [part.split()[0] for part in ROW.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, len(some)), *columns], ["doc_id", *names]
                )
                done += len(some)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {ROW}")


def score(docs: DataFrame, counts: DataFrame, head: Head, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``, a row per
    row of ``docs``; scores are log10 probabilities of whole texts.

    Counts of words outside of the head are joined; none of them is frequent,
    so no key of that join is large. NULL and empty texts are their end alone.
    Rows that repeat an id are scored each. Other columns are not read.
    """
    # Numbered when written: from then on a row keeps its number.
    rows = stored(
        _rows_scored(docs, head, model).withColumn("row", F.monotonically_increasing_id()), "lm-rows"
    )
    rare = rows.select(
        "row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_times").alias("times"))).alias("r")
    ).select("row", "r.word", "r.times")
    found = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("rare_log"),
        )
    )
    known, log = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    log_total = float(np.log10(head.total))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + known).cast("long").alias("n_known"),
        F.lit(head.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("neural") + F.col("other") + log).alias("score"),
    )


def fit(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, Head, Model]:
    """Counts, their head, and the model, from a table of one text column.

    An empty table gives a model that knows only "another token".
    """
    counts = stored(count_words(texts), "word-counts")
    head = head_of(counts)
    return counts, head, train(texts, head)


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 10) == 0
    fitted = fit(spark, docs.filter(~held_out).select("text"))
    return score(docs, *fitted).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
