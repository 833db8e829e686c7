"""Stretches of words that repeat with a period, and texts without the repeats.

A text becomes an array of word numbers. Longest common extensions (how far two
positions agree) come from a difference cover: only suffixes that start at a
sixth of all positions are sorted, two positions are compared word by word until
both stand on such a sample, fewer than ``MODULUS`` words on, and from there the
least common prefix between the two in sorted order tells the rest, by a sparse
table. A run of period q and at least 4q words holds a multiple of 3q at which
the words q apart agree, so a harmonic grid of n/3q places for every q finds all
runs in about n log n comparisons, and two extensions from a place, one
forward and one backward, give the whole run.

Nothing is shuffled: a text is a row, and texts are handled some at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import table, words_of

# Each remainder of 31 is a difference of two of these.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# A stretch of 4q words has 3q places whose word is that q places on.
GRID = LEAST_EXPONENT - 1

# Words handled at a time, or one text.
BATCH_WORDS = 1 << 18

COLUMNS = (
    "doc_id {kind}, n_runs long, start long, length long, period long, "
    "exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)


class Extensions:
    """How far the words from two positions on are the same.

    ``words`` are numbers, with one at the end that is nowhere else.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        covered = np.zeros(MODULUS, dtype=bool)
        covered[list(COVER)] = True
        # By difference: a remainder r for which r and r + difference are samples.
        self.meeting = np.array(
            [next(r for r in COVER if covered[(r + d) % MODULUS]) for d in range(MODULUS)]
        )
        self.at = np.flatnonzero(covered[np.arange(len(words)) % MODULUS])
        self.sample = np.full(len(words) + MODULUS, -1, dtype=np.int64)
        self.sample[self.at] = np.arange(len(self.at))
        self._sort()

    def _sort(self) -> None:
        """Rank the samples, and the common prefix of each with the one before."""
        names = np.zeros(len(self.at), dtype=np.int64)
        undecided = np.arange(len(self.at)) if len(self.at) > 1 else np.zeros(0, dtype=np.int64)
        for step in range(MODULUS):
            if not len(undecided):
                break
            names, undecided = _refined(names, undecided, self.words[self.at[undecided] + step])
        # A name now stands for MODULUS words; each round doubles that. Undecided
        # samples agree so far, and so the last, unlike word lies further on.
        levels, reach = [names], MODULUS
        while len(undecided):
            further = names[self.sample[self.at[undecided] + reach]]
            names, undecided = _refined(names, undecided, further)
            levels.append(names)
            reach *= 2
        self.rank = names
        sorted_at = np.empty_like(self.at)
        sorted_at[names] = self.at
        common = self._prefixes(sorted_at[:-1], sorted_at[1:], levels)
        # The least of 1, 2, 4, ... neighbours from each place on.
        self.least, width = [common], 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def _prefixes(self, left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        left, right = left.copy(), right.copy()
        found = np.zeros(len(left), dtype=np.int64)
        for level in range(len(levels) - 1, -1, -1):
            names, reach = levels[level], MODULUS << level
            same = np.flatnonzero(names[self.sample[left]] == names[self.sample[right]])
            for moved in (left, right, found):
                moved[same] += reach
        return found + self._compared(left, right, np.full(len(left), MODULUS))

    def _compared(self, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from here on, at most so many, word by word."""
        found = np.zeros(len(left), dtype=np.int64)
        going = np.flatnonzero(most > 0)
        for step in range(MODULUS):
            if not len(going):
                break
            going = going[self.words[left[going] + step] == self.words[right[going] + step]]
            found[going] += 1
            going = going[most[going] > step + 1]
        return found

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For positions that differ pairwise."""
        gap = (self.meeting[(right - left) % MODULUS] - left) % MODULUS
        found = self._compared(left, right, gap)
        met = np.flatnonzero(found == gap)
        if len(met):
            a = self.rank[self.sample[left[met] + gap[met]]]
            b = self.rank[self.sample[right[met] + gap[met]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp(high - low)[1] - 1
            for k in np.unique(level):
                of = np.flatnonzero(level == k)
                least = np.minimum(self.least[k][low[of]], self.least[k][high[of] - (1 << k)])
                found[met[of]] += least
        return found


def _refined(
    names: np.ndarray, undecided: np.ndarray, keys: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Names told apart by ``keys`` of those that share a name, and who still does.

    A name is the rank of the first that has it, so it need not change for others.
    """
    order = np.lexsort((keys, names[undecided]))
    undecided, keys = undecided[order], keys[order]
    old = names[undecided]
    new_name = np.r_[True, old[1:] != old[:-1]]
    new_key = new_name | np.r_[True, keys[1:] != keys[:-1]]
    place = np.arange(len(old))
    first_of_name = np.maximum.accumulate(np.where(new_name, place, 0))
    first_of_key = np.maximum.accumulate(np.where(new_key, place, 0))
    names = names.copy()
    names[undecided] = old + first_of_key - first_of_name
    alone = new_key & np.r_[new_key[1:], True]
    return names, undecided[~alone]


def grid_places(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on the grids at which words agree, and the period of each.

    ``ends`` and ``sizes`` are of the texts in ``words``, the longest first, so
    that those long enough for a period stand together at the front.
    """
    places, periods = [], []
    period, n_texts = 1, len(sizes)
    while True:
        while n_texts and sizes[n_texts - 1] < max(LEAST_LENGTH, LEAST_EXPONENT * period):
            n_texts -= 1
        if not n_texts:
            break
        end, step = ends[n_texts - 1], GRID * period
        agree = np.flatnonzero(words[: end - period : step] == words[period:end:step])
        if len(agree):
            places.append(agree * step)
            periods.append(np.full(len(agree), period))
        period += 1
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """``start, length, period`` of all runs of each text, by start and period.

    A text is an array of word numbers from 0 up. A run is a stretch with
    smallest period q and at least max(6, 4q) words that no neighbouring word
    extends.
    """
    longest_first = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in longest_first], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros((0, 3), dtype=np.int64) for _ in texts]
    # Between texts and at both ends a number that is nowhere else.
    separator = 1 + max(int(texts[i].max()) for i in longest_first if len(texts[i]))
    parts = [np.array([separator])]
    for k, i in enumerate(longest_first, start=1):
        parts += [texts[i], np.array([separator + k])]
    words = np.concatenate(parts).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes

    place, period = grid_places(words, ends, sizes)
    empty = np.zeros((0, 3), dtype=np.int64)
    found: list[np.ndarray] = [empty for _ in texts]
    if not len(place):
        return found
    forward = Extensions(words)(place, place + period)
    last = len(words) - 1
    backward = Extensions(words[::-1].copy())(last - place + 1, last - place - period + 1)
    start, length = place - backward, backward + period + forward
    fits = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    start, length, period = start[fits], length[fits], period[fits]
    # A run turns up once per place on it, and with multiples of its period,
    # which span the same stretch.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    runs = np.stack([start[first], length[first], period[first]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text_of = np.searchsorted(ends, runs[:, 0], side="right")
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for k, i in enumerate(longest_first):
        own = runs[cuts[k] : cuts[k + 1]]
        found[i] = own - np.array([starts[k], 0, 0])
    return found


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words that ``op11`` judges: every tenth text gets a long repetition."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words without those that any run repeats after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def batches_of(rows: Iterable, size, most: int = BATCH_WORDS) -> Iterator[list]:
    """Lists of rows with up to about ``most`` words, one row at least."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def runs_of(lists: list[list[str]]) -> list[np.ndarray]:
    """:func:`find_runs` of texts given as words."""
    numbers: dict[str, int] = {}
    texts = [
        np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        for words in lists
    ]
    return find_runs(texts)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _summary(words: list[str], runs: np.ndarray) -> tuple:
    listed = runs.tolist()
    best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    return (len(listed), *top, _sha256(lines), _sha256(" ".join(collapsed(words, runs))))


def detect_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """A row per row of ``docs`` with its runs; needs ``doc_id`` and ``text``.

    ``n_runs``; ``start, length, period, exponent_milli`` of the run with most
    repetitions (ties: the first, then the shorter period; NULL without runs);
    hashes of all runs and of the text without what they repeat.
    ``prepare(words, doc_id)`` may change the words first. NULL and empty texts
    have no words and no runs; rows that repeat an id are judged each; other
    columns are not read.
    """

    def judged(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = zip(ids, batch.column("text"), strict=True)

            def split(row):
                words = words_of(row[1].as_py() or "")
                return row[0], prepare(words, row[0]) if prepare else words

            for some in batches_of(map(split, rows), lambda row: len(row[1])):
                found = runs_of([words for _, words in some])
                yield pa.RecordBatch.from_pylist(
                    [
                        dict(zip(names, (doc_id, *_summary(words, runs)), strict=True))
                        for (doc_id, words), runs in zip(some, found, strict=True)
                    ],
                    schema=result.with_metadata(None).set(0, pa.field("doc_id", batch.column("doc_id").type)),
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = COLUMNS.format(kind=kind)
    names = [column.split()[0] for column in columns.split(", ")]
    result = pa.schema(
        [pa.field(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]
    )
    return docs.select("doc_id", "text").mapInArrow(judged, columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_runs(table(spark, sf_dir, "documents"), planted)
