"""BPE encoding by speculation: guess the tokens, verify, merge only what failed.

The guess is greedy: the longest token at each place. Merging in order of rank
gives the same tokens if, and only if, it would do so for every two neighbours;
that is looked up for all pairs of a batch at once. Words with a pair that
fails are merged step by step.

The words of a text come from the tokenizer file's own rules: NFC, lower case,
a pattern, UTF-8 bytes shown as letters, and an end mark on the last letter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table

# Characters of text handled at a time, and words remembered per task.
CHUNK_CHARS = 2_000_000
MAX_REMEMBERED = 500_000
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next
    unused one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def first_characters(kind: str) -> str:
    """Those of a Unicode category, or white space, below 256, for a pattern's set."""
    found = [
        chr(c)
        for c in range(256)
        if (kind == "white" and regex.match(r"\p{White_Space}", chr(c)))
        or unicodedata.category(chr(c))[0] == kind
    ]
    return "".join(map(re.escape, found))


class _Lower(dict):
    """Lower case one character at a time, whatever stands beside it."""

    def __missing__(self, code: int) -> str:
        self[code] = low = chr(code).lower()
        return low


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *special.values()])
        self.names = [""] * size
        for name, i in chain(self.ids.items(), special.items()):
            self.names[i] = name
        self.special = special
        self.special_at = regex.compile("|".join(map(regex.escape, special))) if special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space as Unicode has it.
        self.words_of = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        # The same for texts of the first 256 characters, which needs no tables.
        for name, kind in ((r"\s", "white"), (r"\p{L}", "L"), (r"\p{N}", "N")):
            pattern = pattern.replace(name, first_characters(kind))
        self.short_words_of = re.compile(pattern).findall
        self.lower = _Lower()
        self.letters = byte_letters()
        self._read_merges([self._pair(m) for m in model["merges"]])
        self._forget()

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        return tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge)

    def _read_merges(self, merges: list[tuple[str, str]]) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        size = len(self.names)
        left, right = np.full(size, -1), np.full(size, -1)
        made_at = np.full(size, -1)
        for rank, (a, b) in enumerate(merges):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = rank
            self.made.append(z)
            left[z], right[z], made_at[z] = x, y, rank
        keys = np.array([x * size + y for x, y in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array(list(self.rank.values()), dtype=np.int64)[order]
        # Column i: the piece of each token at its edge after i splits (-1: none),
        # and the rank at which that piece is merged into a larger one.
        self.right_edge = self._edges(right, made_at)
        self.left_edge = self._edges(left, made_at)
        # A token that merging its own letters does not give is never a guess.
        self.guesses = {
            name: i
            for name, i in self.ids.items()
            if made_at[i] < 0 or self._merge(self._symbols_of(name)) == (i,)
        }
        self.longest = max(map(len, self.guesses), default=0)
        # How long a token can be that begins with these two letters.
        self.reach: dict[str, int] = {}
        for name in self.guesses:
            if not name.endswith(self.end):
                self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 1))

    def _edges(self, part: np.ndarray, made_at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        piece, gone = np.arange(len(part)), np.full(len(part), NO_RANK)
        edges = []
        while (piece >= 0).any():
            edges.append((piece, gone))
            below = np.where(piece >= 0, part[piece], -1)
            gone = np.where(below >= 0, made_at[piece], -1)
            piece = below
        return edges

    def _symbols_of(self, name: str) -> list[int]:
        """Ids of the single letters of a token's name."""
        if name.endswith(self.end) and name != self.end:
            body = name[: -len(self.end)]
            return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + self.end]]
        return [self.ids[c] for c in name]

    def _merge(self, symbols: list[int]) -> tuple[int, ...]:
        """Exact merging: always the lowest rank, of equals the leftmost."""
        get, none = self.rank.get, len(self.made)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            made = self.made[best]
            symbols[i : i + 2] = [made]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], made), none)
            if i < len(ranks):
                ranks[i] = get((made, symbols[i + 1]), none)
        return tuple(symbols)

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact merging of a word in byte letters.

        A word so long that merging it at a glance would take its length
        squared is merged with a heap.
        """
        symbols = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        return self._merge(symbols) if len(symbols) <= 64 else self._merge_long(symbols)

    def _merge_long(self, symbols: list[int]) -> tuple[int, ...]:
        import heapq

        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (self.rank[pair], i, *pair)
            for i, pair in enumerate(zip(symbols, symbols[1:], strict=False))
            if pair in self.rank
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i] if symbols[i] == x else n
            if j >= n or symbols[j] != y:
                continue
            symbols[i], symbols[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (symbols[a], symbols[b]) in self.rank:
                    pair = symbols[a], symbols[b]
                    heapq.heappush(heap, (self.rank[pair], a, *pair))
        return tuple(s for s in symbols if s >= 0)

    def guess(self, word: str) -> list[int]:
        """The longest token at each place of a word in byte letters."""
        found, at, n = [], 0, len(word)
        get, reach = self.guesses.get, self.reach.get
        while at < n:
            if n - at <= self.longest and (i := get(word[at:] + self.end)) is not None:
                found.append(i)
                break
            for stop in range(min(n - 1, at + reach(word[at : at + 2], 1)), at, -1):
                if (i := get(word[at:stop])) is not None:
                    found.append(i)
                    at = stop
                    break
        return found

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between two tokens, for many pairs.

        While a token is built up, its edge is one piece after another. Two
        pieces that face each other merge if their rank is reached before
        either is merged into its own token; at equal ranks the pair further
        left comes first.
        """
        fine = np.ones(len(first), dtype=bool)
        size = len(self.names)
        for pieces, gone in self.right_edge:
            x, x_gone = pieces[first], gone[first]
            if not (x >= 0).any():
                break
            for others, other_gone in self.left_edge:
                y, y_gone = others[second], other_gone[second]
                both = np.flatnonzero((x >= 0) & (y >= 0) & fine)
                if not len(both):
                    break
                keys = x[both] * size + y[both]
                at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)
                fine[both] = (rank == NO_RANK) | (rank >= x_gone[both]) | (rank > y_gone[both])
        return fine

    def learn(self, words: Iterable[str]) -> None:
        """Encode words not met before, all together."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > MAX_REMEMBERED:
            self._forget()
            new = [w for w in words if w not in self.known]
        letters = self.letters
        shown = ["".join([letters[b] for b in w.encode()]) for w in new]
        guessed = list(map(self.guess, shown))
        sizes = np.fromiter(map(len, guessed), dtype=np.int64, count=len(guessed))
        tokens = np.fromiter(chain.from_iterable(guessed), dtype=np.int64, count=sizes.sum())
        word_of = np.repeat(np.arange(len(new)), sizes)
        inner = np.flatnonzero(word_of[:-1] == word_of[1:])
        pairs = tokens[inner] * len(self.names) + tokens[inner + 1]
        different, where = np.unique(pairs, return_inverse=True)
        fine = self._check(different)[where]
        failed = np.zeros(len(new), dtype=bool)
        failed[word_of[inner[~fine]]] = True
        for word, show, guess, fails in zip(new, shown, guessed, failed.tolist(), strict=True):
            self.known[word] = self.merge(show) if fails else tuple(guess)

    def _forget(self) -> None:
        # No other word is spelled like a special token: words are not mixed.
        self.known: dict[str, tuple[int, ...]] = {name: (i,) for name, i in self.special.items()}
        self.checked: dict[int, bool] = {}

    def _check(self, pairs: np.ndarray) -> np.ndarray:
        keys = pairs.tolist()
        new = np.array([k for k in keys if k not in self.checked], dtype=np.int64)
        size = len(self.names)
        self.checked.update(zip(new.tolist(), self.compatible(new // size, new % size).tolist(), strict=True))
        return np.array([self.checked[k] for k in keys], dtype=bool)

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token written out in it is one."""
        if self.special_at is None or not self.special_at.search(text):
            return self._words(text)
        found, at = [], 0
        for m in self.special_at.finditer(text):
            found += self._words(text[at : m.start()])
            found.append(m[0])
            at = m.end()
        return found + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words_of(unicodedata.normalize("NFC", text).translate(self.lower))
        return self.short_words_of(text.lower())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(text or "") for text in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """As the file says: it names no decoder, so names joined by spaces."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded``, a row per row of ``docs``.

    ``vocabulary`` is the tokenizer file, at the same path on every executor.
    NULL and empty texts have no tokens. Rows that repeat an id are encoded
    each. Other columns are not read.
    """

    def run(batches):
        tool = encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, stop in chunks(texts):
                ids = tool.encode(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([tool.decode(row) for row in ids], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string"
    )


def digest(encoded: DataFrame, *columns: str) -> DataFrame:
    """Hashes of ids and decoded text per row, and ``columns`` as they are."""
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *columns,
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents"), default_vocabulary()))
