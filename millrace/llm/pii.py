"""Personal data by weak supervision: labelers vote, their reliabilities are
estimated without labels, and a span classifier is trained on the outcome.

All of it is DataFrame code. What reaches the driver are sums per pattern of
votes and per feature, whose numbers are fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import logistic
from millrace.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "number", "handle")
BASE = 4  # The first four have rules; the others are only ever added.

# The rules' patterns. In Java's engine ++ keeps a loop from going
# back, which here could not help. A run of letters or digits can only match
# from its start, or from where the last match ended (\G): the look-behind says
# so, and spares long runs a try at each place.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates without a rule: seven digits and more, and addresses spelled out.
NUMBER = r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
HANDLE = (
    r"(?:(?<![A-Za-z0-9._-])|\G)[A-Za-z0-9._-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9.-]++"
)
IP_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
IP_PARTS = rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"

# Gazetteers: endings of domains, first digits of cards, calling codes, and
# address blocks that belong to nobody.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl|us|ca|au|in|br|mx)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6011|65)"
CALLING = (
    r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[236]|35[1-9]|38[0-9]|42[01]|97[1-7])"
)
NOBODYS = r"^(?:0|127|2[2-5][0-9])\."
CUES = (
    r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|card|visa|konto|address|reach|write|ring)"
)
CONTEXT_CHARS = 24
# Spans of one text that are taken together; the result does not depend on it.
GROUP = 256

LABELERS = ("rule", "gazetteer", "context", "shape")
ROUNDS = 12
FEATURES = 64

SPOT = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def matches(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add ``name``: all matches of ``pattern`` in ``text`` with their places and
    what stands around them; none where ``guard`` does not hold.

    Spark gives the matches and the pieces between them; adding up lengths
    gives the places, in code points.
    """
    found, gaps, ends = f"{name}_found", f"{name}_gaps", f"{name}_ends"
    none = F.array().cast("array<string>")
    df = df.withColumn(
        found, F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
    ).withColumn(
        gaps, F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none)
    )

    df = df.withColumn(
        ends,
        F.when(
            F.size(found) > 0,
            running_sums(F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))),
        ),
    )

    def spot(match: Column, i: Column) -> Column:
        end = F.get(ends, i)
        return F.struct(
            (end - F.char_length(match)).alias("start"),
            end.alias("end"),
            match.alias("value"),
            F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS)).alias("after"),
        )

    spots = F.when(F.size(found) > 0, F.transform(found, spot)).otherwise(F.array())
    return df.withColumn(name, spots.cast(SPOT)).drop(found, gaps, ends)


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once even if a lambda in it has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(
    items: Column, first: Column, passed: Callable[[Column, Column], Column]
) -> Column:
    """What has gathered after each group of ``GROUP`` items, ``first`` in front.

    ``passed(state, item)`` takes an item in. Appending to an array copies it,
    so a long row is taken group by group: its cost stays near linear.
    """
    kind = "array<int>"
    groups = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int"))
    return F.aggregate(
        groups,
        F.array(first).cast(kind),
        lambda states, g: F.array_append(
            states,
            F.aggregate(F.slice(items, g * GROUP + 1, F.lit(GROUP)), F.element_at(states, -1), passed),
        ),
    )


def running_sums(numbers: Column) -> Column:
    """The sum up to each of an array's whole numbers; the array is not empty."""

    def sums(numbers: Column) -> Column:
        before = scanned(numbers, F.lit(0), lambda total, x: total + x)

        def within(start: Column, g: Column) -> Column:
            return F.aggregate(
                F.slice(numbers, g * GROUP + 1, F.lit(GROUP)),
                F.array(start),
                lambda totals, x: F.array_append(totals, F.element_at(totals, -1) + x),
                lambda totals: F.slice(totals, F.lit(2), F.lit(GROUP)),
            )

        return F.flatten(F.transform(before, within))

    return given(numbers, sums)


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others; every second one counts double."""
    doubled = lambda d: F.translate(d, "0123456789", "0246813579")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s
        + F.when((F.length(digits) - i) % 2 == 1, doubled(F.substr(digits, i, F.lit(1))))
        .otherwise(F.substr(digits, i, F.lit(1)))
        .cast("int"),
    )
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 or -1 as the labeler says, 0 if it says nothing."""
    vote = F.when(yes, 1)
    return (vote.when(no, -1) if no is not None else vote).otherwise(0)


def _judge(kind: int) -> Callable[[Column], Column]:
    return lambda spot: _judged(kind, spot)


def _judged(kind: int, spot: Column) -> Column:
    """A candidate with whether its rule holds, and the labelers' votes."""
    value, digits = spot["value"], _digits(spot["value"])
    n = F.length(digits)
    holds = {
        0: F.lit(True),
        1: value.rlike(IP_PARTS),
        2: n.between(16, 19) & F.coalesce(F.when(n.between(16, 19), luhn(digits)), F.lit(False)),
        3: n.between(8, 15),
    }
    known = {
        0: value.rlike(DOMAINS),
        1: ~value.rlike(NOBODYS),
        2: digits.rlike(ISSUERS),
        3: digits.rlike(CALLING),
        4: digits.rlike(CALLING) & n.between(10, 13),
        5: value.rlike(DOMAINS),
    }
    letter_beside = spot["before"].rlike("[A-Za-z0-9]$") | spot["after"].rlike("^[A-Za-z0-9]")
    same = digits.rlike(r"^([0-9])\1{7,18}$")
    plausible = {0: F.lit(True), 1: F.lit(True), 5: F.lit(True)}.get(kind, n.between(8, 19) & ~same)
    rule = _vote(holds[kind], ~holds[kind]) if kind in holds else F.lit(0)
    votes = F.array(
        rule,
        _vote(known[kind], ~known[kind]),
        _vote(spot["before"].rlike(CUES)),
        _vote(plausible & ~letter_beside, letter_beside | ~plausible),
    )
    return F.struct(
        F.lit(kind).alias("kind"),
        spot["start"].alias("start"),
        spot["end"].alias("end"),
        holds.get(kind, F.lit(False)).alias("base"),
        votes.alias("votes"),
        F.least(n, F.lit(20)).alias("n_digits"),
        F.least(F.length(value), F.lit(40)).alias("n_chars"),
        letter_beside.alias("beside"),
    )


def features(span: Column) -> Column:
    """Feature numbers of a candidate, from 1 to ``FEATURES``."""
    votes = [span["votes"][i] + (10 + 3 * i) for i in range(len(LABELERS))]
    return F.array(
        span["kind"] + 1,
        *votes,
        span["n_digits"] + 21,
        F.floor(span["n_chars"] / 4).cast("int") + 42,
        F.when(span["beside"], 54).otherwise(55),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``row``, the whole row as a struct, and ``spans``: every candidate in its
    whole text, by kind and start."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    has = lambda part: F.contains(text, F.lit(part))
    # A text without digits, which most are, is looked at once.
    df = df.withColumn("has_digit", text.rlike("[0-9]"))
    guards = {
        "email": (EMAIL, has("@")),
        "ip": (IP, F.col("has_digit") & has(".")),
        "card": (CARD, F.col("has_digit")),
        "phone": (PHONE, has("+")),
        "number": (NUMBER, F.col("has_digit")),
        "handle": (HANDLE, has("at)") | has("at]") | has("AT)") | has("AT]")),
    }
    for name in KINDS:
        df = matches(df, name, *guards[name])
    long_enough = F.filter("card", lambda s: F.length(_digits(s["value"])) >= 13)
    df = df.withColumn("card", long_enough)
    judged = [F.transform(name, _judge(kind)) for kind, name in enumerate(KINDS)]
    return df.select("row", F.concat(*judged).alias("spans"))


@dataclass(frozen=True)
class Reliabilities:
    """How often candidates are personal data, and how each labeler votes on
    those that are (``yes``) and are not (``no``): shares of -1, 0 and 1."""

    prior: float
    yes: tuple[tuple[float, ...], ...]
    no: tuple[tuple[float, ...], ...]

    def posterior(self, votes: Column) -> Column:
        def likelihood(tables):
            product = F.lit(1.0)
            for i, shares in enumerate(tables):
                product = product * F.element_at(F.array(*map(F.lit, shares)), votes[i] + 2)
            return product

        yes = self.prior * likelihood(self.yes)
        return yes / (yes + (1 - self.prior) * likelihood(self.no))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation on ``(votes array<int>, n long)``, a row per
    pattern of votes, of which there are 3 to the number of labelers.

    It starts from the majority's opinion. Counts are smoothed, so no labeler
    is ever believed blindly.
    """
    votes = F.col("votes")
    total = F.aggregate("votes", F.lit(0), lambda s, v: s + v)
    posterior = 1 / (1 + F.exp(-2.0 * total))
    found = None
    for _ in range(rounds):
        share = F.col("n") * F.col("p")
        sums = [F.sum("n").alias("n"), F.sum(share).alias("yes")]
        for i in range(len(LABELERS)):
            for v in (-1, 0, 1):
                mine = votes[i] == v
                sums.append(F.sum(F.when(mine, share).otherwise(0.0)).alias(f"yes_{i}_{v}"))
                sums.append(F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"all_{i}_{v}"))
        row = patterns.withColumn("p", posterior).agg(*sums).first()
        n, yes = row.n or 0, row.yes or 0.0

        def shares(of, size):
            return tuple(
                tuple(round((of(i, v) + 1.0) / (size + 3.0), 9) for v in (-1, 0, 1))
                for i in range(len(LABELERS))
            )

        yes_of = lambda i, v: row[f"yes_{i}_{v}"] or 0.0  # noqa: B023, E731
        no_of = lambda i, v: max((row[f"all_{i}_{v}"] or 0) - yes_of(i, v), 0.0)  # noqa: B023, E731
        found = Reliabilities(
            round((yes + 1.0) / (n + 2.0), 9), shares(yes_of, yes), shares(no_of, max(n - yes, 0))
        )
        posterior = found.posterior(votes)
    return found


def train(spans: DataFrame, steps: int = 25) -> list[float]:
    """The span classifier, from ``(span)`` rows: all candidates of all documents.

    Equal candidates are counted before anything else is done with them.
    """
    counted = stored(
        spans.select("span.votes", features(F.col("span")).alias("features"))
        .groupBy("votes", "features")
        .agg(F.count("*").alias("n"))
        .coalesce(1),
        "pii-patterns",
    )
    reliable = estimate(counted.groupBy("votes").agg(F.sum("n").alias("n")))
    size = counted.agg(F.sum("n")).first()[0] or 1
    rows = counted.select(
        "features",
        reliable.posterior(F.col("votes")).alias("label"),
        (F.col("n") * (100.0 / size)).alias("weight"),
    )
    return logistic.train(rows, FEATURES, steps)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs``: arrays of ``kind, start, end``.

    ``base`` are the matches whose rule holds. ``added`` are other candidates
    that the classifier takes for personal data and that overlap no base span;
    of two that overlap the one of the earlier kind stays. Code points, end
    exclusive. NULL and empty texts have none. Rows that repeat an id are
    searched each. Other columns are not read.
    """
    found = stored(candidates(docs.select("doc_id", "text")).select("row.doc_id", "spans"), "pii")
    weights = train(found.select(F.explode("spans").alias("span")))
    return accepted(found, weights)


def accepted(found: DataFrame, weights: list[float]) -> DataFrame:
    """Replace ``spans`` by ``base`` and ``added``."""
    rest = [name for name in found.columns if name != "spans"]
    place = lambda s: F.struct(s["kind"], s["start"], s["end"])
    others = F.filter("spans", lambda s: ~s["base"])
    likely = lambda s: logistic.probability(weights, features(s)) >= 0.5
    beside = given(by_kind("base"), lambda lists: F.filter("others", lambda s: ~touches(s, lists)))
    wanted = (
        found.select(*rest, F.filter("spans", lambda s: s["base"]).alias("base"), others.alias("others"))
        .withColumn("others", F.filter("others", likely))
        .withColumn("others", beside)
    )
    first = given(
        by_kind("others"),
        lambda lists: F.filter("others", lambda s: ~touches(s, F.slice(lists, F.lit(1), s["kind"]))),
    )
    return wanted.select(
        *rest, F.transform("base", place).alias("base"), F.transform(first, place).alias("added")
    )


def by_kind(spans: str) -> Column:
    """A list per kind; its spans are apart and rise, as matches of one pattern do."""
    mine = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return F.array(*map(mine, range(len(KINDS))))


def touches(span: Column, lists: Column) -> Column:
    """Whether a span overlaps one of ``lists``, each searched by halving it."""

    def closer(at: Column, others: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        before = F.get(others, middle)["start"] < span["end"]
        more = at["lo"] < at["hi"]
        return F.struct(
            F.when(more & before, middle + 1).otherwise(at["lo"]).alias("lo"),
            F.when(more & ~before, middle).otherwise(at["hi"]).alias("hi"),
        )

    def hit(others: Column) -> Column:
        # The last that begins before the span ends also ends last.
        return F.aggregate(
            F.sequence(F.lit(1), F.length(F.bin(F.size(others)))),
            F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi")),
            lambda at, _: closer(at, others),
            lambda at: F.coalesce(F.get(others, at["lo"] - 1)["end"] > span["start"], F.lit(False)),
        )

    return F.exists(lists, hit)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets.

    ``n_chars``, if there, is the new length of a changed text. Overlapping
    spans give one mark. Candidates are found twice, for training and for the
    result, so that no text has to be shuffled or written; for training they are
    written, as each expression would be repeated for every use of a span.
    """
    found = candidates(docs)
    spans = stored(found.select("spans"), "pii-spans")
    weights = train(spans.select(F.explode("spans").alias("span")))
    changed = accepted(found, weights).select(
        "row", F.array_sort(_by_start(F.concat("base", "added"))).alias("spans")
    )
    text = F.when(F.size("spans") > 0, masked(F.col("row.text"), F.col("spans")))
    changed = changed.select("row", text.alias("changed"))
    columns = []
    for name in docs.columns:
        old = F.col("row.`" + name.replace("`", "``") + "`")
        new = {
            "text": F.col("changed"),
            "n_chars": F.char_length("changed").cast(docs.schema[name].dataType),
        }.get(name)
        columns.append((old if new is None else F.coalesce(new, old)).alias(name))
    return changed.select(*columns)


def _by_start(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with a mark for each of ``spans``, which are sorted by start.

    Cutting a piece out of a text reads the text up to it, so each group of
    spans has its part of the text cut out first.
    """
    names = F.array(*map(F.lit, KINDS))

    def marked(at: Column, group: Column, upto: Column) -> Column:
        def with_part(part: Column) -> Column:
            def add(state: Column, s: Column) -> Column:
                between = F.substr(
                    part, state["at"] - at + 1, F.greatest(s["start"] - state["at"], F.lit(0))
                )
                mark = F.when(
                    s["start"] >= state["at"],
                    F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">")),
                ).otherwise("")
                return F.struct(
                    F.greatest(state["at"], s["end"]).alias("at"),
                    F.concat(state["out"], between, mark).alias("out"),
                )

            start = F.struct(at.alias("at"), F.lit("").alias("out"))
            return F.aggregate(group, start, add, lambda state: state["out"])

        return given(F.substr(text, at + 1, upto - at), with_part)

    def joined(spans: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            parts = F.transform(
                F.slice(reach, F.lit(1), F.size(reach) - 1),
                lambda at, g: marked(
                    at, F.slice(spans, g * GROUP + 1, F.lit(GROUP)), F.get(reach, g + 1)
                ),
            )
            rest = F.substr(text, F.element_at(reach, -1) + 1)
            return F.concat(F.array_join(parts, ""), rest)

        return given(scanned(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"])), with_reach)

    return given(spans, joined)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]),
        ),
        ",",
    )


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:BASE])],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
    )
