import hashlib
import random
import re
import string

import pytest

from millrace.llm.common import stored
from millrace.llm import pii, secrets

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_pii(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                0: True,
                1: kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                2: 16 <= len(digits) <= 19 and luhn(digits),
                3: 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((kind, m.start(), m.end()))
    return found


def noise(n=300):
    rng = random.Random(3)
    return ["".join(rng.choice("0123456789 .@+-()ab_é") for _ in range(rng.randint(0, 60))) for _ in range(n)]


ODD = [
    None, "", "a@b.c.@d.e x@y", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4",
    "+1 (2) 34-5678 +12 3 +1234567890123456789", "4111 1111 1111 1111 4111-1111-1111-1111",
    "a@" + "b." * 20_000 + "c", "9" * 20_000, "1 " * 3_000, "x" * 50_000 + "@q.r",
    "\U0001d49c a@b.co é 1.2.3.4", "12.12.12.12.a@b.c",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(ODD + noise()))
    return dict(rows), spark.createDataFrame(rows, "doc_id bigint, text string")


def test_base_spans_are_those_of_a_plain_program(texts):
    plain, df = texts
    rows = pii.find(df).collect()
    assert len(rows) == len(plain)
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.base] == plain_pii(plain[row.doc_id])


def test_added_spans_touch_no_base_span_and_redaction_masks_all(texts):
    plain, df = texts
    for row in pii.find(df).collect():
        for s in row.added:
            assert all(s.end <= t.start or t.end <= s.start for t in row.base)
    wide = df.selectExpr("*", "'k' AS spans", "CAST(0 AS bigint) AS n_chars", "1 AS at")
    redacted = pii.redact(wide)
    assert redacted.columns == wide.columns
    for row in redacted.collect():
        if plain[row.doc_id] and plain_pii(plain[row.doc_id]):
            assert not [s for s in plain_pii(row.text) if s[0] == 0]
            assert row.n_chars == len(row.text)


def test_masks_by_hand(spark):
    docs = spark.createDataFrame([(1, "Mail é@x a.b@c.de now, 1.2.3.4!", 9)], "doc_id int, text string, n_chars int")
    row = pii.redact(docs).first()
    assert row.text == "Mail é@x <email> now, <ip>!" and row.n_chars == len(row.text)


def apart(s, t):
    return s.end <= t.start or t.end <= s.start


@pytest.mark.parametrize("group", [2, 256])
def test_spans_taken_in_groups_are_those_of_the_whole_text(texts, monkeypatch, group):
    monkeypatch.setattr(pii, "GROUP", group)
    plain, df = texts
    found = pii.candidates(df).select("row.doc_id", "spans").cache()
    # Weights of 0 take every candidate.
    accepted = pii.accepted(found, [0.0] * (pii.FEATURES + 1)).collect()
    spans = {row.doc_id: row.spans for row in found.collect()}
    for row in accepted:
        assert [(s.kind, s.start, s.end) for s in row.base] == plain_pii(plain[row.doc_id])
        rest = [s for s in spans[row.doc_id] if not s.base and all(apart(s, t) for t in row.base)]
        first = [s for s in rest if all(t.kind >= s.kind or apart(s, t) for t in rest)]
        assert [(s.kind, s.start, s.end) for s in row.added] == [(s.kind, s.start, s.end) for s in first]


@pytest.mark.parametrize("group", [2, 256])
def test_masks_are_those_of_a_plain_program(spark, monkeypatch, group):
    monkeypatch.setattr(pii, "GROUP", group)
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é\U0001d49c") for _ in range(rng.randint(1, 80)))
        spans = [sorted(rng.sample(range(len(text) + 1), 2)) for _ in range(rng.randint(1, 9))]
        rows.append((i, text, sorted((a, b, rng.randrange(6)) for a, b in spans)))
    df = spark.createDataFrame(
        rows, "id int, text string, spans array<struct<start:int,end:int,kind:int>>"
    )
    masked = {r.id: r.out for r in df.select("id", pii.masked(df.text, df.spans).alias("out")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for start, end, kind in spans:
            out += text[at : max(start, at)] + (f"<{pii.KINDS[kind]}>" if start >= at else "")
            at = max(at, end)
        assert masked[i] == out + text[at:]


def test_votes_are_weighed_by_agreement(spark):
    # Three labelers agree, the fourth votes at random.
    rows = [([1, 1, 1, v], 50) for v in (-1, 1)] + [([-1, -1, -1, v], 50) for v in (-1, 1)]
    found = pii.estimate(spark.createDataFrame(rows, "votes array<int>, n bigint"))
    assert abs(found.prior - 0.5) < 0.05
    assert found.yes[0][2] > 0.9 and abs(found.yes[3][2] - 0.5) < 0.1


def test_no_documents(spark, none, odd):
    assert pii.find(none).count() == 0 and secrets.scan(none).count() == 0
    assert pii.redact(none).columns == none.columns
    assert pii.find(odd).count() == 7 and secrets.scan(odd).count() == 7


def plain_secrets(text):
    found = []
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text or ""):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        for m in re.finditer(pattern, text or ""):
            if m.end() - m.start() >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def random_runs(n, size, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size)) for _ in range(n)]


def test_secrets_of_the_rules_and_of_the_models(spark, documents):
    hidden = random_runs(20, 32)
    rows = [(i, f"the thing {run} is here") for i, run in enumerate(hidden)]
    rows += [(100 + i, t) for i, t in enumerate(documents.text)]
    rows += [(1000, "secret=token: abcdefghijklmnop PASSWORD = 'q1w2e3r4t5y6u7' pa\u017f\u017fword=aaaaaaaaaaaaaaaa")]
    rows += [(1001, "AKIA" + "A" * 13 + " AKIAAKIA" + "B" * 12 + " é " + "0123456789abcdef" * 2)]
    rows += [(1002, "internationalization_of_identifiers and misunderstandings")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = dict(rows)
    result = {r.doc_id: r for r in secrets.scan(df).collect()}
    for doc_id, row in result.items():
        assert [(s.start, s.kind, s.end) for s in row.base] == plain_secrets(plain[doc_id])
    found = [i for i, run in enumerate(hidden) if [s.value for s in result[i].added] == [run]]
    assert len(found) >= 18
    assert not result[1002].added
    assert sum(len(result[100 + i].added) for i in range(len(documents))) <= 2


def test_op2_digest(spark, documents):
    sf = "/root/testdata/sf0.001"
    names = ("assign", "access", "hex")
    rows = {r.doc_id: r for r in secrets.op2_secret_scan(spark, sf).collect()}
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        spans = plain_secrets(text)
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[doc_id].n_hex == sum(k == 2 for _, k, _ in spans)


def test_each_pattern_is_searched_once_for_training(spark, odd, plan_of, monkeypatch):
    written = []
    monkeypatch.setattr(pii, "stored", lambda df, name: written.append(plan_of(df)) or stored(df, name))
    pii.redact(odd)
    assert written[0].count("regexp_extract_all(") == 6
