"""PII and secrets against plain Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii, secrets

from .conftest import ROWS, texts_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(d):
    return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def base_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-_+1925 4(:", max_size=60))
def test_proposals_equal_plain_patterns(t):
    found = sorted((a, pii.KINDS.index(k), k, b) for a, b, k in pii.proposals(t) if k in pii.BASE)
    assert found == base_pii(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1" + " " * 200_000, "a@b." * 60_000):
        list(pii.proposals(t))


def test_pii_report(docs):
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in texts_of():
        assert got[i]["base_sha256"] == sha(base_pii(t)), i
        assert got[i]["n_email"] == sum(k == "email" for _, _, k, _ in base_pii(t))


def test_pii_odd_rows(odd, none):
    rows = pii.report(odd).collect()
    assert sorted(r["base_sha256"] for r in rows) == sorted(sha(base_pii(t or "")) for _, t in ROWS)
    assert pii.report(none).count() == 0


def test_added_spans_need_checksum_or_context():
    t = "IBAN DE89 3704 0044 0532 0130 00 BIC; DE88 3704 0044 0532 0130 00; ssn 123-45-6789 " + "x" * 80 + " part 123-45-6789 " + "x" * 80 + " 123-45-6789"
    kinds = [k for _, _, k, _ in pii.scored(t, 0.5)]
    assert kinds.count("iban") == 1 and kinds.count("ssn") == 1


def test_redaction_keeps_columns_and_nulls(odd):
    out = pii.redact_pii(odd)
    assert out.columns == odd.columns
    rows = {(r["doc_id"], r["n"]): r["text"] for r in out.collect()}
    assert rows[1, 1] is None and rows[5, 5] == "mail <EMAIL> or call <PHONE> and password = hunter22x now"
    assert pii.redacted("x 1 y", [(2, 3, "a", 1), (2, 5, "b", 1)]) == "x <A>"


def test_secrets_report(docs, odd, none):
    got = {r["doc_id"]: r for r in secrets.report(docs).collect()}
    for i, t in texts_of():
        assert got[i]["base_sha256"] == sha(base_secrets(t)), i
    rows = secrets.report(odd).collect()
    assert sorted(r["base_sha256"] for r in rows) == sorted(sha(base_secrets(t or "")) for _, t in ROWS)
    assert secrets.report(none).count() == 0


def test_no_retry_inside_a_failed_match(spark):
    texts = ["token=token:abcdefg", "SECRET = 'abc' password:\"qwertz1\"", "api_key==abcdef AKIA" + "A" * 16 + " " + "0" * 24, "AKIAAKIAAKIA", "token= 😀 passwd=ab.cd/ef😀", "apikey: x" * 50 + "apikey: 123456"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.report(df).collect()}
    assert got == {i: sha(base_secrets(t)) for i, t in enumerate(texts)}


def test_ledger_is_incremental(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([(1, "secret: abcdef1"), (2, "secret: abcdef1"), (3, "nothing here"), (4, None)], "doc_id bigint, text string")
    ledger = secrets.update_ledger(one, path, secrets.BASE)
    assert ledger.count() == 3 and {tuple(r["rules"]) for r in ledger.collect()} == {("assign@1", "access@1", "hex@1")}
    assert secrets.scan(one, secrets.BASE, ledger).count() == 0  # a second pass scans nothing
    assert secrets.update_ledger(one, path, secrets.BASE).count() == 3
    two = one.unionByName(spark.createDataFrame([(5, "token = zzzzzzz")], one.schema))
    assert secrets.scan(two, secrets.BASE, ledger).count() == 1
    newer = (secrets.Rule("assign", 2, r"secret", 0, 1), *secrets.BASE[1:])
    assert {tuple(r["rules"]) for r in secrets.scan(one, newer, ledger).collect()} == {("assign@2",)}  # only unseen pairs
    ledger = secrets.update_ledger(two, path, newer)
    assert ledger.count() == 3 + 4
    of = lambda rules: {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.findings(two, ledger, rules).collect()}
    assert of(newer) == {1: [(0, 0, "assign", 6)], 2: [(0, 0, "assign", 6)], 3: [], 4: [], 5: []}
    assert of(secrets.BASE[:1])[1] == [(0, 0, "assign", 15)]
    twice = ledger.unionByName(ledger)  # two scans at once have appended the same pairs
    assert {r["doc_id"]: len(r["spans"]) for r in secrets.findings(two, twice, newer[::-1]).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert secrets.report(two, path).count() == 5 and secrets.update_ledger(two, path).count() == secrets.read_ledger(spark, path).count()


def test_many_findings_of_one_text(spark):
    text = " ".join(f"{i:024x}" for i in range(30_000))
    row = secrets.report(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["n_hex"] == 30_000 and row["spans"].startswith("hex:0:24,hex:25:49") and row["spans"].endswith(f"hex:{len(text) - 24}:{len(text)}")

