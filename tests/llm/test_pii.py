import hashlib
import re

from common_llm import ROWS, SF, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from chorus.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290@.+-_% ()\n4", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_linear_on_long_runs():
    for x in ("9" * 20000, "a" * 200000, "a@" * 50000, "1." * 50000, "+1" * 50000, "@" * 100000):
        pii.base_spans(x)


def test_report(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pii.report(pii.find(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r["id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(k == x for _, x, _ in spans) for k in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert sum(r["n_email"] for r in got) > 0


def test_disclosing_terms(spark):
    """A name that stands by one address in different lines is removed there; common words and
    a name that mostly stands elsewhere are not."""
    rows = [(i, f"report {chr(97 + i) * 4} by Wanda Kowal reach wanda@mail.example.com today") for i in range(6)]
    rows += [(100 + i, f"report {chr(97 + i % 26) * 4} about today and the common river by the hill reach") for i in range(300)]
    rows += [(500, "Other text with wanda alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in out[0] and "Kowal" not in out[0] and "report" in out[0] and "today" in out[0]
    assert "[NAME]" in out[0]  # Wanda: 6 of 7 occurrences, generalised
    assert out[100] == dict(rows)[100] and out[500] == dict(rows)[500]
    spans = {r["id"]: r["spans"] for r in pii.report(pii.find(docs)).collect()}
    assert "term:" in spans[0] and "term:" not in spans[100]


def test_copies_of_one_passage_disclose_nothing(spark):
    rows = [(i, "call Xavier Quill under xq@mail.example.com now") for i in range(50)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["text"] == "call Xavier Quill under [EMAIL] now" for r in out)


def test_edges(spark):
    docs = edge_docs(spark)
    assert pii.report(pii.find(docs)).count() == len(ROWS)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted((str(i), str(t)) for i, t, _ in ROWS)
    assert pii.sanitise(empty_docs(spark)).count() == 0 and pii.report(pii.find(empty_docs(spark))).count() == 0
