import hashlib
import re

from revdiff.llm import pii

from . import cases

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.cc@d.ee x@y.z_w@q.rs +1 (974) 555-3436 1.2.3.4.5 256.1.1.1 001.002.003.0004 " + "4" * 30,
    "é😀 a@b.co 4111 1111 1111 1111 4111-1111-1111-1111 4111-1111-1111-1112 +12345678 +123 456 7890 x",
    "", None, "1 " * 3000, "a@" + "b." * 3000 + "c", "x" * 50_000 + "@", "1" * 3000 + ".1.2.3", "+49 30 901820-0 and 10.0.0.255, 10.0.0.256 me@host",
    "4111111111111111 4111111111111111\n5500 0000 0000 0004 3782-822463-10005",
]


def luhn(digits):
    odd = sum(int(c) for c in digits[::-1][::2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            sound = {
                "email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x[-3:]) < 256 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,  # noqa: B023
            }
            if sound[kind]():
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans(spark):
    docs = cases.documents(spark, list(enumerate(TEXTS)) + cases.ODD)
    found = pii.digest(pii.find(docs)).collect()
    assert len(found) == len(TEXTS) + len(cases.ODD)
    texts = {hashlib.sha256(",".join(base(t or "")).encode()).hexdigest() for t in [*TEXTS, *(t for _, t, *_ in cases.ODD)]}
    assert {r.base_sha256 for r in found} == texts
    for r in found:
        if r.doc_id in (0, 8, 9) and r.n_email + r.n_ip + r.n_card + r.n_phone:
            want = base(TEXTS[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in pii.KINDS] and set(want) <= set(r.spans.split(","))
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def test_method_adds_likely_spans_only(spark):
    rows = [(i, f"call me at (415) 555-{1000 + i} or write bob{i} (at) example (dot) com today") for i in range(40)]
    rows += [(100 + i, f"order 555 123 {4000 + i}x/ref part no 555 123 {4000 + i}_a") for i in range(20)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(cases.documents(spark, rows))).collect()}
    assert all("phone:11:25" in found[i] and "email:" in found[i] for i in range(40))
    assert all(found[100 + i] == "" for i in range(20))


def test_redaction(spark):
    docs = cases.documents(spark, [(1, "mail a@b.co, +123 456 7890 or 10.0.0.1.", "en", "s"), (2, None), (3, "none")])
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: (r.text, r["_text"], r.key) for r in clean.collect()} == {
        1: ("mail [EMAIL], [PHONE] or [IP].", "other", "k"), 2: (None, "other", "k"), 3: ("none", "other", "k")
    }
