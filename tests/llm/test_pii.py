import hashlib
import random
import re

from loomgraph.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def cases():
    rnd = random.Random(3)
    fixed = [
        None, "", "a@b.c%d@e.f", "é a.b@c-d.e.f. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5",
        "+1 (017) 555-7713 +12 +123456789012345678", "٣٤ +1 2", "1" * 5000, "a" * 20000 + "@", "+" + "1 " * 3000 + "x", "x@" + "a." * 2000 + "b",
        "GB82 WEST 1234 5698 7654 32", "call phone (212) 555-0199 now", "(212) 555-0199",
    ]
    return fixed + ["".join(rnd.choice("ab@.-+ ()0123456789") for _ in range(rnd.randint(1, 80))) for _ in range(400)]


def test_base_spans_match_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.query(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        kept = [s for s in got[i]["spans"].split(",") if s.split(":")[0] in KINDS]
        assert ",".join(kept) == want


def test_added_kinds(spark):
    docs = spark.createDataFrame([(1, "pay GB82 WEST 1234 5698 7654 32 soon"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "my phone (212) 555-0199"), (4, "sum (212) 555-0199")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.query(docs).collect()}
    assert got == {1: "iban:4:31", 2: "", 3: "tel:9:23", 4: ""}


def test_redact_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b@c.de f 1.2.3.4"), (2, None)], "doc_id long, text string")
    assert {r["id"]: r["text"] for r in pii.redact(docs).collect()} == {1: "a [email] f [ip]", 2: ""}
    assert pii.query(docs.limit(0)).count() == 0
