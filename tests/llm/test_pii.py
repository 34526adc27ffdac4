"""Personal data against the plain patterns."""

import hashlib
import random
import re

from scanloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    text = text or ""
    out = []
    only = lambda m: re.sub("[^0-9]", "", m)
    for k, (name, pattern, ok) in enumerate([
        ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 14 <= len(only(m)) <= 19 and plain_luhn(only(m))), ("phone", PHONE, lambda m: 10 <= len(only(m)) <= 15),
    ]):
        out += [(m.start(), k, name, m.end()) for m in pattern.finditer(text) if ok(m.group())]
    out.sort()
    counts = [sum(o[1] == k for o in out) for k in range(4)]
    return *counts, hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, n, e in out).encode()).hexdigest()


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "a@b.c_d@e.f", "@", "x@y", "é", "日", "1.2.3.4", "256.1.1.1", "001.02.3.0004", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "45320151128336", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "+1 (269) 555-3296", "+12", "+1 ....2", "+4412345678901234567", " ", " ", "-", ".", "9", "\n", "word", "%%+", "a.b@c-d.e-f."]
    texts = [None, "", "a" * 30000, "1 " * 20000, "1." * 9000, "+1" * 5000, "a@" * 5000, "x@y" + ".z" * 20000] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    rows = [(i, t, 7, "s") for i, t in enumerate(texts)] + [(1, "a@b.c", 1, "s")]
    out = pii.digest(spark.createDataFrame(rows, "doc_id long, text string, pii int, spans string")).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == sorted((d, *plain(t)) for d, t, *_ in rows)


def test_validated_kinds_context_and_masking(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 AND", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33", "SSN: 123-45-6789", "no word 123-45-6789", "tax id 000-45-6789", "mail me a@b.cd now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert spans == {0: "iban:5:32", 1: "iban:0:22", 2: "", 3: "national_id:5:16", 4: "", 5: "", 6: "email:8:14"}
    hidden = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert hidden[0] == "iban <iban> AND" and hidden[3] == "SSN: <national_id>" and hidden[4] == texts[4] and hidden[6] == "mail me <email> now"
    scores = {r.doc_id: [s.score for s in r.pii] for r in pii.find_pii(df).collect()}
    assert scores[0] == [1.0] and scores[1] == [0.9] and scores[6] == [0.9]


def test_many_matches_and_context_over_matches(spark):
    """A context may reach over several matches; a text of many matches is no quadratic work."""
    close = "ssn 1.2.3.4 5.6.7.8 1.2.3.4 123-45-6789 x 1.2.3.4.5.6.7.8 1.1.1.1 2.2.2.2 3.3.3.3 123-45-6789"
    many = " ".join(f"m{i}@x.yz 10.0.0.{i % 300}" for i in range(30_000))
    out = {r.doc_id: r for r in pii.digest(spark.createDataFrame([(1, close), (2, many)], "doc_id long, text string")).collect()}
    found = [(m.start(), m.end()) for m in re.finditer("[0-9]{3}-[0-9]{2}-[0-9]{4}", close)]
    want = [f"national_id:{s}:{e}" for s, e in found if "ssn" in close[max(0, s - 40) : s]]
    assert [x for x in out[1].spans.split(",") if x.startswith("nat")] == want and len(want) == 1
    assert (out[2].n_email, out[2].n_ip, out[2].n_card, out[2].n_phone, out[2].base_sha256) == plain(many)


def test_empty_table(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
