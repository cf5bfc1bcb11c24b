import random
import re
import time
from hashlib import sha256

import pytest
from conftest import DATA

from notelake.llm import pii


def slow(text):
    """Each kind's pattern over the whole text; what isn't valid is dropped."""
    out = []
    for kind in (*pii.BASE, *pii.MORE):
        for m in re.finditer(pii.PATTERNS[kind], text or ""):
            a, b = m.span(2) if kind in pii.CUES else m.span()
            own = text[a:b]
            digits = re.sub("[^0-9]", "", own)
            if kind == "ip":
                ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in own.split("."))
            elif kind == "card":
                twice = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])] if len(digits) < 20 else []
                ok = 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            elif kind == "iban":
                own = own.replace(" ", "")
                n = 0
                for c in own[4:] + own[:4]:
                    n = (n * (100 if c.isalpha() else 10) + int(c, 36)) % 97
                ok = n == 1
            elif kind == "ssn":
                ok = re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", own) is not None
            else:
                ok = True
            if ok:
                out.append((kind, a, b))
    return out


PIECES = ["@", "a", ".", "-", "+", "1", "22", "300", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "+1 (555) 123-4567", "(", ")", " ", "  ", "://", "http://", ":", "pw", "SSN", "ssn ", "123-45-6789", "iban: ", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "account number ", "Acct #", "passport number", "AB123456", "99-77", "é", "日", "\n", "\t", "_", "%", "x@y.zz", "é@b.c", "000-12-3456", "/", "#", "="]


def test_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert pii.spans(text) == slow(text), text
    for _ in range(20_000):
        text = "".join(rng.choice("1234.@a- +:/") for _ in range(rng.randint(0, 40)))
        assert pii.spans(text) == slow(text), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail a.b@c.example.com.", "email:5:22"),
        ("a@b.c@d.e", "email:0:5"),
        ("x@a.b_c@d.e", "email:0:5,email:5:11"),
        ("at 1.2.3.4.5.6.7.8", "ip:3:10,ip:11:18"),
        ("999.1.1.1 and 001.002.003.004", "ip:14:29"),
        ("card 4111 1111-1111 1111", "card:5:24"),
        ("card 4111 1111 1111 1112", ""),
        ("call +1 (555) 123-4567.", "phone:5:22"),
        ("+12", ""),
        ("Iban: DE89 3704 0044 0532 0130 00.", "iban:6:33"),
        ("iban: DE89 3704 0044 0532 0130 01.", ""),
        ("Account number: 12345678", "account:16:24"),
        ("SSN 123-45-6789, ssn 900-45-6789", "ssn:4:15"),
        ("http://me:pw@host/x", "login:0:17"),
    ],
)
def test_golden(text, want):
    assert pii.listed(pii.spans(text)) == want


def test_long_texts_take_time_in_proportion():
    for piece in ("1", "1.", "1-", "a@", "+1", "a.", "1 ", "://", "1.1.1.1@"):
        assert pii.spans(piece * 1000) == slow(piece * 1000)
        began = time.process_time()
        pii.spans(piece * 200_000)
        assert time.process_time() - began < 10, piece


def test_query_and_awkward_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(None, None), (1, ""), (1, ""), (None, "x@y.zz"), (2, "1.2.3.4 " * 20_000)]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, spans string, n_ip int")

    def row(i, text):
        own = slow(text)
        base = [s for s in own if s[0] in pii.BASE]
        return (i, *(sum(s[0] == k for s in base) for k in pii.BASE), sha256(pii.listed(base).encode()).hexdigest(), pii.listed(own))

    assert sorted((tuple(r) for r in pii.find(df).collect()), key=repr) == sorted((row(*r) for r in rows), key=repr)
    assert pii.find(df.limit(0)).count() == 0


def test_masked(spark):
    df = spark.createDataFrame([(1, "to x@y.zz or +1 555 123 4567", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, kind string")
    assert [tuple(r) for r in pii.masked(df).orderBy("doc_id").collect()] == [(1, "to [email] or [phone]", "k"), (2, None, "k"), (3, "clean", "k")]
