"""Thousands of rules by their required strings, against one rule after another."""

import random
import re

import pytest

from notelake.operators import scan


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("/home/[A-Za-z]+/", {"/home/"}), ("AKIA[0-9A-Z]{16}", {"AKIA"}), ("(ghp|gho)_[a-z]{3,}|github_pat_x", {"ghp", "gho", "github_pat_x"}), ("sk-(ant-)?[a-z]+", {"sk-"}),
        ("(api[_-]?key|token)=.*", {"api", "token"}), (r"a\.b*c", {"a."}), ("ab?c+d", {"a"}), ("x{0,2}yz", {"yz"}), ("x{2}y", {"x"}), ("[0-9]+", None), ("a|[bc]", None), ("(?i)secret", None), ("x(?!y)z", None), ("(?:ab|cd)+e", {"ab", "cd"}), ("a|", None), (r"\d+\s", None), ("(x|y[)]|z)w", {"x", "y", "z"}),
    ],
)
def test_required(pattern, want):
    assert scan.required(pattern) == want


def slow(files, rules):
    out = []
    for path, text in files:
        if path is None or text is None or re.search(scan.SKIPPED, path) or "\0" in text:
            continue
        for n, line in enumerate(text.split("\n"), 1):
            hits = [(c, p) for c, p, no in rules if not no and re.search(scan.java(p), line, re.ASCII)]
            if hits and not any(re.search(scan.java(p), f"{path}:{line}", re.ASCII) for _, p, no in rules if no):
                shown = line
                for _, p in hits:
                    shown = re.sub(scan.java(p), scan.HIDDEN, shown, flags=re.ASCII)
                out.append((path, n, sorted({c for c, _ in hits}), shown[: scan.SHOWN]))
    return sorted(out)


def test_five_thousand_rules(spark):
    rng = random.Random(2)
    rules = scan.load_rules(scan.GENERIC_RULES) + [(f"c{i % 40}", f"key{i}=[0-9]{{4}}", False) for i in range(5000)] + [("pair", "(left|right)[0-9]? hand", False), ("digits", "[0-9]{9}", False), ("", "^skip/", True), ("", "key77=", True)]
    line = lambda: " ".join(rng.choice(["word", f"key{rng.randrange(5200)}={rng.randrange(20000)}", "left hand", "right7 hand", "123456789", "é", '/home/me/ secret = "abcdefghij"', "AKIA" + "A" * 16, "key77=1234"]) for _ in range(rng.randint(0, 6)))
    files = [(f"{'skip' if i % 9 == 0 else 'f'}/{i}.txt", "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    files += [("a.md", "123456789"), ("b.txt", None), (None, "123456789"), ("c.txt", ""), ("z.txt", "\0 123456789"), ("long.txt", "x" * 300_000 + "\nkey1=1234\n" + "left hand" * 40)]
    df = spark.createDataFrame([(*f, "k") for f in files], "path string, text string, line string")
    got = sorted((r.path, r.line, r.categories, r.shown) for r in scan.scan_many(df, rules).collect())
    assert got == slow(files, rules) and len(got) > 100
    few = rules[:12]
    assert sorted(map(tuple, scan.scan_many(df, few).collect())) == sorted(map(tuple, scan.scan(df, few).collect()))
    assert scan.scan_many(df.limit(0), rules).count() == 0 and scan.scan_many(df, []).count() == 0
