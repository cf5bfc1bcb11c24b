import random
import re

from notelake.llm import licenses

SCHEMA = "doc_id long, text string"
NONE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    """Every block against every template, and every place against every phrase."""
    words = NONE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += places
        base |= {label} if places else set()
    found, best = set(), 0.0
    for label, t in licenses.TEMPLATES:
        own = set(re.findall("[a-z0-9]+", t.lower()))
        least = len(own) if len(own) < 20 else 0.85 * len(own)
        step = 16
        while step < len(re.findall("[a-z0-9]+", t.lower())):
            step *= 2
        for start in range(0, max(1, len(words)), step):
            block = set(words[start : start + 2 * step])
            if len(own & block) >= least - 1e-9:
                found.add(label)
                best = max(best, len(own & block) / len(own))
            if start + 2 * step >= len(words):
                break
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else best)


def rows(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    filler = ["the", "of", "license", "Mit", "under", "software", "word", "public", "é", "free", "cc", "by", "all", "rights"]
    texts = {}
    for i in range(300):
        out = rng.choices(filler, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice([t for _, t in licenses.TEMPLATES] + list(licenses.PHRASES)).split()
            if rng.random() < 0.4:
                t[rng.randrange(len(t))] = "changed"
            k = rng.randint(0, len(out))
            out[k:k] = t
        texts[i] = rng.choice([" ", ", ", "\n- "]).join(w.upper() if rng.random() < 0.2 else w for w in out)
    got = rows(licenses.scan(spark.createDataFrame(list(texts.items()), SCHEMA)))
    assert got == {i: slow(t) for i, t in texts.items()}
    assert len({g[5] for g in got.values()}) > 10


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "!!"), (None, "CC BY cc-by"), (4, "Released under the MIT License. " + "word " * 60_000 + "all rights reserved"), (4, "x")]
    df = spark.createDataFrame([(*t, "labels", 1.0) for t in texts], SCHEMA + ", labels string, score double")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(((d, *slow(t)) for d, t in texts), key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_whole_license_texts(spark):
    """Texts that stand anywhere in a document are found, with some words changed, and no other license is."""
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(500)]
    texts, want = {}, {}
    for i, (label, t) in enumerate(licenses.TEXTS * 6):
        words = t.split()
        for at in rng.sample(range(len(words)), len(words) // 25):
            words[at] = "changed"
        texts[i] = " ".join(rng.choices(filler, k=rng.randint(0, 900)) + words + rng.choices(filler, k=rng.randint(0, 900)))
        want[i] = label
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    got = {}
    for r in licenses.matches(df).collect():
        got.setdefault(r.doc_id, set()).add(r.label)
        block = texts[r.doc_id].split()
        assert r.contained >= 0.85 and 0 <= r.start < len(block) + 200
    hit = [i for i in want if want[i] in got.get(i, ())]
    assert len(hit) >= 0.9 * len(want)
    assert all(got.get(i, set()) <= {want[i], "gpl-3.0", "apache-2.0", "mpl-2.0"} for i in want)


def test_siblings_are_told_apart(spark):
    texts = {1: "licensed under the GNU General Public License, version 2", 2: "licensed under the GNU General Public License, version 3", 3: "licensed under CC BY 4.0", 4: "licensed under CC BY-NC 4.0"}
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    assert got == {1: "gpl,gpl-2.0", 2: "gpl,gpl-3.0", 3: "cc-by", 4: "cc-by,cc-by-nc-4.0"}
