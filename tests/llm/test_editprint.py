import hashlib
import random

import numpy as np
import pytest
from conftest import DATA

from notelake.llm import editprint


def walk_steps():
    """Steps over each kind of character from each phase, by trying one bit after the other."""
    bits = np.random.Generator(np.random.PCG64(20240117)).integers(0, 2, (256, 64))
    out = []
    for row in bits.tolist():
        if not any(row):
            row[0] = 1
        out.append([])
        for phase in range(64):
            n = 1
            while not row[(phase + n - 1) % 64]:
                n += 1
            out[-1].append(n)
    return out


def sampled_place(k, length):
    """The k-th place of a string of this length: the published jump consistent hash."""
    key, b, j = int.from_bytes(hashlib.sha256(f"place {k}".encode()).digest()[:8], "big"), -1, 0
    while j < length:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def slow(text):
    """Step by step: write the character, move on where its bit says so; then look at the sampled places."""
    if not text:
        return "0" * 64
    kinds = [ord(c) if ord(c) < 256 else (ord(c) * 2654435761 // 256) % 256 for c in text]
    kinds += [0] * (len(kinds) % 2)
    steps, written, i, j = walk_steps(), [], 0, 0
    while i < len(kinds):
        written.append(i)
        n = steps[kinds[i]][j % 64]
        written += [i] * (n - 1)
        j += n
        i += 1
    out = []
    for k in range(64):
        at = written[sampled_place(k, len(written))]
        out.append("0123456789abcdef"[__import__("zlib").crc32(text[at : at + 6].encode()) * 2654435761 >> 20 & 15])
    return "".join(out)


@pytest.mark.parametrize("text", ["a", "ab", "hello world, how are you", "é漢😀 mixed ", "xyz" * 500])
def test_walk(text):
    assert editprint.fingerprint(text) == slow(text)


def test_edits_keep_most_places():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    text = " ".join(rng.choices(words, k=800))
    other = " ".join(rng.choices(["one", "two", "three", "four", "five", "six"], k=800))
    edited = list(text)
    for _ in range(12):
        edited[rng.randrange(len(edited))] = "#"
        del edited[rng.randrange(len(edited))]
    near = editprint.likeness(editprint.fingerprint(text), editprint.fingerprint("".join(edited)))
    assert near > 0.6 and editprint.likeness(editprint.fingerprint(text), editprint.fingerprint(other)) < 0.25


def pairs(rows):
    """(doc_id, text) in order of id, then of what the operator orders by; nulls first."""
    out = []
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        p, q, r = map(editprint.fingerprint, (t, e, after))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, editprint.likeness(p, q), editprint.likeness(p, r)))
    return out


def test_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    got = sorted(tuple(r) for r in editprint.edited_pairs(df.repartition(5)).collect())
    assert got == pairs(rows)
    near = sorted(r[5] for r in got)
    assert near[len(near) // 2] > 0.4


def test_edge_cases(spark):
    rows = [(None, "no id at all"), (-5, None), (0, ""), (1, "x"), (2, "same text"), (3, "same text"), (9, "long " * 60_000)]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, part int, guard string")
    assert sorted((tuple(r) for r in editprint.edited_pairs(df).collect()), key=str) == sorted(pairs(rows), key=str)
    twice = editprint.edited_pairs(spark.createDataFrame([(1, "a b c d")] * 5, "doc_id long, text string")).collect()
    assert len(twice) == 5 and len(set(twice)) == 1 and twice[0].near_next == 1.0
    one = editprint.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert editprint.edited_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choices("lorem ipsum dolor sit amet consectetur".split(), k=400)) for _ in range(5)]
    rows = [(i, base[i % 5] if i < 20 else base[i % 5][:-7] + "changed") for i in range(25)]
    df = editprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = {r.doc_id: r.component_id for r in editprint.similar_groups(df).collect()}
    assert groups == {i: i % 5 for i in range(25)}
    assert editprint.similar_groups(df.limit(0)).count() == 0
    a, b = "0" * 60 + "1234", "0" * 60 + "1299"
    got = spark.range(1).select(editprint.likeness_of(*(__import__("pyspark").sql.functions.lit(x) for x in (a, b))).alias("v")).first().v
    assert got == pytest.approx(editprint.likeness(a, b))


@pytest.mark.parametrize("tile", [1024, 3])
def test_groups_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(editprint, "TILE", tile)
    rng, rows = random.Random(3), []
    for _ in range(4):  # copies with up to 6 digits changed, in bands that unlike prints share
        base = "00000" + "".join(rng.choices("0123456789abcdef", k=59))
        for _ in range(6):
            p = list(base)
            for i in rng.sample(range(5, 64), 6):
                p[i] = rng.choice("0123456789abcdef")
            rows.append((len(rows), "".join(p)))
    near = {a: {b for b, q in rows if b != a and editprint.likeness(p, q) >= 0.8} for a, p in rows}
    root = {a: a for a in near}
    for _ in rows:
        root = {a: min([root[a], *(root[b] for b in near[a])]) for a in near}
    got = editprint.similar_groups(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()
    assert {(r.doc_id, r.component_id, r.n_near) for r in got} == {(a, root[a], len(near[a])) for a in near}
    assert any(near.values())


def test_recall_of_edited_copies(spark):
    """Of planted pairs at a likeness of 0.8 or more, at least 0.9 are found; most are near the threshold."""
    rng, rows = random.Random(9), []
    words = [f"w{i}" for i in range(3000)]
    for k in range(150):
        text = list(" ".join(rng.choices(words, k=rng.randint(150, 500))))
        rows.append((2 * k, "".join(text)))
        for _ in range(rng.randint(1, 12)):  # few edits bring a pair of texts down to the threshold
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        rows.append((2 * k + 1, "".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in editprint.fingerprints(df).collect()}
    pairs = [(a, b, like) for a in prints for b in prints if a < b and (like := editprint.likeness(prints[a], prints[b])) >= 0.8]
    groups = {r.doc_id: r.component_id for r in editprint.similar_groups(editprint.fingerprints(df)).collect()}
    found = [groups[a] == groups[b] for a, b, _ in pairs]
    low = [f for f, (_, _, like) in zip(found, pairs, strict=True) if like < 0.9]
    assert len(pairs) > 40 and len(low) > 10 and sum(found) >= 0.97 * len(found) and sum(low) >= 0.9 * len(low)
    assert all(groups[a] == min(d for d, g in groups.items() if g == groups[a]) for a in groups)


def test_query_has_groups(spark):
    from notelake.llm import queries

    got = queries.op9_edit_fingerprints(spark, DATA).collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    near = {a: {b for b in prints if b != a and prints[a] != prints[b] and editprint.likeness(prints[a], prints[b]) >= 0.8} for a in prints}
    links = sum(len({prints[b] for b in near[r.doc_id]}) for r in got)
    assert sum(r.n_near for r in got) >= 0.95 * links
    group = {r.doc_id: r.component_id for r in got}
    assert all(group[a] == group[b] for a in prints for b in prints if prints[a] == prints[b])


def test_crowded_ids_are_cut(spark):
    rng = random.Random(4)
    rows = [(None, f"no id {i} " + "x" * rng.randint(0, 30)) for i in range(300)] + [(5, f"five {i}") for i in range(300)] + [(i, f"t{i}") for i in range(6, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    order = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = [(r.doc_id, r.text) for r in sorted(order, key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.h))]
    assert sorted((tuple(r) for r in editprint.edited_pairs(df.repartition(6)).collect()), key=str) == sorted(pairs(order), key=str)


def test_unlike_prints_that_share_an_id(spark):
    rng = random.Random(12)
    draw = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(64))
    a, b = draw(), draw()
    rows = [(5, a), (5, b), (7, "0" + a[1:]), (5, a), (9, b), (9, draw())]
    got = {(r.doc_id, r.fingerprint): (r.component_id, r.n_near) for r in editprint.similar_groups(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert got[5, a] == (5, 1) and got[7, "0" + a[1:]] == (5, 1)
    assert got[5, b] == (5, 0) and got[9, b] == (5, 0) and got[9, rows[-1][1]] == (9, 0)
