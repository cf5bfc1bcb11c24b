import itertools
import random
import re

import pytest
import xxhash

from notelake import shared
from notelake.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, most=4):
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(prints, 2):
        if (x ^ y).bit_count() <= most:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {d: root(d) for d, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b C d É\x1ce", "x y z w " * 300, "the same words, the same words, the same words"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


@pytest.mark.parametrize("limit", [1 << 22, 500])
def test_components_against_all_pairs(spark, monkeypatch, limit):
    rng = random.Random(limit)
    prints = []
    for _ in range(12):  # clusters with chains, ties and unlinked neighbours
        center = rng.getrandbits(64)
        for _ in range(25):
            center ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
            prints.append((len(prints), center))
    prints += [(len(prints) + i, 0) for i in range(40)] + [(1000, (1 << 64) - 1)]
    if limit < 1000:  # crowded cells are halved
        import numpy as np

        fp = np.array([x for _, x in prints], np.uint64)
        monkeypatch.setattr(simhash, "HELD_VARIANTS", limit)
        found = set()
        for group, member in simhash._meet(np.unique(fp), np.zeros(len(np.unique(fp)), np.int64), np.arange(len(np.unique(fp))), 64, 2):
            for g in set(group.tolist()):
                found |= set(itertools.combinations(sorted(set(member[group == g].tolist())), 2))
        own = np.unique(fp).tolist()
        assert found == {(i, j) for i, j in itertools.combinations(range(len(own)), 2) if (own[i] ^ own[j]).bit_count() <= 4}
        return
    df = spark.createDataFrame([(d, signed(x)) for d, x in prints], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert got == slow_components(prints)


def test_documents_against_all_pairs(spark):
    from conftest import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, slow_print(r.text)) for r in rows]
    want = slow_components(prints)
    got = simhash.simhash_components(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{x:016x}", want[d]) for d, x in prints}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "some words that stand here"), (None, "some words that stand here"), (4, "some words that stand here"), (9, "others, nothing in common with these"), (8, "x" * 200_000 + " y")]
    df = spark.createDataFrame([(d, t, "fp", "component_id") for d, t in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None), (8, 8), (9, 9)], key=str)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "4", "8", "9", "None"]
    assert simhash.simhash_components(df.limit(0)).count() == 0
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_components(df, 3)


def test_component_rounds(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in shared.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {500: 400}
    assert shared.connected_components(edges.limit(0)).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_near_copies(rows):
    """Smallest doc_id reachable by a Jaccard similarity of 0.8 of five-word shingles, all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if root[a] != root[b] and 5 * len(x & y) >= 4 * len(x | y):
            lo, hi = sorted((root[a], root[b]))
            root = {d: lo if r == hi else r for d, r in root.items()}
    return {d for d, r in root.items() if r == d}


def test_near_copies_of_documents(spark):
    from conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == slow_near_copies([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("tile", [1 << 11, 3])
def test_near_copies_are_verified(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_DOCS", tile)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):  # copies with a few words changed, and texts that differ beside one repeated line
        text = rng.choices(words, k=300)
        for _ in range(7):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for i in rng.sample(range(300), 3):
                text[i] = rng.choice(words)
    line = " ".join(rng.choices(words, k=12)) + "\n"
    rows += [(len(rows) + i, line * 200 + " ".join(rng.choices(words, k=60))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert got == slow_near_copies(rows) and len(got) == 18


def test_rows_that_share_an_id(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    kept = lambda rows: sorted(map(tuple, simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert kept([(2, x), (4, y), (4, x)]) == [(2, x), (4, y)]
    assert kept([(4, y), (4, z)]) == [(4, y), (4, z)]
    got = simhash.drop_near_copies(spark.createDataFrame([(4, y), (4, y), (5, y.upper() + "\n"), (None, y)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == [(4, y), (None, y)]


def test_hot_cells_are_dealt_again(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = []
    for i in range(300):  # one family that agrees in the first 40 bits, and others
        x = base
        for b in rng.sample(range(24), rng.randint(0, 9)):
            x ^= 1 << b
        prints.append((i, x))
    prints += [(i, rng.getrandbits(64)) for i in range(300, 350)]
    monkeypatch.setattr(simhash, "HOT_ROWS", 40)
    df = spark.createDataFrame([(d, signed(x)) for d, x in prints], "doc_id long, fp long")
    nodes = df.select("fp", df.doc_id.alias("rep"))
    assert simhash._dealt(nodes.selectExpr("0 as k", "fp", "rep"), 4, 2).select("depth").distinct().count() > 3
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert got == slow_components(prints)


def test_recall_of_short_near_copies(spark):
    """Of planted copies of short texts that differ by a word at the end, which four prints may miss, at least 0.95 are dropped."""
    rng, rows = random.Random(6), []
    for k in range(400):
        words = [f"q{rng.randrange(5000)}" for _ in range(rng.randint(30, 80))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + ["end"] if k % 2 else words[:-1]))]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * k for k in range(400)} and len(kept) <= 400 + 20


def test_unlike_prints_that_share_an_id(spark):
    """An id that stands at several prints links none of them."""
    rng = random.Random(8)
    prints = [(5, 0), (5, 0x0F0F0F0F0F0F0F0F), (3, 1)] + [(rng.randrange(20), rng.getrandbits(64)) for _ in range(60)]
    prints += [(rng.randrange(20), x ^ 3) for _, x in prints[::4]]
    root = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4 and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    least = {r: min(prints[k][0] for k in range(len(prints)) if root[k] == r) for r in root}
    df = spark.createDataFrame([(d, signed(x)) for d, x in prints], "doc_id long, fp long")
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.near_components(df).collect())
    assert got == sorted((d, signed(x), least[r]) for (d, x), r in zip(prints, root))
