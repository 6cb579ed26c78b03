"""The two similarity joins against brute force, connected components against a union find."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from ostinato.llm import metric_join, ngram_join
from ostinato.llm.components import connected_components
from ostinato.llm.shingles import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def grams(text: str) -> set:
    """The definition in plain Python."""
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts: list[str | None]) -> tuple[list[int], list[int]]:
    sets = [grams(t) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    counts = [0] * len(texts)
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    return counts, roots(len(texts), links)


def corpus(seed: int, n: int) -> list[str]:
    """Random texts, and copies of them with more and more words changed: many pairs close to the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        own = [r.choice(vocabulary) for _ in range(r.randrange(3, 160))]
        texts.append(" ".join(own))
        for _ in range(r.randrange(0, 5)):
            own = own[:]
            for _ in range(r.randrange(0, max(2, len(own) // 25))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    return texts[:n]


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)


def found(df):
    rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    return [r["n_links"] for r in rows], [r["component_id"] for r in rows], [r["kept"] for r in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_those_of_brute_force(spark, seed):
    texts = corpus(seed, 260)
    counts, components = brute(texts)
    links, ids, kept = found(ngram_join.near_duplicates(table(spark, texts)))
    assert links == counts
    assert ids == components
    assert kept == [i == c for i, c in enumerate(components)]


def test_near_duplicates_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    ids = [r["doc_id"] for r in rows]
    counts, components = brute([r["text"] for r in rows])
    links, got, _ = found(ngram_join.near_duplicates(docs))
    assert links == counts
    assert got == [ids[c] for c in components]


def test_a_large_group_goes_through_several_blocks(spark):
    r = random.Random(5)
    base = [f"x{r.randrange(999)}" for _ in range(120)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(120) for _ in (0, 1)] + [" ".join(base)] * 80
    counts, components = brute(texts)
    links, ids, _ = found(ngram_join.near_duplicates(table(spark, texts * 1)))
    assert links == counts
    assert ids == components


def test_near_duplicates_nulls_empties_repeats_and_clashing_names(spark):
    texts = [None, "", "  \n", "one two", "One, two!", "one two three", "a b c d e f", "a b c d e f"]
    counts, components = brute(texts)
    docs = table(spark, texts)
    for name in ("key", "g", "component", "rep", "node", "links", "k", "block", "first"):
        docs = docs.selectExpr("*", f"'clash' AS `{name}`")
    extra = docs.where("doc_id = 6").selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:])
    made = ngram_join.near_duplicates(docs.unionByName(extra)).collect()
    assert len(made) == 9
    by = {r["doc_id"]: r for r in made}
    assert by[None]["kept"] and by[None]["n_links"] == 0 and by[None]["component_id"] is None
    assert [by[i]["n_links"] for i in range(8)] == counts
    assert [by[i]["component_id"] for i in range(8)] == components
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    again = ngram_join.near_duplicates(docs.where("doc_id in (6)").unionByName(docs.where("doc_id = 6"))).collect()
    assert [(r["doc_id"], r["component_id"]) for r in again] == [(6, 6), (6, 6)]


def test_dropping_near_duplicates_keeps_clean_documents(spark):
    texts = corpus(9, 120)
    _, components = brute(texts)
    kept = ngram_join.drop_near_duplicates(table(spark, [*texts, None, ""]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [*sorted(set(components)), 120, 121]


def test_a_very_long_text_is_read_to_its_end(spark):
    words = [f"t{i * 7 % 9973}x{i}" for i in range(120_000)]
    texts = [" ".join(words), " ".join(words[:-3000] + ["new"] * 3000), " ".join(words[:60_000])]
    links, ids, _ = found(ngram_join.near_duplicates(table(spark, texts)))
    assert links == [1, 1, 0] and ids == [0, 0, 2]


def test_shingles_are_sets_of_five_words():
    assert len(shingles("a b c d e f g a b c d e")) == len(grams("a b c d e f g a b c d e"))
    assert np.array_equal(shingles("A b, c D e"), shingles("a B c d E!"))
    assert len(shingles(None)) == len(shingles("...")) == 0
    assert len(shingles("two words")) == 1


def test_prefixes_shorten_until_the_target():
    length = ngram_join.prefix_length(0.8)
    assert 1 - (1 - 0.8**length) ** ngram_join.TREES >= ngram_join.TARGET > 1 - (1 - 0.8 ** (length + 1)) ** ngram_join.TREES
    assert ngram_join.prefix_length(0.1, target=0.999999) == 1


def test_floors_suit_all_partners_of_a_size():
    for n in range(1, 40):
        possible = [i / (n + m - i) for m in range(1, 80) for i in range(1, min(n, m) + 1) if i / (n + m - i) >= 0.8 and not i == n == m]
        least = ngram_join.least_similarity(n, 0.8)
        assert least == (pytest.approx(min(possible)) if possible else None)
    floor = lambda n: ngram_join.floor_length(n, 0.8, ngram_join.TREES, ngram_join.LONGEST, ngram_join.TARGET)
    assert floor(3) == ngram_join.LONGEST + 1  # no other set is as close as 0.8
    assert floor(6) > floor(4) == floor(1000) == ngram_join.prefix_length(0.8)


def test_the_forest_links_all_that_share_a_prefix_and_no_others(spark):
    r = random.Random(8)
    rows = [(bytes([k]), r.choice([2, 2, 3, 4]), [(t << 8) + r.randrange(12) for t in range(3)], [r.randrange(1 << 63) & r.choice([0, 3 << 60, -1 & ((1 << 63) - 1)]) for _ in range(3)]) for k in range(90)]
    classes = spark.createDataFrame(rows, "key binary, floor int, roots array<long>, suffixes array<long>")
    links = [(bytes(x["u"])[0], bytes(x["v"])[0]) for x in ngram_join.forest_links(classes, 2, 4).collect()]
    bits, want = ngram_join.suffix_bits(2, 4), []
    for (a, fa, ra, sa), (b, fb, rb, sb) in combinations(rows, 2):
        for t in range(3):
            shift = bits * (4 - max(fa, fb))
            if ra[t] == rb[t] and sa[t] >> shift == sb[t] >> shift:
                want.append((a[0], b[0]))
    assert len(set(roots(90, want))) > 3
    assert roots(90, links) == roots(90, want)


def test_paths_are_prefixes_of_one_signature():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.concatenate((a[:-20], r.integers(0, 1 << 62, 20).astype(np.uint64)))
    for lowest, longest in ((5, 8), (8, 8)):
        x, y = ngram_join.paths(a, 24, lowest, longest), ngram_join.paths(b, 24, lowest, longest)
        m = ngram_join.minhashes(a, 24 * longest).reshape(24, longest) == ngram_join.minhashes(b, 24 * longest).reshape(24, longest)
        bits = ngram_join.suffix_bits(lowest, longest)
        for length in range(lowest, longest + 1):
            shift = np.int64(min(63, bits * (longest - length)))
            same = (x[0] == y[0]) & (x[1] >> shift == y[1] >> shift)
            assert (same == m[:, :length].all(axis=1)).all()


def test_rows_that_share_an_id_are_lost_only_as_near_duplicates(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 2), (1, b, "en", "x", 2), (2, a, "en", "y", 3), (3, b + " c", "en", "y", 4), (4, "", None, None, 0), (4, "", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3):
        kept = ngram_join.drop_near_duplicates(docs.repartition(n)).collect()
        assert len(kept) == 4 and {(r[0], r[1]) for r in kept} == {(1, a), (1, b), (4, "")}


@pytest.mark.parametrize("seed", [3, 4])
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    edges = spark.createDataFrame(links, "u long, v long")
    got = {x["node"]: x["component"] for x in connected_components(edges).collect()}
    want = roots(400, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(edges.where("u < 0")).count() == 0


# --- vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed: int, n: int) -> list[tuple]:
    """Clusters of vectors about as wide as the threshold."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    rows = []
    for i in range(n):
        v = centres[r.integers(12)] + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])
        rows.append((i, (v * r.uniform(0.1, 9)).astype(np.float32).tolist(), int(r.integers(3)) if i % 17 else None))
    return rows


def brute_vectors(rows):
    def good(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for i, j in combinations(range(len(rows)), 2):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        if x == y and good(a, x) and good(b, y) and len(a) == len(b):
            a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                links.append((i, j))
    counts = [0] * len(rows)
    for i, j in links:
        counts[i] += 1
        counts[j] += 1
    return counts, roots(len(rows), links)


def found_vectors(df):
    rows = sorted(df.collect(), key=lambda r: r["vec_id"])
    return [r["n_links"] for r in rows], [r["component_id"] for r in rows], [r["kept"] for r in rows]


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 500, 256), (2, 400, 16)])
def test_range_join_is_that_of_brute_force(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rows = vectors(seed, n)
    rows += [(n + i, *rows[i % 7][1:]) for i in range(60)]
    counts, components = brute_vectors(rows)
    links, ids, kept = found_vectors(metric_join.range_join(spark.createDataFrame(rows, VECTORS)))
    assert sum(counts) > 200
    assert links == counts
    assert ids == components
    assert kept == [i == c for i, c in enumerate(components)]


def test_range_join_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [0.0, 0.0], 1), (2, [1.0, nan], 1), (3, [inf, 1.0], 1), (4, [1.0, None], 1), (5, [], 1), (6, [1.0, 0.0], None)]
    rows += [(7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [2.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1e30, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("cells", "rep", "good", "a", "b", "l", "x", "copies", "home"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    links, ids, _ = found_vectors(metric_join.range_join(df))
    assert links == [0] * 7 + [3, 3, 0, 0, 3, 3, 0]
    assert ids == [0, 1, 2, 3, 4, 5, 6, 7, 7, 9, 10, 7, 7, 13]
    assert metric_join.range_join(df.where("vec_id < 0")).count() == 0
    assert metric_join.range_join(df.where("vec_id < 6")).count() == 6
    null_id = metric_join.range_join(df.where("vec_id in (7, 8)").unionByName(df.where("vec_id = 7").selectExpr("CAST(NULL AS LONG) AS vec_id", *df.columns[1:]))).collect()
    assert {r["vec_id"]: r["n_links"] for r in null_id} == {7: 1, 8: 1, None: 0}
