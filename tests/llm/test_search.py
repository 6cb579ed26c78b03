"""The divergence audit and the lexical search against plain loops, and on odd rows and tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ostinato.llm import divergence, lexical

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, term string, value long"
ITEMS = "item_id long, text string, score long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 7, "x", 9) for i, t, lang, s in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_audit(rows, least=3, most=200):
    docs = [(lang or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))) for _, t, lang, s in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in holders.items() if n >= least}
        counts = defaultdict(Counter)
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p(counts[s], t), p(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(-f(p(counts[s], t), p(whole, t)), t) for t in counts[s] if p(counts[s], t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def corpus(n, seed=1):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "écrire", "Éa", "delta7x", "zeta", "eta-theta", "iota", "kappa", "ñu"]
    rows = [(i, " ".join(pick.choices(words[pick.randrange(4) :], k=pick.randrange(30))), pick.choice(["en", "fr"]), pick.choice(["a", "b", "c", "É"])) for i in range(n)]
    return [*rows, (n, None, "en", "a"), (n + 1, "", "en", "only empty"), (n + 2, "beta beta beta", None, None), (n + 3, "1234", "de", None), (n + 4, "solo", "xx", "one"), (n, None, "en", "a"), (3, rows[3][1], rows[3][2], rows[3][3])]


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_the_audit_is_the_plain_sum_over_all_kept_terms(spark, least):
    rows = corpus(120)
    got = divergence.audit(table(spark, rows), least_documents=least).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_audit(rows, least)


def test_the_audit_ranks_in_parts_and_blocks(spark, monkeypatch):
    rows = corpus(80, 2)
    monkeypatch.setattr(divergence, "SOURCES_A_CELL", 1)
    monkeypatch.setattr(divergence, "SMALL_TABLE", 0)
    assert {tuple(r) for r in divergence.audit(table(spark, rows), most_terms=2).collect()} == plain_audit(rows, most=2)


def test_the_audit_of_no_rows_and_of_long_texts(spark):
    assert divergence.audit(table(spark, corpus(5)).where("false")).count() == 0
    rows = [(k, "beta " * 200_000 + "gamma" * k, "en", s) for k, s in enumerate("aabbab")]
    assert {tuple(r) for r in divergence.audit(table(spark, rows)).collect()} == plain_audit(rows)


def plain_search(items, docs, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, Counter(split(t))) for i, t, *_ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def asked(spark, items):
    return spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)


def shown(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(("results", "seed"), [(20, 1), (3, 2), (1, 3)])
def test_the_search_is_the_plain_ranking(spark, results, seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "x9", "MiXed"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(pick.choices(words, weights, k=n)) + pick.choice(["", ".", "-tail"])
    docs = [(k, text(pick.randrange(1, 60)), "en", "s") for k in range(400)]
    docs += [(1000 + k, docs[5][1], "en", "s") for k in range(40)]  # ties
    docs += [(7, docs[7][1], "en", "s"), (None, docs[5][1], None, None), (2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "-- !", "en", "s"), (2003, "w1 w2 " * 100_000, "en", "s")]
    items = [(k, text(12)) for k in range(12)] + [(50, docs[5][1]), (51, None), (52, ""), (53, "nowhere"), (54, "w0 w0 w0 x9"), (54, "x9"), (None, "w3 w4 w5")]
    got = lexical.search(asked(spark, items), table(spark, docs), results=results).collect()
    assert shown(got) == shown(plain_search(items, docs, results))


def test_items_beyond_a_pass_are_sought_in_others(spark):
    docs = [(k, f"a{k % 7} b{k % 5} c{k % 3}", "en", "s") for k in range(100)]
    items = [(k, f"a{k % 7} b{k % 4}") for k in range(9)]
    assert shown(lexical.search(asked(spark, items), table(spark, docs), terms_a_pass=5).collect()) == shown(plain_search(items, docs))


def test_the_search_of_empty_tables(spark):
    docs, items = [(1, "a b", "en", "s")], [(1, "a"), (2, "c")]
    assert lexical.search(asked(spark, items).where("false"), table(spark, docs)).count() == 0
    assert lexical.search(asked(spark, items), table(spark, docs).where("false")).count() == 0
    assert lexical.search(asked(spark, [(9, None)]), table(spark, docs)).count() == 0


def test_terms_that_cannot_reach_the_threshold_bring_no_candidates():
    import numpy as np

    item = lexical.Item(1, np.array([4, 9]), np.array([10, 1]), np.array([100, 5, 0]), 50)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [1, 2, 3], "n": [10, 10, 10], "terms": pa.array([[4], [9], [9, 4]], pa.list_(pa.int32())), "counts": pa.array([[1], [3], [1, 2]], pa.list_(pa.int64()))}
    )
    postings = lexical.Postings(batch, 3, 30)
    found, made = lexical.candidates(item, postings, item.threshold, np.zeros(3, np.int64), np.zeros(3, bool))
    assert found.tolist() == [0, 2]
    assert made.tolist() == [10 * (10**9 // 2200), 10 * (2 * 10**9 // 3200) + 10**9 // 2200]
