"""LM scoring: base scores against plain counts, the model against its definition, what it learns, odd rows and tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ostinato.llm import attention, lm_scoring

DOCS = "doc_id long, text string, lang string, score double, key long, words string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0.5, 3, "x") for i, t in rows], DOCS)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def corpus(n, seed=1):
    pick = random.Random(seed)
    grammar = {"en": (["the", "an"], ["cat", "dog", "tree"], ["sees", "likes"]), "de": (["der", "ein"], ["Baum", "Hund"], ["sieht", "mag"])}
    out = []
    for i in range(n):
        parts = grammar[pick.choice(list(grammar))]
        out.append((i, " ".join(pick.choice(parts[k % 3]) for k in range(pick.randrange(3, 90)))))
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def test_base_scores_are_plain_counts(spark):
    rows = [*corpus(60), (61, None), (62, ""), (None, "nulÄ THE"), (3, "twice the"), (3, "twice the"), (64, "\x1c odd  space\x0b\x0cx"), (65, "seldom " * 70 + "w" * 300), (70, " ".join(f"n{k}" for k in range(50_000)))]
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    ends = sum(not held(i) for i, _ in rows)
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in rows:
        own = [counts[w] for w in split(t)] + [ends]
        want.append((i, held(i), len(own), sum(c > 0 for c in own), total, sum(math.log10((c + 1) / (total + distinct + 1)) for c in own)))
    made = lm_scoring.score(table(spark, rows), rounds=1).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for got, exact in zip(sorted(map(tuple, made), key=order), sorted(want, key=order), strict=True):
        assert got[:5] == exact[:5] and math.isclose(got[5], exact[5], rel_tol=1e-9)
        assert got[6] < 0 and math.isfinite(got[6])
    twice = [r["score"] for r in made if r["doc_id"] == 3 and r["n_tokens"] == 3]
    assert len(twice) == 2 and math.isclose(*twice, rel_tol=1e-4)


def test_rare_words_are_counted_too(spark, monkeypatch):
    rows = corpus(40)
    whole = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(table(spark, rows), rounds=1).collect()}
    monkeypatch.setattr(lm_scoring.head_threshold, "__defaults__", (4,))
    few = {r["doc_id"]: r["base_score"] for r in lm_scoring.score(table(spark, rows), rounds=1).collect()}
    assert whole.keys() == few.keys() and all(math.isclose(whole[i], few[i], rel_tol=1e-9) for i in whole)


def test_what_it_learns_holds_for_documents_it_never_saw(spark):
    rows = corpus(900, 5)
    docs = table(spark, rows)
    plain = {r["doc_id"]: r for r in lm_scoring.score(docs, rounds=0).collect()}
    taught = {r["doc_id"]: r for r in lm_scoring.score(docs, rounds=3).collect()}
    unseen = [i for i, _ in rows if held(i)]
    per_token = lambda made, column: sum(made[i][column] for i in unseen) / sum(made[i]["n_tokens"] for i in unseen)
    assert len(unseen) > 80
    assert per_token(taught, "score") > per_token(plain, "score") + 0.1
    assert per_token(taught, "score") > per_token(taught, "base_score")  # order tells more than counts


def test_tables_without_rows_or_without_training_documents(spark):
    docs = table(spark, corpus(30))
    assert lm_scoring.score(docs.where("false")).count() == 0
    only = [i for i in range(200) if held(i)]
    made = lm_scoring.score(table(spark, [(i, "a b") for i in only])).collect()
    assert len(made) == len(only) and {(r["train_tokens"], r["n_known"], r["base_score"]) for r in made} == {(0, 0, 0.0)}


def codes(n=40, classes=5, seed=3):
    draw = np.random.default_rng(seed)
    made = lm_scoring.Codes(draw.integers(0, 50, n), draw.random(n) < 0.4, 16, classes)
    before, ids = draw.integers(0, classes, 60), draw.permutation(np.repeat(np.flatnonzero(~made.begins), 9))[:60]
    pairs = np.unique(np.stack([before, ids]), axis=1)
    made.learn_pairs(*pairs, draw.integers(1, 9, pairs.shape[1]))
    return made


def model(made, seed=4):
    shape = attention.Shape(16, made.classes, 6, 8)
    draw = np.random.default_rng(seed)
    return shape, {name: draw.normal(0, 0.7, size).astype(np.float32) for name, size in attention.sizes(shape).items()}


def test_probabilities_of_all_ids_add_up_to_one():
    made = codes()
    shape, weights = model(made)
    scorer = lm_scoring.Scorer(attention.flat(weights), made, shape, 5)
    for start in ([7], [7, 3, 9], [1] * 12):
        total = 0.0
        prefix = scorer(np.asarray([*start]), np.asarray([len(start)]))[0] if len(start) > 1 else 0.0
        for i in range(len(made.cls)):
            total += math.exp(scorer(np.asarray([*start, i]), np.asarray([len(start) + 1]))[0] - prefix)
        assert abs(total - 1) < 1e-3


def test_each_id_is_scored_once_with_what_its_window_has_before_it():
    made = codes()
    shape, weights = model(made)
    draw = np.random.default_rng(9)
    lengths = [2, 3, 8, 9, 10, 14, 15, 40, 2, 101]
    ids, ends = draw.integers(0, 40, sum(lengths)), np.cumsum(lengths)
    for stride in (3, 5, 7):
        scorer = lm_scoring.Scorer(attention.flat(weights), made, shape, stride)
        scorer.at_once = 4
        for own, got in zip(np.split(ids, ends[:-1]), scorer(ids, ends), strict=True):
            want = 0.0
            for t in range(1, len(own)):
                first = 0 if t <= shape.window else -(-(t - shape.window) // stride) * stride
                window = own[first:t]
                logs = attention.log_probabilities(weights, made.slot[window][None], made.cls[own[first + 1 : t + 1]][None])
                want += logs[0, -1] + made.within[own[t], made.cls[own[t - 1]]]
            assert math.isclose(got, want, rel_tol=1e-4)


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(0)
    shape = attention.Shape(7, 5, 4, 6)
    w = {name: draw.normal(0, 0.5, size) for name, size in attention.sizes(shape).items()}
    slots, targets = draw.integers(0, 7, (3, 6)), draw.integers(0, 5, (3, 6))
    targets[0, 4:] = -1
    _, grad = attention.gradients(w, slots, targets)
    for name in w:
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in w[name].shape)
            was, sides = w[name][at], []
            for step in (1e-5, -1e-5):
                w[name][at] = was + step
                sides.append(attention.gradients(w, slots, targets)[0])
            w[name][at] = was
            assert math.isclose((sides[0] - sides[1]) / 2e-5, grad[name][at], rel_tol=1e-4, abs_tol=1e-7)


def test_later_ids_do_not_change_earlier_probabilities():
    shape, weights = model(codes())
    draw = np.random.default_rng(2)
    slots, targets = draw.integers(0, 16, (2, 8)), draw.integers(0, 5, (2, 8))
    before = attention.log_probabilities(weights, slots, targets)
    slots[:, 5:] = draw.integers(0, 16, (2, 3))
    assert np.allclose(before[:, :5], attention.log_probabilities(weights, slots, targets)[:, :5])
    assert np.allclose(attention.log_probabilities(weights, slots, targets)[:, 3:], attention.log_probabilities(weights, slots, targets, 3))


def test_every_id_of_the_training_documents_is_learned_from_once(spark):
    texts = [None, "", "one", " ".join(f"w{k % 700}" for k in range(9000)), "the cat " * 12, "the cat " * 12]
    docs = spark.createDataFrame([(None if t is None else t.encode(),) for t in texts], "text binary")
    end = lm_scoring.encoding(lm_scoring.RANKS_FILE).n_vocab
    made = lm_scoring.training_windows(docs, end, lm_scoring.RANKS_FILE, {}).collect()
    windows = np.concatenate([np.frombuffer(r["ids"], np.int32) for r in made]).reshape(-1, lm_scoring.WINDOW + 1)
    told = Counter(windows[:, 1:][windows[:, 1:] >= 0].tolist())
    want = Counter(i for t in texts for w in (t or "").split() for i in lm_scoring.subwords(w.encode()))
    want[end] = len(texts)
    assert told == want


@pytest.mark.parametrize("at", [0, 1, 5, 700, 1500])
def test_windows_begin_and_end_at_words(at):
    words = [f"W{k:04d}" for k in range(300)]
    found, begins, ends = lm_scoring.window_words(" ".join(words).encode(), at, 100)
    assert begins == (at == 0) and ends == (at + 100 >= 1799) and all(w in [x.lower().encode() for x in words] for w in found)
    assert lm_scoring.window_words(b"", 0) == ([], True, True)


def test_subwords_join_to_the_word():
    own = lm_scoring.encoding(lm_scoring.RANKS_FILE)
    for word in ("the", "über-lang,", "x" * 500, "don't", "42nd"):
        ids = lm_scoring.subwords(word.encode())
        assert own.decode(ids) == " " + word and lm_scoring.begins_word()[ids].tolist() == [True] + [False] * (len(ids) - 1)


def test_many_words_at_once_are_encoded_as_each_alone():
    words = ["the", "Ärger", "x\u00a0y", "\u00a0", "don't", "'s", "...", "a" * 70, "42nd", "\u4e2d\u6587", "\x1c", "e\u0301", "\u2003", "-", "\ufffd"]
    raw = [w.encode() for w in words] * 200
    assert lm_scoring.subwords_of_all(raw, at_once=7) == [lm_scoring.subwords(w) for w in raw]
    assert lm_scoring.subwords_of_all([]) == []


def test_ids_are_kept_and_dealt_in_two_bytes_and_each_round_has_its_share(spark):
    texts = ["", "one", " ".join(f"w{k % 700}" for k in range(9000)), "the cat " * 12, "x" * 200 + " the   y"]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "doc_id long, text binary")
    end = lm_scoring.encoding(lm_scoring.RANKS_FILE).n_vocab
    encoded = lm_scoring.encoded_texts(docs, end, lm_scoring.RANKS_FILE, {})
    own = {r["doc_id"]: np.frombuffer(r["ids"], np.uint16).tolist() for r in encoded.collect()}
    assert own == {i: [end, *(x for w in t.encode().split() for x in lm_scoring.subwords(w)), end] for i, t in enumerate(texts)}
    deal = lambda **turn: sorted((r["place"], r["ids"]) for r in lm_scoring.windows_of(encoded, end, **turn).collect())
    assert deal() == sorted(deal(rounds=2, turn=0) + deal(rounds=2, turn=1))
    assert sum(len(x) for _, x in deal()) == 2 * sum(-(-(len(x) - 1) // lm_scoring.WINDOW) * (lm_scoring.WINDOW + 1) for x in own.values())


def test_examples_of_windows_that_end_early():
    made = codes()
    ids = np.asarray([[3, 7, 39, 2], [5, 0, -1, -1]], np.int32)
    slots, classes = lm_scoring.examples(ids, made)
    numbers = made.number
    assert slots[0].tolist() == made.slot[numbers[[3, 7, 39]]].tolist() and slots[1, :2].tolist() == made.slot[numbers[[5, 0]]].tolist()
    assert classes.tolist() == [made.cls[numbers[[7, 39, 2]]].tolist(), [made.cls[numbers[0]], -1, -1]]


def test_windows_are_cut_only_for_the_round_that_takes_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 9}" for k in range(40)).encode()) for i in range(40)], "doc_id long, text binary")
    end = lm_scoring.encoding(lm_scoring.RANKS_FILE).n_vocab
    ids = lm_scoring.encoded_texts(docs, end, lm_scoring.RANKS_FILE, {}).collect()
    cut, plain = [], lm_scoring.cut_in_windows
    monkeypatch.setattr(lm_scoring, "cut_in_windows", lambda *a: cut.append(1) or plain(*a))
    steps = []
    monkeypatch.setattr(lm_scoring, "map_rows", lambda df, step, schema, *_: steps.append(step()))
    made = []
    for turn in (0, 1):
        lm_scoring.windows_of(spark.createDataFrame(ids), end, rounds=2, turn=turn)
        made.append(steps[-1]({"key": [r["key"] for r in ids], "ids": [bytes(r["ids"]) for r in ids]})["place"])
    assert len(cut) == 40 and len(set(made[0] + made[1])) == 40 and min(map(len, made)) > 8  # copies have places of their own


def test_windows_overlap_by_one_id():
    for n in (2, 3, 5, 6, 13):
        made = lm_scoring.cut_in_windows(np.arange(n, dtype=np.uint16), 4)
        assert [x for row in made for x in row[1:].tolist() if x < 65535] == list(range(1, n))
        assert all(row[0] == 4 * k for k, row in enumerate(made))


def test_texts_and_ids_are_in_python_a_slice_at_a_time(spark, monkeypatch):
    sizes, plain = [], lm_scoring.map_rows
    monkeypatch.setattr(lm_scoring, "map_rows", lambda df, step, schema, size=None: sizes.append((df.columns, size)) or plain(df, step, schema, size))
    lm_scoring.score(table(spark, corpus(20)), rounds=0).count()
    bounded = [columns for columns, size in sizes if size == lm_scoring.BLOCK_BYTES]
    assert ["doc_id", "text"] in bounded and any("ids" in columns and "key" in columns for columns in bounded)
    monkeypatch.undo()
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 300)
    docs = spark.createDataFrame([(i, b"some words of a text" * 5) for i in range(40)], "doc_id long, text binary").coalesce(1)
    end = lm_scoring.encoding(lm_scoring.RANKS_FILE).n_vocab
    keys = [r["key"] for r in lm_scoring.encoded_texts(docs, end, lm_scoring.RANKS_FILE, {}).collect()]
    assert sorted(keys) == list(range(40))
