"""Segmentations against the enumeration of all ways through a small lattice, and round trips of whole texts."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ostinato.llm import pieces
from ostinato.llm.pieces import MARK, PARTS, Vocabulary
from ostinato.llm.rows import slices

SCHEMA = "doc_id long, text string"


def small() -> Vocabulary:
    """Letters a to c, some longer pieces, and bytes for all else."""
    own = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], MARK, "a", "b", "c", "ab", "bc", "abc", f"{MARK}a", f"{MARK}ab", "ca", "aa"]
    scores = [pieces.NEVER] * 257 + [-(i * 37 % 101 + 5) * 1000 for i in range(len(own) - 257)]
    return Vocabulary(own, scores, list(range(1, 257)), min(scores[257:]) - PARTS)


def every_way(vocabulary: Vocabulary, text: str):
    """(score, ids) of all segmentations of the marked text that never join a character to a following mark."""
    by_piece = {p: (i, s) for i, (p, s) in enumerate(zip(vocabulary.pieces, [vocabulary_score(vocabulary, p) for p in vocabulary.pieces], strict=True)) if s is not None}

    def go(at):
        if at == len(text):
            yield 0, ()
            return
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in by_piece:
                i, s = by_piece[text[at:end]]
                for rest, ids in go(end):
                    yield s + rest, (i, *ids)
        if text[at] not in by_piece:
            raw = text[at].encode()
            for rest, ids in go(at + 1):
                yield vocabulary.byte_score * len(raw) + rest, (*[vocabulary.byte_ids[b] for b in raw], *ids)

    return sorted(go(0), key=lambda x: -x[0])


def vocabulary_score(vocabulary: Vocabulary, piece: str):
    node, into = None, vocabulary.trie
    for c in piece:
        if c not in into:
            return None
        node = into[c]
        into = node[2]
    return node[1] if node is not None and node[0] >= 0 else None


def applied(ids: list[int], edits) -> list[int]:
    out, at = [], 0
    for start, drop, new in sorted(edits):
        out += [*ids[at:start], *new]
        at = start + drop
    return out + ids[at:]


@pytest.mark.parametrize("seed", range(6))
def test_the_n_best_are_those_of_all_ways(seed):
    r, vocabulary = random.Random(seed), small()
    encoder = pieces.Encoder(vocabulary, 5)
    for _ in range(40):
        text = "".join(r.choice("aabbcc  é") for _ in range(r.randrange(1, 10)))
        ids, score, others = encoder.encode(text)
        ways = every_way(vocabulary, MARK + text.replace(" ", MARK))
        assert score == ways[0][0]
        assert [score, *(s for s, _ in others)] == [s for s, _ in ways[:5]]
        legal = dict.fromkeys(i for _, i in ways)
        made = [tuple(ids), *(tuple(applied(ids, e)) for _, e in others)]
        assert len(set(made)) == len(made)
        assert all(m in legal for m in made)
        assert all(pieces.decode(vocabulary, list(m)) == text for m in made)


def test_a_star_search_of_one_chunk():
    vocabulary = small()
    for chunk in ("abcabc", "aaaa", f"{MARK}abca", "b", "éa"):
        want = every_way(vocabulary, chunk)[:6]
        got = pieces.n_best(vocabulary, chunk, 6)
        assert [s for s, _ in got] == [s for s, _ in want]
        assert len({i for _, i in got}) == len(got)


def test_texts_go_round(spark):
    r = random.Random(1)
    alphabet = "abc XYZ 019 \n\té ß 日本 😀 ​.,"
    texts = ["", " ", "  two  spaces ", None, "plain words here", "\x00\x01", *["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(40)], "x" * 50_000, "word " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).withColumn("ids", F.lit("clash")).withColumn("scores", F.lit(1))
    made = {x["doc_id"]: x for x in pieces.encode_texts(docs).collect()}
    assert len(made) == len(texts)
    for i, text in enumerate(texts):
        assert made[i]["round_trip"] is (None if text is None else True)
        assert made[i]["scores"] == sorted(made[i]["scores"], reverse=True)
        assert (made[i]["ids"] is None) == (text is None)
    back = {x["doc_id"]: x["text"] for x in pieces.decode_ids(pieces.encode_texts(docs)).collect()}
    assert back == dict(enumerate(texts))


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], SCHEMA)
    assert pieces.encode_texts(docs.where("doc_id = 5")).count() == 0
    assert len({str(x["ids"]) for x in pieces.encode_texts(docs).collect()}) == 1


def test_all_documents_of_the_query(spark, data):
    made = pieces.op10_piece_segmentation(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert made.count() == docs.count()
    assert made.where("not round_trip").count() == 0
    assert made.where("size(scores) = 0 and ids is not null").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_chunks_that_go_together_are_segmented_as_each_alone(seed, monkeypatch):
    r, vocabulary = random.Random(seed), small()
    chunks = sorted({"".join(r.choice(f"aabbcc{MARK}é\x00日😀") for _ in range(r.randrange(1, 14))) for _ in range(300)}, key=len, reverse=True)
    ids, lengths, scores, margins = pieces.forward_all(vocabulary, vocabulary.links.by_code(), chunks)
    for chunk, end, n, score, margin in zip(chunks, lengths.cumsum().tolist(), lengths.tolist(), scores.tolist(), margins.tolist(), strict=True):
        best, own, alone = pieces.forward(vocabulary, chunk)
        assert (tuple(ids[end - n : end].tolist()), score, margin) == (own, best[-1], alone)
    # Short chunks never go alone, and what is forgotten between blocks or too long for keeping changes nothing.
    texts = ["".join(r.choice("abc  é") for _ in range(r.randrange(80))) for _ in range(60)]
    whole = [(ids.tolist(), score, others) for ids, score, others in pieces.Encoder(vocabulary, 4).encode_all(texts)]
    monkeypatch.setattr(pieces, "KEPT_LENGTH", 3)
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 5)
    encoder = pieces.Encoder(vocabulary, 4)
    assert [encoder.encode(text) for text in texts] == whole
    monkeypatch.undo()
    monkeypatch.setattr(pieces, "forward", lambda *_: pytest.fail("a chunk went alone"))
    pieces.Encoder(vocabulary, 1).encode("ab ca abc")


def test_links_lead_where_the_trie_does():
    vocabulary = pieces.load_vocabulary()
    links, by_code = vocabulary.links, vocabulary.links.by_code()
    for piece in [*vocabulary.pieces[300::97], "\x00", "qqzx"]:
        node, into, known = 0, vocabulary.trie, None
        for c in piece:
            place = links.base[node] + by_code[ord(c)]
            assert (links.owner[place] == node) == (c in into)
            if c not in into:
                break
            known, node = into[c], links.target[place]
            into = known[2]
            assert (links.ids[node], links.scores[node]) == tuple(known[:2])
    assert len(links.owner) < 8 * len(links.ids)


def test_memory_of_many_new_chunks_is_bounded():
    r = random.Random(3)
    encoder, texts = pieces.Encoder(small(), 1), [" ".join("".join(r.choices("abc", k=5 if i else 40)) + chr(200 + i) * (i > 0) for i in range(400)) for _ in range(150)]
    tracemalloc.start()
    try:
        numbers = [encoder.kept[MARK + chunk] for text in texts for chunk in text.split(" ")]
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        encoder.learn()
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(set(numbers)) > 40_000 and peak < 32 << 20, peak


def test_batches_are_sliced_by_their_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 100})
    assert [x.num_rows for x in slices(batch, 10_000)] == [9] * 11 + [1]
    assert [x.num_rows for x in slices(batch, None)] == [100]
    assert [x.num_rows for x in slices(batch, 1)] == [1] * 100
    assert [x.num_rows for x in slices(batch.slice(0, 0), 10)] == [0]
