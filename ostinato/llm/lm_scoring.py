"""LM scoring: the probability that a small causal self-attention model gives each whole text.

Words become subword ids of a public byte-level vocabulary. A class of about equal frequency stands for each frequent
id, or for several rarer ones; the attention model gives the probability of the next class, and the counts over all
training documents that of the id within it. All ids of all training documents stand in windows to train on, each once as what
is to be told. Tasks train on their own windows from common weights, and the weights are averaged after each round, which
has its share of the windows. A text is scored in windows that overlap, each id once.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import attention
from ostinato.llm.rows import BLOCK_BYTES, arrow_schema, blocks, bounded_batches, map_rows
from ostinato.llm.storage import cut, read_table, stored

RANKS_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that the vocabulary's files split text by before their merges: a fixed value of theirs.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that spaces beyond ASCII may begin with, or be.
SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a|\xe2[\x80\x81]|\xe3\x80")
#: Letters of a word that are merged at once; a longer word is encoded in parts.
PART = 64
#: Ids with an embedding of their own, the most frequent ones; all others share one.
SLOTS = 4096
CLASSES = 64
#: How many counts the share of an id at all is worth where its share after a class is estimated.
PRIOR = 20.0
#: Numbers that stand for an id in the model.
WIDTH = 16
#: Inputs of a window, and how many of them the next window doesn't have.
WINDOW, STRIDE = 24, 20
#: Bytes in which the words from a place in a text on are sought.
WINDOW_BYTES = 1_024
#: Windows that a task trains on, those that move together, and the rounds that share them.
WINDOWS_A_TASK, PACK = 1 << 16, 64
ROUNDS = 2
#: The most frequent words, whose counts every task has.
HEAD_WORDS = 1 << 17
#: Words of which a task keeps the ids.
KEPT_WORDS = 350_000
LEARNING_RATE = 0.02
#: A task with fewer windows learns from fewer at a time.
SMALL = 1 << 14


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def split_words(raw: bytes | None) -> list[bytes]:
    """Words between spaces and the controls from tab to carriage return, A to Z in lower case."""
    return (raw or b"").lower().split()


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("subwords", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def subwords(word: bytes, path: str = RANKS_FILE) -> list[int]:
    """The ids of a word with a space before it."""
    text, encode = word.decode("utf-8", "replace"), encoding(path).encode_ordinary
    if len(text) <= PART:
        return encode(" " + text)
    return [i for at in range(0, len(text), PART) for i in encode((" " if at == 0 else "") + text[at : at + PART])]


def encoded_words(words: list[bytes], path: str = RANKS_FILE, at_once: int = 1024) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words in another order, the ids of all of them one after another, and how many each has; ids as by ``subwords``.

    Short words go to the encoder many at once, as no id reaches over a space. Longer ones, and those that may have a
    space of another kind within, go alone.
    """
    begins, encode = begins_word(path), encoding(path).encode_ordinary
    alone = [w for w in words if len(w) > PART or SPACES.search(w)]
    apart = set(alone)
    plain = [w for w in words if w not in apart] if alone else words
    ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(plain), at_once):
        own = np.asarray(encode(" " + b" ".join(plain[at : at + at_once]).decode("utf-8", "replace")))
        starts = np.flatnonzero(begins[own])
        if len(starts) != len(plain[at : at + at_once]):
            raise ValueError("words and ids don't agree")
        ids.append(own)
        lengths.append(np.diff(np.append(starts, len(own))))
    for word in alone:
        ids.append(np.asarray(subwords(word, path)))
        lengths.append(np.asarray([len(ids[-1])]))
    return plain + alone, np.concatenate(ids), np.concatenate(lengths)


def subwords_of_all(words: list[bytes], path: str = RANKS_FILE, at_once: int = 1024) -> list[list[int]]:
    """``subwords`` of each word."""
    known = list(dict.fromkeys(words))
    order, ids, lengths = encoded_words(known, path, at_once)
    ends, flat = np.cumsum(lengths).tolist(), ids.tolist()
    own = {w: flat[b - n : b] for w, b, n in zip(order, ends, lengths.tolist(), strict=True)}
    return [own[w] for w in words]


@cache
def begins_word(path: str = RANKS_FILE) -> np.ndarray:
    """Which ids begin with a space, as those at the beginning of a word do; and the id of a text's end, the last one."""
    own = encoding(path)
    first = [own.decode_single_token_bytes(i)[:1] == b" " for i in range(own.n_vocab)]
    return np.asarray([*first, True])


class Words(dict):
    """Numbers of words as they come up, with the ids of each and what its count adds to a base score, -1 if that isn't known.

    ``known`` has the logarithms of frequent words.
    """

    def __init__(self, path: str, known: dict[bytes, float]):
        super().__init__()
        self.path, self.known = path, known
        self.words: list[bytes] = []
        self.ids, self.ends, self.adds = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number

    def meet(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The numbers of the words of texts; those without one get the next ones."""
        found = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        met = len(self.adds)
        new = self.words[met:]
        order, ids, lengths = encoded_words(new, self.path)
        rank = np.argsort(np.fromiter(map(self.__getitem__, order), np.int64, len(order)))
        starts, lengths = (np.cumsum(lengths) - lengths)[rank], lengths[rank]
        ends = np.cumsum(lengths)
        self.ids = np.concatenate((self.ids, ids[np.arange(len(ids)) + np.repeat(starts - ends + lengths, lengths)]))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends))
        self.adds = np.concatenate((self.adds, np.fromiter((self.known.get(w, -1.0) for w in new), np.float64, len(new))))
        return found

    def shed(self) -> None:
        """Forgets all words once there are too many; numbers that were given out before say nothing then."""
        if len(self) > KEPT_WORDS:
            self.clear()
            self.__init__(self.path, self.known)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all documents."""

    def step():
        def count(batch: dict[str, list]) -> dict[str, list]:
            found: Counter = Counter()
            for text in batch["text"]:
                found.update(split_words(text))
            return {"word": list(found.keys()), "n": list(found.values())}

        return count

    return map_rows(docs.select("text"), step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_threshold(counts: DataFrame, most: int = HEAD_WORDS) -> int:
    """The least count such that at most so many words have it or more."""
    tally = counts.groupBy("n").agg(F.count("*").alias("words"))
    parts = F.when(F.col("n") < 1 << 16, F.col("n")).otherwise(1 << 16)  # the words of greater counts are few in any text
    total, least = 0, None
    for row in tally.groupBy(parts.alias("n")).agg(F.sum("words").alias("words")).orderBy(F.col("n").desc()).collect():
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def with_subwords(counts: DataFrame, path: str) -> DataFrame:
    """Adds ``ids``: each distinct word is encoded once."""

    def step():
        return lambda batch: {**batch, "ids": subwords_of_all(batch["word"], path)}

    return map_rows(counts.select("word", "n"), step, "word binary, n long, ids array<int>")


def subword_counts(encoded: DataFrame, ends: int, path: str) -> tuple[int, np.ndarray]:
    """The id of a text's end, and the count of each id over all documents, from the counts of their words."""
    end = encoding(path).n_vocab
    out = np.zeros(end + 1, np.int64)
    for row in encoded.select("n", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("n").alias("n")).collect():  # as many as the vocabulary has
        out[row["id"]] = row["n"]
    out[end] = ends
    return end, out


class Codes:
    """The slot and the class of each id, and its probability within its class.

    Ids that begin a word, and all others, have classes of their own, as many as their share of the text; classes are as
    frequent as each other as far as single ids allow. Within a class an id that begins a word has its share of the
    counts. Another one has its share after ids of the class before it, with ``PRIOR`` counts of its share at all.
    """

    def __init__(self, counts: np.ndarray, begins: np.ndarray, slots: int = SLOTS, classes: int = CLASSES):
        order = np.argsort(-counts, kind="stable")
        #: Ids are numbered by falling count; all that follows goes by these numbers, so that what is used most lies together.
        self.number = np.empty(len(counts), np.int64)
        self.number[order] = np.arange(len(counts))
        self.classes, self.begins = classes, begins[order]
        self.slot = np.minimum(np.arange(len(counts)), slots - 1)
        smooth = counts[order] + 1.0
        beginning = min(classes - 1, max(1, round(classes * smooth[self.begins].sum() / smooth.sum())))
        self.cls = np.zeros(len(counts), np.int64)
        for own, first, n in ((self.begins, 0, beginning), (~self.begins, beginning, classes - beginning)):
            place = (np.cumsum(smooth[own]) - smooth[own]) / smooth[own].sum() * n
            self.cls[own] = first + np.minimum(place.astype(np.int64), n - 1)
        self.class_counts = np.bincount(self.cls, counts[order], classes)
        self.share = smooth / np.bincount(self.cls, smooth, classes)[self.cls]
        #: By id and class before it.
        self.within = np.repeat(np.log(self.share)[:, None].astype(np.float32), classes, axis=1)

    def learn_pairs(self, before: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Counts of ids that don't begin a word after an id of a class."""
        sums = np.bincount(before * self.classes + self.cls[ids], n, self.classes**2).reshape(self.classes, self.classes)
        table = PRIOR * self.share[:, None] * np.ones(self.classes)
        table[ids, before] += n
        table = np.log(table / (PRIOR + sums.T[self.cls]))
        self.within[~self.begins] = table[~self.begins]


def pair_counts(encoded: DataFrame, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, number of an id, count) within the words of all documents: a row for each class and id at most."""
    known = encoded.sparkSession.createDataFrame([(i, int(k), int(codes.cls[k])) for i, k in enumerate(codes.number.tolist())], "id int, number int, cls int")
    pairs = F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids")).alias("b"))
    counted = encoded.where(F.size("ids") > 1).select("n", F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))
    before, after = known.select(F.col("id").alias("a"), F.col("cls").alias("before")), known.select(F.col("id").alias("b"), "number")
    made = counted.join(before, "a").join(after, "b").groupBy("before", "number").agg(F.sum("n").alias("n")).toArrow()
    return tuple(made.column(c).to_numpy().astype(np.int64) for c in ("before", "number", "n"))


def window_words(raw: bytes, at: int, size: int = WINDOW_BYTES) -> tuple[list[bytes], bool, bool]:
    """Whole words from a place in a text on, and whether the text begins and ends with them."""
    stop = at + size
    words = split_words(raw[at:stop])
    if at and words and not raw[at - 1 : at].isspace() and not raw[at : at + 1].isspace():
        words = words[1:]  # begun before
    cut_off = stop < len(raw) and not raw[stop - 1 : stop].isspace() and not raw[stop : stop + 1].isspace()
    return words[:-1] if cut_off else words, at == 0, stop >= len(raw)


def number_type(end: int) -> np.dtype:
    """Two bytes for an id where they do, as ids make up most of what is stored and shuffled; the largest value is for none."""
    return np.dtype(np.uint16 if end < np.iinfo(np.uint16).max else np.int32)


def encoded_texts(rows: DataFrame, end: int, path: str, known: dict[bytes, float]) -> DataFrame:
    """(key, doc_id, n_tokens, n_head, head_sum, words, times, ids) of each row, whose text is read and split once for it.

    ``ids`` are those of the whole text with its end before and after them, as numbers of ``number_type``; ``words`` and
    ``times`` are the words that ``known`` doesn't have, the others' sum of logarithms is ``head_sum``.
    """
    shared, kind = rows.sparkSession.sparkContext.broadcast(known), number_type(end)

    def step():
        table = Words(path, shared.value)
        task, made = TaskContext.get().partitionId() << 33, 0

        def block(texts: list[bytes | None], out: dict[str, list]) -> None:
            found = table.meet([split_words(t) for t in texts])
            out["n_tokens"] += [len(x) + 1 for x in found]
            heads = [table.adds[x] for x in found]
            out["n_head"] += [int((a >= 0).sum()) for a in heads]
            out["head_sum"] += [float(a[a >= 0].sum()) for a in heads]
            rest = [np.unique(x[a < 0], return_counts=True) for x, a in zip(found, heads, strict=True)]
            out["words"] += [[table.words[i] for i in which.tolist()] for which, _ in rest]
            out["times"] += [n.tolist() for _, n in rest]
            ids, ends = joined(found, table.ids, table.ends, end)
            out["ids"] += [x.tobytes() for x in np.split(ids.astype(kind), ends[:-1])]

        def call(batch: dict[str, list]) -> dict[str, list]:
            nonlocal made
            texts = batch["text"]
            out: dict[str, list] = {"key": list(range(task + made, task + made + len(texts))), "doc_id": batch["doc_id"]} | {k: [] for k in ("n_tokens", "n_head", "head_sum", "words", "times", "ids")}
            made += len(texts)
            for part in blocks(texts):
                block(part, out)
                table.shed()
            return out

        return call

    schema = "key long, doc_id long, n_tokens long, n_head long, head_sum double, words array<binary>, times array<long>, ids binary"
    return map_rows(rows.select("doc_id", "text"), step, schema, BLOCK_BYTES)


def windows_of(encoded: DataFrame, end: int, *, window: int = WINDOW, rounds: int = 1, turn: int = 0) -> DataFrame:
    """(place, ids): the ids of each row, cut in windows of one more than ``window``; those whose place has its turn in that round.

    A window begins with the last id of the one before it, so each id after the first is to be told once; the largest
    number fills up the last one. ``ids`` has up to ``PACK`` windows of one document, ``place`` is pseudo-random.
    """
    kind = number_type(end)

    def step():
        def take(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"place": [], "ids": []}
            for key, ids in zip(batch["key"], batch["ids"], strict=True):
                own = b"%d %d" % (zlib.crc32(ids), key)  # copies of a text have places of their own
                starts = range(0, windows_in(len(ids) // kind.itemsize, window), PACK)
                taken = [(at, place) for at in starts if (place := pseudo_random(b"%b %d" % (own, at))) % rounds == turn]
                made = cut_in_windows(np.frombuffer(ids, kind), window) if taken else None
                for at, place in taken:
                    out["ids"].append(made[at : at + PACK].tobytes())
                    out["place"].append(place)
            return out

        return take

    return map_rows(encoded.select("key", "ids"), step, "place long, ids binary")


def training_windows(docs: DataFrame, end: int, path: str, known: dict[bytes, float], *, window: int = WINDOW) -> DataFrame:
    """(place, ids): the windows of all texts, as by ``windows_of``, in numbers of four bytes with -1 for none."""

    def step():
        return lambda batch: {"place": batch["place"], "ids": [signed(x, end).tobytes() for x in batch["ids"]]}

    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    return map_rows(windows_of(encoded_texts(rows, end, path, known), end, window=window), step, "place long, ids binary")


def signed(ids: bytes, end: int) -> np.ndarray:
    """Ids of four bytes, with -1 for none."""
    made = np.frombuffer(ids, number_type(end)).astype(np.int32)
    made[made > end] = -1
    return made


def pseudo_random(of: bytes) -> int:
    """62 bits that look drawn at random and are always the same; a generator of its own for each text takes ten times as long."""
    return int.from_bytes(hashlib.blake2b(of, digest_size=8).digest()) >> 2


def windows_in(ids: int, window: int) -> int:
    return max(1, -(-(ids - 1) // window))


def cut_in_windows(ids: np.ndarray, window: int) -> np.ndarray:
    """Windows of ``window`` inputs and the id after each, filled up with the largest number; no id is to be told twice."""
    n = windows_in(len(ids), window)
    filled = np.full(n * window + 1, np.iinfo(ids.dtype).max, ids.dtype)
    filled[: len(ids)] = ids
    made = np.empty((n, window + 1), ids.dtype)
    made[:, :-1], made[:, -1] = filled[:-1].reshape(n, window), filled[window::window]
    return made


def averaged(tasks: DataFrame, groups: int) -> np.ndarray:
    """The mean of the tasks' weights, by their windows: sums of groups of tasks first, so that few rows reach the driver."""
    schema = "task int, windows long, weights binary"
    to = arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, windows = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["weights"], np.float32) * np.float64(row["windows"])
                total = values if total is None else total + values
                windows += row["windows"]
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"task": 0, "windows": windows, "weights": total.tobytes()}], schema=to)

    sums = tasks.repartition(groups, "task").coalesce(groups).sortWithinPartitions("task").mapInArrow(add, schema).collect()
    windows = sum(r["windows"] for r in sums)
    return sum(np.frombuffer(r["weights"], np.float64) for r in sums) / windows if windows else np.zeros(0)


def train(windows: Callable[[int], DataFrame], spark: SparkSession, tasks: int, end: int, codes: Codes, shape: attention.Shape, *, rounds: int = ROUNDS, rate: float = LEARNING_RATE) -> np.ndarray:
    """The weights after ``rounds`` rounds, as one row of numbers; ``windows`` gives each round its share, each task has its own."""
    weights = attention.flat(attention.untrained(shape, codes.class_counts))
    if not tasks:
        return weights
    schema = "task int, windows long, weights binary"
    to = arrow_schema(schema)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((weights, codes))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            start, known = shared.value
            ids = [signed(x, end) for b in batches for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            if not ids:
                return
            ids = np.concatenate(ids).reshape(-1, shape.window + 1)
            slots, classes = examples(ids, known)
            made = attention.train(attention.unflat(start, shape), slots, classes, rate=rate * 0.5**r, batch=32 if len(ids) < SMALL else 128, seed=r)
            yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "windows": len(ids), "weights": attention.flat(made).tobytes()}], schema=to)

        dealt = windows(r).repartition(tasks, "place").sortWithinPartitions("place", "ids")  # each round's windows are moved once, and not kept
        weights = averaged(bounded_batches(dealt).mapInArrow(fit, schema), max(1, math.isqrt(tasks))).astype(np.float32)
        shared.unpersist()
    return weights


def examples(ids: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of windows' ids and classes of the ids that follow, -1 after a text's end."""
    slot, cls = codes.slot[codes.number], codes.cls[codes.number]  # by id
    return np.append(slot, slot[0])[ids[:, :-1]], np.append(cls, -1)[ids[:, 1:]]  # the last one is for none


class Scorer:
    """Natural logarithms of texts' probabilities. Each id is scored once, with at least ``window - stride`` ids before it."""

    def __init__(self, weights: np.ndarray, codes: Codes, shape: attention.Shape, stride: int = STRIDE):
        self.w, self.codes, self.shape, self.stride = attention.unflat(weights, shape), codes, shape, stride
        self.at_once = 384
        attention.keep_memory()

    def __call__(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For texts whose ids' numbers, each with the end's before and after it, are joined; ``ends`` are their ends."""
        window, stride = self.shape.window, self.stride
        starts = np.concatenate(([0], ends[:-1]))
        lengths = ends - starts - 1  # inputs, and targets
        more = np.maximum(0, -(-(lengths - window) // stride))
        texts = np.arange(len(ends))
        out = np.zeros(len(ends))
        slot, cls = self.codes.slot[ids], self.codes.cls[ids]
        within = np.append(np.float32(0), self.codes.within[ids[1:], cls[:-1]])  # of each id after the one before it
        for text, start, first in ((texts, starts, 0), (np.repeat(texts, more), None, window - stride)):
            if start is None:
                start = starts[text] + stride * (1 + np.arange(len(text)) - np.repeat(np.cumsum(more) - more, more))
            for k in range(0, len(text), self.at_once):
                t, at = text[k : k + self.at_once], start[k : k + self.at_once, None] + np.arange(window)
                last = (ends[t] - 2)[:, None]
                inside = at <= last
                at = np.minimum(at, last)
                made = attention.log_probabilities(self.w, slot[at], cls[at + 1], first)
                made = np.where(inside[:, first:], made + within[at[:, first:] + 1], 0)
                out += np.bincount(t, made.sum(axis=1, dtype=np.float64), len(ends))
        return out


def score(docs: DataFrame, *, path: str = RANKS_FILE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    ``base_score`` is the words' unigram score, ``score`` the model's, both log10. A null or empty text is its end
    alone. Rows with equal texts get equal scores up to rounding, repeated rows stay. Without training documents every
    count is 0 and the model knows frequencies of no id. An empty table gives an empty one. Columns other than doc_id
    and text aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    train_rows = rows.where(~held_out(F.col("doc_id")))
    counts = stored(with_subwords(word_counts(train_rows), path), "counts")
    totals = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_train = train_rows.count()
    train_tokens, distinct = totals["n"] + n_train, totals["words"] + (n_train > 0)
    least = head_threshold(counts)
    frequent = counts.where(F.col("n") >= least).select("word", "n").toArrow()  # HEAD_WORDS at most
    head = {word: math.log10(n + 1) for word, n in zip(*(frequent.column(c).to_pylist() for c in ("word", "n")), strict=True)}
    end, id_counts = subword_counts(counts, n_train, path)
    codes = Codes(id_counts, begins_word(path))
    codes.learn_pairs(*pair_counts(counts, codes))
    shape = attention.Shape(SLOTS, CLASSES, WIDTH, WINDOW)
    windows = n_train + int(id_counts.sum()) // WINDOW  # no fewer than there are
    encoded = stored(encoded_texts(rows, end, path, head), "encoded")
    learned = encoded.where(~held_out(F.col("doc_id")))
    weights = train(lambda r: windows_of(learned, end, rounds=rounds, turn=r), spark, -(-windows // WINDOWS_A_TASK), end, codes, shape, rounds=rounds)
    shared, kind = spark.sparkContext.broadcast((codes, weights)), number_type(end)

    def step():
        own, values = shared.value
        scorer = Scorer(values, own, shape)

        def call(batch: dict[str, list]) -> dict[str, list]:
            model: list[float] = []
            for part in blocks(batch.pop("ids"), BLOCK_BYTES // 2):
                model += scorer(own.number[np.frombuffer(b"".join(part), kind)], np.cumsum([len(x) // kind.itemsize for x in part])).tolist()
            return {**batch, "model": model}

        return call

    scored = cut(map_rows(encoded.drop("words", "times"), step, "key long, doc_id long, n_tokens long, n_head long, head_sum double, model double", BLOCK_BYTES))
    rare = encoded.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(F.col("n") < least), "word").groupBy("key").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum"))
    known_end = 1 if n_train else 0
    base = F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(math.log10(n_train + 1)) - F.col("n_tokens") * F.lit(math.log10(train_tokens + 1 * (distinct + 1)))
    return scored.join(rare, "key", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + known_end).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model") / math.log(10)).alias("score"),
    )


def joined(texts: list[np.ndarray], ids: np.ndarray, word_ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given as numbers of words, each text with the end's id before and after it; and their ends."""
    words = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    lengths = word_ends[words + 1] - word_ends[words]
    n = np.asarray([len(x) for x in texts])
    sums = np.concatenate(([0], np.cumsum(lengths)))
    stops = np.cumsum(n)
    own = sums[stops] - sums[stops - n]
    ends = np.cumsum(own + 2)
    out = np.full(int(ends[-1]) if len(ends) else 0, end, np.int64)
    place = np.arange(int(sums[-1]))
    source = place - np.repeat(sums[:-1] - word_ends[words], lengths)
    out[place + np.repeat(2 * np.arange(len(n)) + 1, own)] = ids[source]
    return out, ends


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by what those that aren't held out teach."""
    return score(read_table(spark, sf_dir, "documents"))
