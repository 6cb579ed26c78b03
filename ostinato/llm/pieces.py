"""Encoding to and decoding from the pieces of a SentencePiece vocabulary, with the N best segmentations.

Pieces span a lattice over a text. The forward pass gives each place the best score of any way to it. A search from the
end back to the start then adds these scores to what a partial way has already cost: as the heuristic is exact, complete
ways come off the queue from best to worst, and it stops after N.

No piece goes on from a visible character to a space mark, so each such border cuts the lattice, and a text's
segmentations are combinations of its chunks'. The N best of a text differ from its best one only in the N - 1 chunks
with the least loss to their second best; only these are searched, and chunks that occur often are kept with their result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.rows import blocks, map_rows
from ostinato.llm.storage import read_table

#: Where the vocabulary is; only the driver reads the file.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Scores are integers of so many parts, so that sums are exact in any order.
PARTS = 1 << 20
NEVER = -(1 << 62)
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Results are kept of chunks up to this length, and of so many in a task.
KEPT_LENGTH, KEPT_CHUNKS = 40, 200_000
#: Places of chunks that go through the forward pass at once, and bytes of a batch that are in Python at once.
PLACES, SLICE_BYTES = 1 << 19, 1 << 20


class Vocabulary:
    """Pieces with integer scores; ``trie`` leads from character to character to nodes [id or -1, score, next nodes]."""

    def __init__(self, pieces: list[str], scores: list[int], byte_ids: list[int], byte_score: int):
        self.pieces, self.byte_ids, self.byte_score = pieces, byte_ids, byte_score
        self.byte_values = {i: b for b, i in enumerate(byte_ids)}
        self.trie: dict[str, list] = {}
        for i, (piece, score) in enumerate(zip(pieces, scores, strict=True)):
            if score == NEVER or not piece:
                continue
            into = self.trie
            for c in piece:
                node = into.setdefault(c, [-1, 0, {}])
                into = node[2]
            node[:2] = i, score
        self.links = Links(self.trie)


class Links:
    """The trie in arrays: of a node, ``base`` plus the class of a character is the place of the next one, if ``owner`` there is the node.

    ``ids`` is a node's piece or -1; node 0 is the root. Class 0 is that of characters which no piece has.
    """

    def __init__(self, trie: dict[str, list]):
        nodes, below, often = [[-1, 0, trie]], [], Counter()
        for node in nodes:  # grows meanwhile
            below.append((len(nodes), list(node[2])))
            often.update(node[2].keys())
            nodes += node[2].values()
        known = {c: k for k, (c, _) in enumerate(often.most_common(), 1)}
        self.codes, self.classes = np.asarray([ord(c) for c in known], np.int64), np.asarray(list(known.values()), np.int32)
        self.ids, self.scores = (np.asarray([x[k] for x in nodes], np.int64) for k in (0, 1))
        self.base = np.zeros(len(nodes), np.int64)
        used, placed = bytearray(len(known) + 1), []
        for node in sorted(range(len(nodes)), key=lambda x: -len(below[x][1])):
            first, own = below[node][0], [known[c] for c in below[node][1]]
            if not own:
                break
            least, at = min(own), -1
            for _ in range(64):  # free places that are tried before the end is taken
                at = used.find(0, max(at + 1, least))
                if at < 0 or all(at - least + k >= len(used) or not used[at - least + k] for k in own):
                    break
            else:
                at = -1
            base = (len(used) if at < 0 else at) - least
            used.extend(bytes(max(0, base + max(own) + 1 - len(used))))
            self.base[node] = base
            for k, c in enumerate(own):
                used[base + c] = 1
                placed.append((base + c, node, first + k))
        size = len(used) + len(known) + 1  # a place beyond the last one may be looked up, but not owned
        self.owner, self.target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for at, node, to in placed:
            self.owner[at], self.target[at] = node, to

    def by_code(self) -> np.ndarray:
        """The class of each code point."""
        made = np.zeros(0x110000, np.int32)
        made[self.codes] = self.classes
        return made


def load_vocabulary(path: str = MODEL_FILE) -> Vocabulary:
    """Reads a model file with byte pieces.

    The pieces of a BPE model are in the order of their merges and have that rank for a score, which isn't a
    probability. They get the log probability that Zipf's law gives to their rank; a unigram model's scores stay. A
    character without a piece is spelt in bytes, each of which scores less than any piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = all(model.get_score(i) == int(model.get_score(i)) for i in normal)
    harmonic = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
    scores = [NEVER] * size
    for rank, i in enumerate(normal, 1):
        scores[i] = round((-math.log(rank) - harmonic if ranked else model.get_score(i)) * PARTS)
    byte_ids = [i for i in range(size) if model.is_byte(i)]
    return Vocabulary(pieces, scores, byte_ids, min(scores[i] for i in normal) - PARTS)


Edge = tuple[int, int, tuple[int, ...]]


def spelt(vocabulary: Vocabulary, c: str) -> tuple[int, tuple[int, ...]]:
    """Score and ids of a character in bytes."""
    raw = c.encode("utf-8", "surrogatepass")
    return vocabulary.byte_score * len(raw), tuple(vocabulary.byte_ids[b] for b in raw)


def edges(vocabulary: Vocabulary, chunk: str) -> Iterator[tuple[int, Edge]]:
    """(end, (start, score, ids)) of the lattice, by start."""
    for i, c in enumerate(chunk):
        node = vocabulary.trie.get(c)
        if node is None or node[0] < 0:
            yield i + 1, (i, *spelt(vocabulary, c))
        j = i + 1
        while node is not None:
            if node[0] >= 0:
                yield j, (i, node[1], (node[0],))
            node = node[2].get(chunk[j]) if j < len(chunk) else None
            j += 1


def forward(vocabulary: Vocabulary, chunk: str) -> tuple[list[int], tuple[int, ...], int]:
    """Best score to each place, the ids of the best way to the end, and how much worse the second best way is.

    It goes over the same lattice as ``edges``, without making its tuples.
    """
    n, first = len(chunk), vocabulary.trie
    best, second = [NEVER] * (n + 1), [NEVER] * (n + 1)
    best[0] = 0
    came: list[int] = [0] * (n + 1)
    piece: list[int | tuple[int, ...]] = [0] * (n + 1)
    for i, c in enumerate(chunk):
        to_here, other = best[i], second[i]
        node, j = first.get(c), i + 1
        if node is None or node[0] < 0:
            score, ids = spelt(vocabulary, c)
            way = to_here + score
            if way > best[j]:
                second[j] = max(best[j], other + score)
                best[j], came[j], piece[j] = way, i, ids
            elif way > second[j]:
                second[j] = way
        while node is not None:
            own, score, after = node
            if own >= 0:
                way = to_here + score
                if way > best[j]:
                    second[j] = best[j] if best[j] > other + score else other + score
                    best[j], came[j], piece[j] = way, i, own
                elif way > second[j]:
                    second[j] = way
            if j == n:
                break
            node = after.get(chunk[j])
            j += 1
    ids, j = [], n
    while j:
        if isinstance(piece[j], int):
            ids.append(piece[j])
        else:
            ids += piece[j][::-1]
        j = came[j]
    ids.reverse()
    return best, tuple(ids), best[n] - second[n] if second[n] > NEVER // 2 else -NEVER


def forward_all(vocabulary: Vocabulary, by_code: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``forward`` of many chunks, longest first: the ids of all one after another, how many each has, scores and margins.

    All chunks go from place to place together, each place is a row; ways come in the same order as there.
    """
    links, n = vocabulary.links, len(chunks)
    lengths = np.fromiter(map(len, chunks), np.int64, n)
    width = int(lengths[0])
    codes = np.ascontiguousarray(np.asarray(chunks, f"U{width}").view(np.uint32).reshape(n, width).T)
    classes = by_code[codes]
    reach = np.searchsorted(-lengths, -np.arange(width + 1), side="left")  # chunks longer than a place come first
    best, second = np.full((width + 1, n), NEVER), np.full((width + 1, n), NEVER)
    best[0] = 0
    came, piece = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)

    def take(i: int, j: int, rows: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        way, other, was = best[i, rows] + score, second[i, rows] + score, best[j, rows]
        better = way > was
        second[j, rows] = np.where(better, np.maximum(was, other), np.maximum(second[j, rows], way))
        rows = rows[better]
        best[j, rows], came[j, rows], piece[j, rows] = way[better], i, own[better]

    for i in range(width):
        place = links.base[0] + classes[i, : reach[i]]
        there = links.owner[place] == 0
        spell = np.flatnonzero(~there | (links.ids[links.target[place]] < 0))
        if len(spell):
            code = codes[i, spell].astype(np.int64)
            take(i, i + 1, spell, vocabulary.byte_score * (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)), -1 - code)
        rows = np.flatnonzero(there)
        node, j = links.target[place[rows]], i + 1
        while len(rows):
            own = links.ids[node]
            whole = own >= 0
            take(i, j, rows[whole], links.scores[node[whole]], own[whole])
            if j == width:
                break
            rows = rows[: np.searchsorted(rows, reach[j])]
            node = node[: len(rows)]
            place = links.base[node] + classes[j, rows]
            there = links.owner[place] == node
            rows, node, j = rows[there], links.target[place[there]], j + 1
    rows, at, steps = np.arange(n), lengths, []
    while len(rows):
        steps.append((rows, piece[at, rows]))
        at = came[at, rows]
        rows, at = rows[at > 0], at[at > 0]
    rows, ids = np.concatenate([x for x, _ in steps[::-1]]), np.concatenate([x for _, x in steps[::-1]])
    order = np.argsort(rows, kind="stable")
    rows, ids = rows[order], ids[order]
    if len(spell := np.flatnonzero(ids < 0)):
        raw = [spelt(vocabulary, chr(-1 - x))[1] for x in ids[spell].tolist()]
        times = np.ones(len(ids), np.int64)
        times[spell] = [len(x) for x in raw]
        rows, ids = np.repeat(rows, times), np.repeat(ids, times)
        ids[ids < 0] = [x for own in raw for x in own]
    whole = np.arange(n)
    last = second[lengths, whole]
    return ids.astype(np.int32), np.bincount(rows, minlength=n), best[lengths, whole], np.where(last > NEVER // 2, best[lengths, whole] - last, -NEVER)


def n_best(vocabulary: Vocabulary, chunk: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(score, ids) of the n best ways through a chunk, best first."""
    best, first, _ = forward(vocabulary, chunk)
    into: list[list[Edge]] = [[] for _ in range(len(chunk) + 1)]
    for j, edge in edges(vocabulary, chunk):
        into[j].append(edge)
    # Of equal ways the one that was queued first goes on; later steps come first, so that a tie is finished, not widened.
    queue, order, found = [(-best[-1], 0, 0, len(chunk), None)], 0, []
    while queue and len(found) < n:
        estimate, _, score, j, path = heapq.heappop(queue)
        if not j:
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((score, tuple(ids)))
            continue
        for i, own, piece in into[j]:
            order -= 1
            heapq.heappush(queue, (-(score + own + best[i]), order, score + own, i, (piece, path)))
    # The way that the forward pass traced counts as the first of those that equal it.
    rest = [x for x in found if x[1] != first]
    return [(best[-1], first), *rest][:n]


Edit = tuple[int, int, tuple[int, ...]]


class Chunks(dict):
    """Numbers of chunks as they come up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Segments texts and keeps the results of chunks, by their numbers, for the next ones."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n, self.by_code = vocabulary, n, vocabulary.links.by_code()
        self.others: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self.forget()

    def forget(self) -> None:
        self.kept = Chunks()
        self.ids, self.ends, self.scores, self.margins = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Segments the chunks that got numbers and have no results yet: short ones many at once, longer ones alone."""
        new, self.kept.new = self.kept.new, []
        parts: list[tuple] = []
        order = sorted(range(len(new)), key=lambda k: -len(new[k]))
        longer = sum(len(chunk) > KEPT_LENGTH for chunk in new)
        for k in order[:longer]:
            best, ids, margin = forward(self.vocabulary, new[k])
            parts.append((np.asarray(ids, np.int32), [len(ids)], [best[-1]], [margin]))
        at = longer
        while at < len(new):  # chunks of about a length go together, as each takes the room of the longest
            own = order[at : at + max(1, PLACES // (len(new[order[at]]) + 1))]
            parts.append(forward_all(self.vocabulary, self.by_code, [new[k] for k in own]))
            at += len(own)
        if not parts:
            return
        ids, lengths, scores, margins = (np.concatenate([x[k] for x in parts]) for k in range(4))
        rank = np.argsort(np.asarray(order))
        starts, lengths = (np.cumsum(lengths) - lengths)[rank], lengths[rank]
        ends = np.cumsum(lengths)
        self.ids = np.concatenate((self.ids, ids[np.arange(len(ids)) + np.repeat(starts - ends + lengths, lengths)]))
        self.ends = np.concatenate((self.ends, self.ends[-1] + ends))
        self.scores, self.margins = np.concatenate((self.scores, scores[rank])), np.concatenate((self.margins, margins[rank]))

    def several(self, chunk: str) -> list[tuple[int, tuple[int, ...]]]:
        if chunk in self.others:
            return self.others[chunk]
        made = n_best(self.vocabulary, chunk, self.n)
        if len(chunk) <= KEPT_LENGTH:
            if len(self.others) >= KEPT_CHUNKS // 10:
                self.others.clear()
            self.others[chunk] = made
        return made

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, list[Edit]]]]]:
        """For each text the best ids, their score, and for each further segmentation its score and where it differs.

        An edit (at, drop, ids) puts ids for ``drop`` of the best ones from place ``at``.
        """
        if len(self.kept) >= KEPT_CHUNKS:
            self.forget()
        chunked = [CHUNKS.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        numbers = [np.fromiter(map(self.kept.__getitem__, chunks), np.int64, len(chunks)) for chunks in chunked]
        self.learn()
        for chunks, own in zip(chunked, numbers, strict=True):
            if not chunks:
                yield np.zeros(0, np.int32), 0, []
                continue
            starts = self.ends[own]
            lengths = self.ends[own + 1] - starts
            ends = np.cumsum(lengths)
            ids = self.ids[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]
            score, margins = int(self.scores[own].sum()), self.margins[own]
            where = [k for k in np.argsort(margins, kind="stable")[: self.n - 1].tolist() if margins[k] < -NEVER]
            yield ids, score, self._combined(chunks, {k: (int(ends[k] - lengths[k]), int(lengths[k])) for k in where}, where, score)

    def encode(self, text: str) -> tuple[list[int], int, list[tuple[int, list[Edit]]]]:
        """``encode_all`` of one text."""
        ids, score, others = next(self.encode_all([text]))
        return ids.tolist(), score, others

    def _combined(self, chunks: list[str], spans: dict[int, tuple[int, int]], where: list[int], score: int) -> list[tuple[int, list[Edit]]]:
        choices = [self.several(chunks[k]) for k in where]
        begin = (0,) * len(where)
        queue, seen, found = [(0, begin)], {begin}, []
        while queue and len(found) < self.n:
            loss, picks = heapq.heappop(queue)
            found.append((score - loss, [(*spans[k], choices[c][p][1]) for c, (k, p) in enumerate(zip(where, picks, strict=True)) if p]))
            for c, p in enumerate(picks):
                step = (*picks[:c], p + 1, *picks[c + 1 :])
                if p + 1 < len(choices[c]) and step not in seen:
                    seen.add(step)
                    heapq.heappush(queue, (loss + choices[c][p][0] - choices[c][p + 1][0], step))
        return found[1:]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids. Byte pieces in a row are read as UTF-8; control pieces have no text; the first space goes."""
    parts, raw = [], bytearray()
    pieces, byte_values = vocabulary.pieces, vocabulary.byte_values
    for i in ids:
        if i in byte_values:
            raw.append(byte_values[i])
            continue
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
            raw.clear()
        parts.append(pieces[i])
    parts.append(raw.decode("utf-8", "replace"))
    text = "".join(parts).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode_texts(docs: DataFrame, *, n: int = 4, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The n best segmentations of each text.

    ids are the best one's, scores are log scores from best to worst (fewer than n if there are no more), and others has
    for each further segmentation its edits of the best one (at, drop, ids). A null text has null ids and no scores, an
    empty one empty ids and score 0. round_trip says whether the ids decode to the text; this holds for every text but
    those with the space mark's own character, which decodes to a space. Repeated rows give repeated rows, an empty
    table an empty one; columns other than doc_id and text aren't read.
    """
    vocabulary = vocabulary or load_vocabulary()

    def step():
        encoder = Encoder(vocabulary, n)

        def call(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"]} | {k: [] for k in ("n_pieces", "ids", "scores", "others", "round_trip")}
            made = (x for part in blocks(batch["text"]) for x in encoder.encode_all([text or "" for text in part]))
            for text, (ids, score, others) in zip(batch["text"], made, strict=True):
                out["n_pieces"].append(len(ids))
                out["ids"].append(None if text is None else ids)
                out["scores"].append([] if text is None else [s / PARTS for s in (score, *(o[0] for o in others))])
                out["others"].append([[{"at": a, "drop": d, "ids": x} for a, d, x in edits] for _, edits in others])
                out["round_trip"].append(None if text is None else decode(vocabulary, ids.tolist()) == text)
            return out

        return call

    schema = "doc_id long, n_pieces long, ids array<int>, scores array<double>, others array<array<struct<at: int, drop: int, ids: array<int>>>>, round_trip boolean"
    return map_rows(docs.select("doc_id", "text"), step, schema, SLICE_BYTES)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, text) of a table with doc_id and ids; null ids give a null text."""
    vocabulary = vocabulary or load_vocabulary()

    def step():
        def call(batch: dict[str, list]) -> dict[str, list]:
            return {"doc_id": batch["doc_id"], "text": [None if ids is None else decode(vocabulary, ids) for ids in batch["ids"]]}

        return call

    return map_rows(encoded.select("doc_id", F.col("ids")), step, "doc_id long, text string")


def op10_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document."""
    return encode_texts(read_table(spark, sf_dir, "documents"))
