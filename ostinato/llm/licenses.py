"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words that is at most STRETCH times as long as a template. It matches if it holds at
least THRESHOLD of the template's distinct words. Templates' words are ordered by how many documents of the whole
corpus have them, rarest first. A block that matches holds one of the few first words of that order (prefix filter); a
document with fewer words, or fewer of the template's words, than needed has no such block (length filter); and where
the first shared word stands late in both orders, too few words are left (positional filter). Only around the first
words are blocks then counted, and all of these are: the filters lose nothing.

The templates are the small side, license texts and notices of some thousand words together that every task has;
documents are never moved. Matching several of one family's texts is told apart block by block.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm.license_texts import TEMPLATES
from ostinato.llm.rows import map_rows
from ostinato.llm.storage import read_table

THRESHOLD, STRETCH = 0.8, 1.25

#: Phrases whose every place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _word_table() -> bytes:
    """A to Z to lower case; digits, a to z and all bytes from 128 stay; the rest separates."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    table[48:58] = bytes(range(48, 58))
    table[65:91] = table[97:123] = bytes(range(97, 123))
    return bytes(table)


WORD_TABLE = _word_table()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


class Matcher:
    """Templates with their words in the corpus-wide order of frequency, and the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD, stretch: float = STRETCH):
        self.labels = [label for label, _ in templates]
        self.lengths = [math.ceil(stretch * len(words_of(text))) for _, text in templates]
        vocabulary = sorted({w for _, text in templates for w in words_of(text)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.records = [sorted({self.rank[w] for w in words_of(text)}) for _, text in templates]
        self.needed = [math.ceil(threshold * len(r) - 1e-9) for r in self.records]
        self.sets = [set(r) for r in self.records]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, record in enumerate(self.records):
            for at, token in enumerate(record[: len(record) - self.needed[k] + 1]):
                self.index.setdefault(token, []).append((k, at))
        self.prefixes = {vocabulary[t] for t in self.index}
        self.vocabulary = set(vocabulary)

    def candidates(self, words: list[bytes]) -> list[int]:
        """Templates that the filters leave for a text."""
        if self.prefixes.isdisjoint(words):
            return []
        own = sorted(self.rank[w] for w in self.vocabulary.intersection(words))
        found = set()
        for at, token in enumerate(own):
            for k, place in self.index.get(token, ()):
                if len(words) >= self.needed[k] and min(len(own) - at, len(self.records[k]) - place) >= self.needed[k]:
                    found.add(k)
        return sorted(k for k in found if len(self.sets[k].intersection(own)) >= self.needed[k])

    def tight_windows(self, k: int, own: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """(containment, end, first word) of the shortest blocks of template ``k`` with each sufficient number of its words.

        Any block with so many of them holds one of these. ``own`` has the places and ranks of the template's words.
        """
        found = []
        for count in range(self.needed[k], len(self.records[k]) + 1):
            inside, low, some = {}, 0, False
            for i, token in own:
                inside[token] = inside.get(token, 0) + 1
                shrunk = False
                while len(inside) >= count:
                    start, first = own[low]
                    low += 1
                    inside[first] -= 1
                    if not inside[first]:
                        del inside[first]
                    shrunk = True
                if shrunk and i - start < self.lengths[k]:
                    found.append((count / len(self.records[k]), i + 1, start))
                    some = True
            if not some:
                break
        return found

    def blocks(self, words: list[bytes]) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, end) of all matching blocks, in the order of templates and places.

        Notices of one family differ in a word or two: a block is ruled out by a better one that it overlaps, if that
        one isn't ruled out itself; and of one template's equally good blocks that overlap, the first one stands. So each
        matching block overlaps a returned one of at least its containment, or is one.
        """
        found = []
        if possible := self.candidates(words):
            places = [(i, self.rank[w]) for i, w in enumerate(words) if w in self.vocabulary]
            windows = [(-score, end, start, k) for k in possible for score, end, start in self.tight_windows(k, [p for p in places if p[1] in self.sets[k]])]
            better = bytearray(len(words))
            for score, equal in groupby(sorted(windows), lambda x: x[0]):
                kept, until = [], {}
                for _, end, start, k in equal:
                    if start >= until.get(k, 0) and better.find(1, start, end) < 0:
                        kept.append((k, -score, start, end))
                        until[k] = end
                for _, _, start, end in kept:
                    better[start:end] = b"\1" * (end - start)
                found += kept
        return sorted(found, key=lambda x: (x[0], x[2]))


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after another."""
    found = []
    for phrase, label in phrases.items():
        parts = words_of(phrase)
        last, at = parts[-1], -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            if at >= len(parts) - 1 and words[at - len(parts) + 1 : at + 1] == parts:
                found.append((at - len(parts) + 1, label))
    return sorted(found)


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the (small) vocabulary occurs, over all documents and whole texts."""

    def step():
        def count(batch: dict[str, list]) -> dict[str, list]:
            sums: dict[bytes, int] = {}
            for text in batch["text"]:
                for w in vocabulary.intersection(words_of(text)):
                    sums[w] = sums.get(w, 0) + 1
            return {"word": list(sums), "n": list(sums.values())}

        return count

    summed = map_rows(docs.select("text"), step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in summed.collect()}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its number of words, the places of phrases, labels, the best score, and all matched blocks.

    A null or empty text has no words, no labels and score 0. Repeated rows give repeated rows, an empty table an empty
    one; other columns aren't read. The score is 1 where a phrase stands, else the best block's containment, else 0.
    """
    vocabulary = {w for _, text in templates for w in words_of(text)}
    frequency = word_frequencies(docs, vocabulary)

    def step():
        matcher = Matcher(templates, frequency, threshold)

        def scan(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": [], "n_base": [], "first_word": [], "last_word": [], "base_labels": [], "labels": [], "score": [], "blocks": []}
            for text in batch["text"]:
                words = words_of(text)
                places, blocks = phrase_places(words, phrases), matcher.blocks(words)
                base = {label for _, label in places}
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(places[0][0] if places else None)
                out["last_word"].append(places[-1][0] if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {matcher.labels[b[0]] for b in blocks})))
                out["score"].append(1.0 if places else max((b[1] for b in blocks), default=0.0))
                out["blocks"].append(",".join(f"{matcher.labels[k]}:{a}:{b}" for k, _, a, b in blocks))
            return out

        return scan

    return map_rows(docs.select("doc_id", "text"), step, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and blocks of every document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
