"""License scan by a positional index of rare template words.

Templates (whole license texts and notices) are indexed by word and position. Of a template of n words,
need = ceil(COVER * n) have to agree, so of any n - need + 1 of its words at least one does: those of highest IDF (document
frequencies are counted over all documents) open places, all other words only count there. A place is a window of
n + floor(SLACK * n) words of a document; the words that agree are the longest common subsequence of window and template, so
words put in, left out or changed cost what they are, and every mandatory phrase must stand in the window. Windows are
compared only where an opening word lies and enough of the template's words are; none that passes is left out. A template's
place is the first window of greatest cover, from its first word that agrees on to its last. Of templates whose places
overlap only the one that explains most words stays (a license contains the shorter ones that it was made from); its words
are taken out, and the others are looked for again in what is left, so they are found where they stand by themselves.

Besides, base phrases are found wherever their words stand consecutively.

Null and empty texts have no words; rows with one doc_id are scanned each by itself; of equal covers the first place counts;
texts of any length are scanned whole, block by block; further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, blocks, table
from .license_texts import TEMPLATES

#: Base phrases and their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: A template's share of agreeing words that makes its label, and by what share of its words a window is longer.
COVER, SLACK = 0.8, 0.25


def _words(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.string()), ALNUM, True).hash


class Index:
    """Templates by word. frequency: documents with a word of the index, of `documents`."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], frequency: dict[int, int] | None = None, documents: int = 1) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [_words(text) for _, text, _ in templates]
        self.phrases = [[_words(p) for p in phrases] for _, _, phrases in templates]
        self.vocabulary = np.unique(np.concatenate(self.words))
        frequency = frequency or {}
        self.idf = np.array([np.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in self.vocabulary.tolist()])
        self.need = [math.ceil(COVER * len(w) - 1e-9) for w in self.words]
        self.window = [len(w) + math.floor(SLACK * len(w)) for w in self.words]
        #: By template: which words of the vocabulary it has, and for each of them the bits of its positions.
        self.member = np.zeros((len(self.words), len(self.vocabulary)), bool)
        self.masks: list[dict[int, int]] = []
        #: The templates that a word opens, by its place in the vocabulary.
        self.postings: dict[int, set[int]] = defaultdict(set)
        for t, words in enumerate(self.words):
            terms = np.searchsorted(self.vocabulary, words)
            masks: dict[int, int] = defaultdict(int)
            for i, term in enumerate(terms.tolist()):
                masks[term] |= 1 << i
            self.masks.append(dict(masks))
            self.member[t, terms] = True
            for i in np.argsort(-self.idf[terms], kind="stable")[: len(words) - self.need[t] + 1].tolist():
                self.postings[int(terms[i])].add(t)
        self.opens = np.isin(np.arange(len(self.vocabulary)), list(self.postings))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, -1)

    def scan(self, words: np.ndarray, places: np.ndarray, terms: np.ndarray) -> dict[int, tuple[float, int]]:
        """Cover and first word of each template that stays, in a document with index words `terms` at `places`."""
        kept: dict[int, tuple[float, int]] = {}
        best = self.candidates(words, places, terms, None)
        while best:
            t = max(best, key=lambda t: (best[t][3], best[t][0], -t))
            cover, first, end, _ = best.pop(t)
            kept.setdefault(t, (cover, first))
            if not best:
                break
            left = (places < first) | (places >= end)
            places, terms = places[left], terms[left]
            # further copies of t explain words too; others are looked for again where they overlap
            again = {t, *(o for o, (_, f, e, _) in best.items() if f < end and e > first)}
            best = {o: x for o, x in best.items() if o not in again} | self.candidates(words, places, terms, again)
        return kept

    def candidates(self, words: np.ndarray, places: np.ndarray, terms: np.ndarray, only: set[int] | None) -> dict[int, tuple[float, int, int, int]]:
        """Best cover, its place (first word, end) and agreeing words of each template, of those in `only`, that passes."""
        best: dict[int, tuple[float, int, int, int]] = {}
        opening = self.opens[terms]
        found: dict[int, list] = defaultdict(list)
        for place, term in zip(places[opening].tolist(), terms[opening].tolist(), strict=True):
            for t in self.postings[term]:
                if only is None or t in only:
                    found[t].append(place)
        for t, opened in found.items():
            own = self.member[t, terms]
            at, term = places[own], terms[own]
            stop = np.searchsorted(at, at + self.window[t])
            opened = np.array(opened)
            near = np.searchsorted(opened, at + self.window[t]) > np.searchsorted(opened, at)
            begins = np.flatnonzero((stop - np.arange(len(at)) >= self.need[t]) & near)
            if len(begins):
                place = self._best(t, words, at, term.tolist(), begins.tolist(), stop.tolist())
                if place:
                    best[t] = place
        return best

    def _best(self, t: int, words: np.ndarray, at: np.ndarray, terms: list[int], begins: list[int], stop: list[int]) -> tuple[float, int, int, int] | None:
        """Of the windows that begin at the k-th of the template's words in the document, for k in begins."""
        masks, n = self.masks[t], len(self.words[t])
        full = (1 << n) - 1

        def agree(k: int, end: int | None = None) -> int:
            v = full  # bit by bit the longest common subsequence: a zero for each word that agrees
            for term in terms[k : stop[k] if end is None else end]:
                u = v & masks[term]
                v = ((v + u) | (v - u)) & full
            return n - v.bit_count()

        most, where, pass_over = self.need[t] - 1, None, -1
        for k in begins:
            if at[k] < pass_over or stop[k] - k <= most:
                continue
            same = agree(k)
            pass_over = int(at[k]) + most + 1 - same  # a word more can agree with every word further, at most
            window = words[at[k] : at[k] + self.window[t]]
            if same > most and all(contains(window, p) for p in self.phrases[t]):
                most, where = same, k
        if where is None:
            return None
        while where + 1 < len(at) and agree(where + 1) == most:
            where += 1
        end = bisect_left(range(stop[where]), most, lo=where + most, key=lambda e: agree(where, e))
        return most / n, int(at[where]), int(at[end - 1]) + 1, most


def contains(words: np.ndarray, phrase: np.ndarray) -> bool:
    return len(starts(words, phrase)) > 0


def starts(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively."""
    at = np.flatnonzero(words == phrase[-1]) - len(phrase) + 1
    at = at[at >= 0]
    for k, w in enumerate(phrase[:-1]):
        at = at[words[at + k] == w]
    return at


def frequencies(docs: DataFrame, index: Index) -> tuple[dict[int, int], int]:
    """Documents that have each word of the index, and all documents: a row per word and task is shuffled."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts, n = np.zeros(len(known), np.int64), 0
        for block in blocks(batches):
            words = Words(block.column(0), ALNUM, True)
            at = np.searchsorted(known, words.hash)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == words.hash)
            text = np.searchsorted(words.first, hit, side="right") - 1
            pairs = np.unique(text * len(known) + at[hit])
            counts += np.bincount(pairs % len(known), minlength=len(known))
            n += block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(known)), -1)), pa.array(np.append(counts, n))], ["w", "n"])

    found = {r["w"]: r["n"] for r in docs.select("text").mapInArrow(rows, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {int(w): found.get(i, 0) for i, w in enumerate(index.vocabulary.tolist())}, found.get(-1, 0)


SCAN = "n_words long, base array<struct<first:int,phrase:int>>, matches array<struct<label:string,first:int,cover:double>>"


def scan(docs: DataFrame, templates: list | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base (places of base phrases) and matches (templates found) of all documents (doc_id, text)."""
    templates, phrases = TEMPLATES if templates is None else templates, BASE if phrases is None else phrases
    frequency, documents = frequencies(docs, Index(templates))
    shared = docs.sparkSession.sparkContext.broadcast((templates, frequency, documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base = Index(*shared.value), [_words(p) for p in phrases]
        kinds = pa.list_(pa.struct([("first", pa.int32()), ("phrase", pa.int32())])), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("cover", pa.float64())]))
        for block in blocks(batches):
            words = Words(block.column(1), ALNUM, True)
            terms = index.find(words.hash)
            hit = np.flatnonzero(terms >= 0)
            text = np.searchsorted(words.first, hit, side="right") - 1
            edge = np.searchsorted(text, np.arange(block.num_rows + 1))
            every = [[] for _ in range(block.num_rows)]
            for k, p in enumerate(base):
                for i in starts(words.hash, p).tolist():
                    t = int(np.searchsorted(words.first, i, side="right")) - 1
                    if i + len(p) <= words.first[t + 1]:
                        every[t].append((i - int(words.first[t]), k))
            every = [[{"first": i, "phrase": k} for i, k in sorted(x)] for x in every]
            matches = []
            for t in range(block.num_rows):
                a, b = words.first[t], words.first[t + 1]
                own, at = words.hash[a:b], hit[edge[t] : edge[t + 1]]
                best = index.scan(own, at - a, terms[at]) if len(at) else {}
                matches.append([{"label": index.labels[k], "first": first, "cover": c} for k, (c, first) in sorted(best.items())])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(words.first)), pa.array(every, kinds[0]), pa.array(matches, kinds[1])], ["doc_id", "n_words", "base", "matches"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, " + SCAN)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labels = F.array(*map(F.lit, BASE.values()))
    base = F.transform("base", lambda x: F.element_at(labels, x["phrase"] + 1))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    place = F.transform("base", lambda x: x["first"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("matches", lambda x: x["cover"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"), joined(base).alias("base_labels"), joined(F.array_union(base, F.transform("matches", lambda x: x["label"]))).alias("labels"), F.when(F.size("base") > 0, F.greatest(score, F.lit(1.0))).otherwise(score).alias("score"))
