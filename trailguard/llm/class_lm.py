"""Brown's class-based bigram model: log10 probabilities of whole texts.

Every word of the training documents has a class, and every bigram of the training text counts for classes and transitions.
Classes come from exchange clustering, in rounds: words move to the class that makes their bigrams likeliest under the
classes' transitions. It goes in four steps.
1. Bigrams of the `HEAD` most frequent words are counted over all training text and kept by word; in a round, executors add
   up each word's left and right neighbours by class, and the words of one half, by turns, move.
2. All other words, which stay a table however many they are, take a class by their neighbours in the head.
3. The head moves on for some rounds, with its neighbours outside the head counted too.
4. All other words move by all their neighbours: those in the head, and those outside it, whose classes are joined to every
   bigram of two such words. Class pairs are then counted over all bigrams.
What a round brings to the driver is a row of neighbour classes per head word.
Then
  P(word | before) = P(class | class before) * P(word | class),
where transitions are smoothed with the classes' own shares and words by adding one. Words that training doesn't have are one
more word of the class to which most words that occur once belong, so probabilities add up to one.

Counts and classes of words of at least some frequency, at most `KNOWN` words, are broadcast; all rarer words are joined with
theirs, occurrence by occurrence, so the vocabulary may be of any size and nothing is left out.

Null and empty texts have the end token only; rows with one doc_id are scored each by itself; with no training document
every count is zero; texts of any length are read whole, block by block; further columns don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, blocks, run_once, save, settled, shuffle_partitions, signed, table
from .language_id import bucket

HEAD, CLASSES, ROUNDS, MORE_ROUNDS, KNOWN = 20_000, 48, 12, 4, 200_000
#: How many counts the classes' shares weigh in each class's transitions, and how many occurrences among average neighbours
#: a word is taken to have besides its own when it looks for its class: what is seen once says little.
PRIOR, AVERAGE = 5.0, 10.0
#: Head words whose counts of neighbours go together from task to task.
PART = 512
END = np.int64(0x656E64206F662074)


def tokens(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, each followed by the end token, and where each text begins."""
    words = Words(block, NOT_SPACE, True)
    return np.insert(signed(words.hash), words.first[1:], END), words.first + np.arange(len(words.first))


def before_each(w: np.ndarray) -> np.ndarray:
    """The token before each: every text ends with the end token, so the end token comes before each text's first."""
    return np.insert(w[:-1], 0, END)


def tally(keys: Iterator[np.ndarray], most: int = 600_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and how often each is there, in parts of about `most` keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return k[at], np.add.reduceat(n, at)

    for k in keys:
        if len(k):
            held.append(np.unique(k, return_counts=True))
        if sum(len(x[0]) for x in held) > 1.5 * most:
            held = [merged()]
            if len(held[0][0]) > most:
                yield held.pop()
    if held:
        yield merged()


def tallied(docs: DataFrame, keys_of, name: str) -> DataFrame:
    """How often each key is in all documents (text); keys_of gives those of a block's tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in tally(keys_of(tokens(block.column(0))[0]) for block in blocks(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], [name, "n"])

    return docs.select("text").mapInArrow(rows, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> dict[str, np.ndarray]:
    """Columns of the most frequent words, at most `most`: all of at least a frequency that a histogram with 32 steps an octave gives."""
    step = F.floor(F.log2("n") * 32).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    found = counts.limit(0) if least is None else counts.where(step >= least)
    return {c: x.to_numpy() for c, x in zip(found.columns, found.toArrow().columns, strict=True)}


class Head:
    """Words by number, in the order of their hashes; -1 for words that it doesn't have."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.sort(words)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)


def binaries(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """The values' bytes, cut where `at` says (one more than pieces)."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def joined_binaries(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all pieces of `binaries`, and how many each has (none where it is null)."""
    column = column.cast(pa.binary())
    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), kind), n


def neighbours(docs: DataFrame, head: Head) -> DataFrame:
    """id, code, n, some thousands of values a row, in the order of id: how often head word `id` has head word `code // 2`
    before it, or with an odd code after it."""
    shared, size = docs.sparkSession.sparkContext.broadcast(head), len(head.words)

    def pairs(w: np.ndarray) -> np.ndarray:
        a, b = shared.value(before_each(w)), shared.value(w)
        both = (a >= 0) & (b >= 0)
        return a[both] * size + b[both]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], ["id", "code", "n"])

    # by pair first: a frequent word has many tasks' counts of one neighbour
    bigrams = tallied(docs, pairs, "pair").select((F.col("pair") / size).cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), "n")
    sides = F.explode(F.array(F.struct(F.col("a").alias("id"), (F.col("b") * 2 + 1).alias("code")), F.struct(F.col("b").alias("id"), (F.col("a") * 2).alias("code"))))
    by_word = bigrams.select(sides.alias("x"), "n").select("x.id", "x.code", "n").repartition(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id")
    return save(by_word.mapInArrow(packed, "id binary, code binary, n binary"), "neighbours")


def summed(rows: DataFrame, size: int, columns: int) -> np.ndarray:
    """The matrix whose rows (id, counts) these are; several rows of one id are added up."""
    out = np.zeros((size, columns), np.int64)
    for r in rows.collect():
        out[r["id"]] += np.frombuffer(r["counts"], np.int64)
    return out


def matrix_rows(total: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    some = np.flatnonzero(total.any(axis=1))
    return some, [x.tobytes() for x in total[some]]


def by_class(contexts: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """For each head word how often each class of head words is before it (columns from 0 on) and after it (from `classes`
    on): one row per word, and a few where a file is read in parts, come to the driver."""
    shared, size = contexts.sparkSession.sparkContext.broadcast(of), len(of)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * 2 * classes, np.int64)
        for b in batches:
            for packed in zip(*b.columns, strict=True):
                word, code, n = (np.frombuffer(x.as_py(), t) for x, t in zip(packed, (np.int32, np.int32, np.int64), strict=True))
                np.add.at(total, word.astype(np.int64) * (2 * classes) + shared.value[code >> 1] + classes * (code & 1), n)
        some, counts = matrix_rows(total.reshape(size, -1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts, pa.binary())], ["id", "counts"])

    out = summed(contexts.mapInArrow(rows, "id int, counts binary"), size, 2 * classes)
    shared.destroy()
    return out


def log_transitions(pairs: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class | class before), from counts; no class has probability zero."""
    share = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    return np.log((pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR))


def average_gain(pairs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each class gains by a word of `AVERAGE` occurrences among average neighbours; size: log of the classes' sizes."""
    share, step = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs)), log_transitions(pairs)
    return AVERAGE * (step @ share + share @ step - size)


@dataclass
class Others:
    """What the words outside the head are to the exchange: how often the classes to which they belong stand beside each head
    word (as of by_class), how many occurrences each class has of them, and how often it has two of them in sequence."""

    beside: np.ndarray
    count: np.ndarray
    pairs: np.ndarray

    @classmethod
    def none(cls, size: int, classes: int) -> Others:
        return cls(np.zeros((size, 2 * classes), np.int64), np.zeros(classes), np.zeros((classes, classes)))


def start(contexts: DataFrame, count: np.ndarray, classes: int) -> np.ndarray:
    """To begin with, words go together that have the same of the most frequent words beside them."""
    size, half = len(count), classes // 2
    rank = ranks(count)
    beside = by_class(contexts, np.minimum(rank, half), half + 1)
    seeds = np.bincount(np.minimum(rank, half), count, half + 1)[:half] + 1
    lift = np.hstack([beside[:, :half], beside[:, half + 1 : -1]]) / np.tile(seeds, 2)
    return np.where(lift.any(axis=1), lift.argmax(axis=1), rank % classes)


def ranks(count: np.ndarray) -> np.ndarray:
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    return rank


def head_pairs(beside: np.ndarray, of: np.ndarray, others: Others) -> np.ndarray:
    """Counts of class pairs: of a head word with any, of others with a head word, and of two others. `beside` has them all."""
    classes = len(others.pairs)
    one = np.zeros((len(of), classes))
    one[np.arange(len(of)), of] = 1
    return one.T @ beside[:, classes:] + others.beside[:, :classes].T @ one + others.pairs


def exchange(contexts: DataFrame, count: np.ndarray, of: np.ndarray, others: Others, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each head word (count: how often each occurs; of: the class it is in), and counts of class pairs."""
    size, classes = len(count), len(others.pairs)
    rank, still = ranks(count), 0
    for turn in range(rounds):
        beside = by_class(contexts, of, classes) + others.beside
        before, after = beside[:, :classes], beside[:, classes:]
        pairs, log_size = head_pairs(beside, of, others), np.log(np.bincount(of, count, classes) + others.count + 1)
        step = log_transitions(pairs)
        gain = after @ step.T + before @ step - count[:, None] * log_size + average_gain(pairs, log_size)
        best = gain.argmax(axis=1)
        moves = (gain[np.arange(size), best] > gain[np.arange(size), of] + 1e-6) & (rank % 2 == turn % 2)
        of = np.where(moves, best, of)
        still = still + 1 if moves.sum() <= size // 200 else 0
        if still == 2:
            break
    return of, head_pairs(by_class(contexts, of, classes) + others.beside, of, others)


def whole_words(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns (w, ...) in the order of w, dealt anew so that every word is in one part."""
    held: list[list[np.ndarray]] = []

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for part in parts:
        if not len(part[0]):
            continue
        last = np.searchsorted(part[0], part[0][-1])
        if last or (held and held[0][0][0] != part[0][-1]):
            yield merged([*held, [x[:last] for x in part]])
            held = []
        held.append([x[last:] for x in part])  # the last word may go on
    if held:
        yield merged(held)


class Choice:
    """The class that makes a word's bigrams likeliest, under counts of class pairs and the classes' sizes."""

    def __init__(self, pairs: np.ndarray, count: np.ndarray) -> None:
        self.step, self.size = log_transitions(pairs), np.log(count + 1)
        self.average = average_gain(pairs, self.size)

    def __call__(self, word: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For words of numbers 0, 1, ... their classes. Each row adds `times` occurrences, and n times the classes beside
        it; the number of classes stands for a neighbour that doesn't count."""
        words, classes = len(times), len(self.step)
        beside = [np.bincount(word * (classes + 1) + c, n, words * (classes + 1)).reshape(words, -1)[:, :classes] for c in (before, after)]
        return (beside[0] @ self.step + beside[1] @ self.step.T - times[:, None] * self.size + self.average).argmax(axis=1)


def occurrences(docs: DataFrame, head: Head) -> DataFrame:
    """w, code of every occurrence of a word outside the head: the numbers of the head words before it and after it, the
    head's size where a neighbour isn't one of them, as before * (size + 1) + after."""
    shared, size = docs.sparkSession.sparkContext.broadcast(head), len(head.words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = tokens(block.column(0))[0]
            at = shared.value(w)
            number = np.where(at >= 0, at, size)
            rare = np.flatnonzero(at < 0)  # never the last token: that is the end, of the head
            yield pa.RecordBatch.from_arrays([pa.array(w[rare]), pa.array(before_each_number(number, shared.value)[rare] * (size + 1) + number[rare + 1])], ["w", "code"])

    return docs.select("text").mapInArrow(rows, "w long, code long")


def before_each_number(number: np.ndarray, head: Head) -> np.ndarray:
    return np.insert(number[:-1], 0, head(np.array([END]))[0])


def outside_bigrams(docs: DataFrame, head: Head) -> DataFrame:
    """a, b of every bigram of which neither word is of the head."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = tokens(block.column(0))[0]
            rare = shared.value(w) < 0
            both = np.flatnonzero(rare[:-1] & rare[1:])  # every text's end token is between it and the next
            yield pa.RecordBatch.from_arrays([pa.array(w[both]), pa.array(w[both + 1])], ["a", "b"])

    return save(docs.select("text").mapInArrow(rows, "a long, b long"), "bigrams")


def with_classes(bigrams: DataFrame, found: DataFrame) -> DataFrame:
    """a, b, class_a, class_b of the bigrams, by the words' classes (w, class)."""
    return bigrams.join(found.toDF("a", "class_a"), "a").join(found.toDF("b", "class_b"), "b")


def cells(pairs: DataFrame, classes: int) -> np.ndarray:
    """How often each pair of classes (class_a, class_b) is there."""
    out = np.zeros((classes, classes))
    for r in pairs.groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["class_a"], r["class_b"]] = r["n"]
    return out


def first_classes(docs: DataFrame, head: Head, of: np.ndarray, choice: Choice) -> DataFrame:
    """w, class, codes, ns: each word outside the head, its class by its neighbours in the head, and how often it has each
    code of `occurrences`. Further rows, of a part (`class`) of the head and without w, have the cells of by_class's matrix that
    these words' classes fill (codes), and by how much (ns)."""
    classes, size = len(choice.step), len(head.words)
    shared = docs.sparkSession.sparkContext.broadcast((np.append(of, classes), choice))
    names = ["w", "class", "codes", "ns"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, choose = shared.value
        total = np.zeros((size + 1) * 2 * classes, np.int64)
        for w, code in whole_words([c.to_numpy() for c in b.columns] for b in batches):
            order = np.lexsort((code, w))
            w, code = w[order], code[order]
            each = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (code[1:] != code[:-1])))
            n = np.diff(np.append(each, len(w)))
            w, code = w[each], code[each]
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            a, b = np.divmod(code, size + 1)
            best = choose(word, own[a], own[b], n, np.add.reduceat(n, first))
            np.add.at(total, a * (2 * classes) + classes + best[word], n)
            np.add.at(total, b * (2 * classes) + best[word], n)
            at = np.append(first, len(w))
            yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(best.astype(np.int32)), binaries(code, at), binaries(n, at)], names)
        some = np.flatnonzero(total[: size * 2 * classes])
        parts = np.arange(-(-size // PART))
        at = np.searchsorted(some, np.append(parts, len(parts)) * (PART * 2 * classes))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.array(parts.astype(np.int32)), binaries(some, at), binaries(total[some], at)], names)

    by_word = occurrences(docs, head).repartition("w").sortWithinPartitions("w")
    return save(by_word.mapInArrow(rows, "w long, class int, codes binary, ns binary"), "first")


def beside_head(first: DataFrame, size: int, classes: int) -> np.ndarray:
    """The matrix whose cells first_classes has, added up by executors."""
    width = 2 * classes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, codes, ns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = total.setdefault(part, np.zeros(PART * width, np.int64))
                held[np.frombuffer(codes, np.int64) - part * PART * width] += np.frombuffer(ns, np.int64)
        for part, held in total.items():
            some, counts = matrix_rows(held.reshape(PART, width))
            yield pa.RecordBatch.from_arrays([pa.array((some + part * PART).astype(np.int32)), pa.array(counts, pa.binary())], ["id", "counts"])

    with run_once(first.sparkSession):
        return summed(first.where("w is null").select("class", "codes", "ns").repartition("class").mapInArrow(rows, "id int, counts binary"), size, width)


def last_classes(first: DataFrame, pairs: DataFrame, size: int, of: np.ndarray, choice: Choice) -> DataFrame:
    """w, class: each word outside the head, its class by all its neighbours. pairs: as of with_classes. Further rows, without
    w, have how often (n) a pair of classes (`class`, as a * classes + b) is that of such a word and one of the head."""
    classes = len(choice.step)
    shared = first.sparkSession.sparkContext.broadcast((np.append(of, classes), choice))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, choose = shared.value
        total = np.zeros((classes + 1) ** 2, np.int64)

        def contexts() -> Iterator[list[np.ndarray]]:
            """w, before, after, n, times."""
            for batch in batches:
                w = batch.column(0).to_numpy()
                code, many = joined_binaries(batch.column(1), np.int64)
                n, _ = joined_binaries(batch.column(2), np.int64)
                a, b = (own[x] for x in np.divmod(code, size + 1))
                alone = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
                c, d = np.divmod(batch.column(3).drop_null().to_numpy(), classes + 1)
                once = np.ones(len(c), np.int64)
                part = [np.concatenate(x) for x in ((np.repeat(w, many), w[alone]), (a, c), (b, d), (n, once), (n, 0 * once))]
                order = np.argsort(part[0], kind="stable")
                yield [x[order] for x in part]

        for w, a, b, n, times in whole_words(contexts()):
            first_ = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            word = np.repeat(np.arange(len(first_)), np.diff(np.append(first_, len(w))))
            best = choose(word, a, b, n, np.add.reduceat(times, first_))
            np.add.at(total, a * (classes + 1) + best[word], times)  # where times is 0 both are outside the head
            np.add.at(total, best[word] * (classes + 1) + b, times)
            yield pa.RecordBatch.from_arrays([pa.array(w[first_]), pa.array(best.astype(np.int32)), pa.array(np.zeros(len(first_), np.int64))], ["w", "class", "n"])
        found = total.reshape(classes + 1, -1)[:classes, :classes].reshape(-1)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(found[some])], ["w", "class", "n"])

    none = F.lit(None).cast("binary")
    sides = F.explode(F.array(
        F.struct(F.col("b").alias("w"), (F.col("class_a") * (classes + 1) + classes).alias("code")),
        F.struct(F.col("a").alias("w"), (F.lit(classes * (classes + 1)) + F.col("class_b")).alias("code")),
    ))
    beside = pairs.select(sides.alias("x")).select("x.w", none.alias("codes"), none.alias("ns"), "x.code")
    all_ = first.where("w is not null").select("w", "codes", "ns", F.lit(None).cast("int").alias("code")).union(beside)
    return save(all_.repartition("w").sortWithinPartitions("w").mapInArrow(rows, "w long, class int, n long"), "classes")


def join_classes(docs: DataFrame, head: Head, count: np.ndarray, contexts: DataFrame, of: np.ndarray, pairs: np.ndarray, counts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """w, n, class of all words, the head's classes, and counts of class pairs over all bigrams; of, pairs: those of the head alone."""
    classes, size, spark = len(pairs), len(head.words), docs.sparkSession
    bigrams = outside_bigrams(docs, head)
    first = first_classes(docs, head, of, Choice(pairs, np.bincount(of, count, classes)))
    found = first.where("w is not null").select("w", "class")
    beside = save(with_classes(bigrams, found), "beside")
    others = Others(beside_head(first, size, classes), np.zeros(classes), cells(beside, classes))
    for r in found.join(counts, "w").groupBy("class").agg(F.sum("n").alias("n")).collect():
        others.count[r["class"]] = r["n"]
    of, pairs = exchange(contexts, count, of, others, MORE_ROUNDS)
    last = last_classes(first, beside, size, of, Choice(pairs, np.bincount(of, count, classes) + others.count))
    found = last.where("w is not null").select("w", "class")
    more = np.zeros(classes * classes)
    for r in last.where("w is null").groupBy("class").agg(F.sum("n").alias("n")).collect():
        more[r["class"]] = r["n"]
    own = spark.createDataFrame(list(zip(head.words.tolist(), of.tolist(), strict=True)), "w long, class int")
    words = save(counts.join(found.union(own), "w").select("w", "n", "class"), "vocabulary")
    inside = head_pairs(by_class(contexts, of, classes), of, Others.none(size, classes))
    with run_once(spark):
        outside = cells(with_classes(bigrams, found), classes)
    return words, of, inside + more.reshape(classes, classes) + outside


@dataclass
class Model:
    #: The words that are broadcast, sorted, with their counts and classes.
    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    #: log10 of transitions and, by class, of what divides a word's count plus one; the class of words not seen.
    transitions: np.ndarray
    total: np.ndarray
    unseen: int
    end: int
    n: int
    v: int

    def emission(self, count: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log10(count + 1.0) - self.total[of]


def train(docs: DataFrame, size: int = HEAD, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model, and w, n, class of all words of the documents (text)."""
    counts = save(tallied(docs, lambda w: w, "w"), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        none = np.zeros(0, np.int64)
        return Model(none, none, none, np.full((classes, classes), -np.log10(classes)), np.zeros(classes), 0, 0, 0, 0), counts.withColumn("class", F.lit(0))
    frequent = most_frequent(counts, KNOWN)
    most = np.lexsort((frequent["w"], -frequent["n"], frequent["w"] != END))[:size]
    # the end token is always one of them
    count = dict(zip(frequent["w"][most].tolist(), frequent["n"][most].tolist(), strict=True)) | {int(END): counts.where(F.col("w") == int(END)).first()["n"]}
    head = Head(np.array(list(count), np.int64))
    contexts, times = neighbours(docs, head), np.array([count[w] for w in head.words.tolist()])
    of, pairs = exchange(contexts, times, start(contexts, times, classes), Others.none(len(times), classes), ROUNDS)
    words, of, pairs = join_classes(docs, head, times, contexts, of, pairs, counts)
    tokens_, types, once = np.zeros(classes), np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect():
        tokens_[r["class"]], types[r["class"]], once[r["class"]] = r["n"], r["v"], r["once"]
    unseen = int(once.argmax())
    types[unseen] += 1
    known = most_frequent(words, KNOWN)
    by_word = np.argsort(known["w"])
    w, own, c = (known[k][by_word].astype(np.int64) for k in ("w", "n", "class"))
    end = int(of[head(np.array([END]))[0]])
    return Model(w, own, c, log_transitions(pairs) / np.log(10), np.log10(np.maximum(tokens_ + types, 1)), unseen, end, int(n), int(v)), words


PARTS = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, counts double, model double, w array<long>, before array<int>, after array<int>"


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of rows (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 33
        find = Head(m.words)
        for block in blocks(batches):
            w, first = tokens(block.column(2))
            at = find(w)
            known = at >= 0
            c = np.where(known, np.append(m.classes, -1)[at], -1)
            before = np.insert(c[:-1], 0, m.end)
            before[first[:-1]] = m.end
            logs = np.where(known, np.log10(np.append(m.counts, 0)[at] + 1.0), 0)
            # what a rare word has to do with is added once its class is known
            model_part = np.where(known, logs - m.total[c], 0) + np.where(known & (before >= 0), m.transitions[before, c], 0)
            after = np.append(c[1:], -1)
            after[first[1:] - 1] = -2  # nothing comes after the end
            add = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[first]))
            rare = np.flatnonzero(~known)
            edge = pa.array(np.searchsorted(rare, first), pa.int32())
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[rare], t)) for x, t in ((w, pa.int64()), (before, pa.int32()), (after, pa.int32()))]
            ids = np.arange(row, row + block.num_rows)
            row += block.num_rows
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(ids), pa.array(np.diff(first)), add(known.astype(np.int64)), add(logs), add(model_part), *lists], [x.split()[0] for x in PARTS.split(", ")])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, last = shared.value, 0
        for b in batches:
            row, before, after, n, c = (b.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
            if not len(row):
                continue
            before = np.where(before >= 0, before, np.insert(c[:-1], 0, last))  # the word before is rare too: the row before
            last = c[-1]
            model_part = m.emission(n, c) + m.transitions[before, c] + np.where(after >= 0, m.transitions[c, after], 0)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((n > 0).astype(np.int64)), pa.array(np.log10(n + 1.0)), pa.array(model_part)], ["row", "known", "logs", "part"])

    parts = save(docs.mapInArrow(rows, PARTS), "scores")
    tail = parts.select("row", F.posexplode(F.arrays_zip("w", "before", "after")).alias("pos", "x")).select("row", "pos", "x.w", "x.before", "x.after")
    seen = tail.join(words, "w", "left").select("row", "pos", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(model.unseen)).alias("class"))
    rare = seen.repartition("row").sortWithinPartitions("row", "pos").mapInArrow(chained, "row long, known long, logs double, part double")
    more = rare.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("known", "logs", "part")])
    all_ = parts.drop("w", "before", "after").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    base = plus("counts", "logs") - F.col("n_tokens") * F.lit(float(np.log10(model.n + model.v + 1)))
    return all_.select("doc_id", "held_out", "n_tokens", plus("n_known", "known").alias("n_known"), base.alias("base_score"), plus("model", "part").alias("score"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (bucket("doc_id", 7) == 2).alias("held_out"), "text")

    def scored() -> DataFrame:
        model, words = train(docs.where(~F.col("held_out")))
        return score(docs, model, words).withColumn("train_tokens", F.lit(model.n).cast("long"))

    return settled("scored", scored)
