"""Language-model scores from subword lattices: all segmentations of a word count, not the best one."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import STEP_BYTES, U64, map_arrow, steps
from equipoise.session import cut_lineage

#: Rounds of expectation and maximization, and how many pieces' worth of evidence the vocabulary's own scores are.
ROUNDS, PRIOR = 2, 32_000.0
#: Words that are sent to every executor with their scores, the most frequent ones; all others are joined.
HEAD = 200_000
#: Longer words are known by their SHA-256, which is as long as no shorter word.
KEY_BYTES = 31
#: Words up to this length go through matrices, longer ones one by one.
MATRIX_BYTES = 48
#: Words that are worked on together in a task.
WORDS = 1 << 16
BASE = U64(0x9E3779B97F4A7C15)
SPACE_BYTE = re.compile(rb"[\x09-\x0d\x20]")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (a leading space begins a word) and the natural logs of their weights; ``end`` is the text's end."""

    pieces: tuple[bytes, ...]
    weights: np.ndarray
    end: float


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model, weighted by their scores.

    A byte-pair model's score is the negative rank of its merge, so the weights follow Zipf's law,
    1 / (1 - score). Its byte pieces, which have no rank, weigh as much as the last one; where a byte
    and a piece of one character are the same, one is kept. Pieces with spaces inside cannot occur.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:]:
            found[piece] = 1.0 / (1.0 - model.get_score(i))
    least = min(found.values(), default=1.0)
    for byte in range(256):
        found.setdefault(bytes([byte]), least)
    end = 1.0 / (1.0 - model.get_score(model.eos_id()))
    total = sum(found.values()) + end
    return Vocabulary(tuple(found), np.log(np.array(list(found.values())) / total), math.log(end / total))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U64(1)], np.full(n, BASE, dtype=U64)]), dtype=U64)


class Lattice:
    """Finds the pieces in words and sums over all ways to put a word together from them."""

    def __init__(self, vocabulary: Vocabulary):
        self.weights, self.longest = vocabulary.weights, max(map(len, vocabulary.pieces))
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces)}
        self.powers = _powers(max(MATRIX_BYTES + 1, self.longest))
        keys = np.zeros(len(vocabulary.pieces), dtype=U64)
        sizes = np.array([len(p) for p in vocabulary.pieces])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            matrix = np.frombuffer(b"".join(vocabulary.pieces[i] for i in rows), dtype=np.uint8).reshape(len(rows), size)
            keys[rows] = self._prefixes(matrix)[size]
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self._slot(keys)] = True

    @staticmethod
    def _prefixes(matrix: np.ndarray) -> np.ndarray:
        """The hash of every row's first 0, 1, 2 ... bytes; that of a part in between follows from two of them."""
        out = np.zeros((matrix.shape[1] + 1, len(matrix)), dtype=U64)
        for column in range(matrix.shape[1]):
            out[column + 1] = out[column] * BASE + (matrix[:, column].astype(U64) + U64(1))
        return out

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0xD6E8FEB86659FD93)) >> U64(44)).astype(np.int64)

    def edges(self, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Every piece in words of one length: begin, end, the words that have it there and its number; by end, then begin."""
        prefix, size = self._prefixes(matrix), matrix.shape[1]
        for end in range(1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                key = prefix[end] - prefix[begin] * self.powers[end - begin]
                rows = np.flatnonzero(self.bits[self._slot(key)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                    same = self.keys[at] == key[rows]
                    if same.any():
                        yield begin, end, rows[same], self.order[at[same]]

    def _alone(self, word: bytes) -> list[tuple[int, int, int]]:
        get, out = self.ids.get, []
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - self.longest), end):
                if (piece := get(word[begin:end])) is not None:
                    out.append((begin, end, piece))
        return out

    def _long(self, word: bytes, n: float, expected: np.ndarray | None) -> float:
        edges, weights = self._alone(word), self.weights
        before = np.full(len(word) + 1, -np.inf)
        before[0] = 0.0
        for begin, end, piece in edges:
            before[end] = np.logaddexp(before[end], before[begin] + weights[piece])
        if expected is not None:
            after = np.full(len(word) + 1, -np.inf)
            after[-1] = 0.0
            for begin, end, piece in sorted(edges, reverse=True):
                after[begin] = np.logaddexp(after[begin], weights[piece] + after[end])
            for begin, end, piece in edges:
                expected[piece] += n * math.exp(before[begin] + weights[piece] + after[end] - before[-1])
        return float(before[-1])

    def scores(self, words: Sequence[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """The natural log of each word's probability, over all segmentations of a space and the word.

        Forward recursion in log space, for all words of one length at once. With ``counts`` and
        ``expected`` the backward recursion follows, and the number of times each piece is expected in
        the counted words is added to ``expected``. Every byte is a piece, so every word has a way.
        """
        out = np.zeros(len(words))
        if not len(words):
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        for at, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = order[at:stop]
            size = int(sizes[own[0]])
            if size > MATRIX_BYTES:
                for i in own.tolist():
                    out[i] = self._long(b" " + words[i], 0.0 if counts is None else float(counts[i]), expected)
                continue
            matrix = np.frombuffer(b"".join(b" " + words[i] for i in own.tolist()), dtype=np.uint8).reshape(len(own), size)
            before, kept = np.full((size + 1, len(own)), -np.inf), []
            before[0] = 0.0
            for begin, end, rows, pieces in self.edges(matrix):
                before[end, rows] = np.logaddexp(before[end, rows], before[begin, rows] + self.weights[pieces])
                if expected is not None:
                    kept.append((begin, end, rows, pieces))
            out[own] = before[size]
            if expected is None:
                continue
            after, n = np.full((size + 1, len(own)), -np.inf), counts[own].astype(np.float64)
            after[size] = 0.0
            for begin, end, rows, pieces in sorted(kept, key=lambda e: -e[0]):
                after[begin, rows] = np.logaddexp(after[begin, rows], self.weights[pieces] + after[end, rows])
            for begin, end, rows, pieces in kept:
                share = np.exp(before[begin, rows] + self.weights[pieces] + after[end, rows] - before[size, rows])
                expected += np.bincount(pieces, share * n[rows], len(expected))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are scored only; one without an id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def _parts(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(text, lower-cased part of it) in groups of bounded size; longer texts are cut at white space, never in a word."""
    group, size = [], 0
    for i, text in enumerate(texts):
        begin, text = 0, (text or b"").lower()
        while True:
            cut = SPACE_BYTE.search(text, begin + STEP_BYTES)
            part = text[begin : cut.start()] if cut else text[begin:]
            group.append((i, part))
            size += len(part)
            if size >= STEP_BYTES:
                yield group
                group, size = [], 0
            if not cut:
                break
            begin = cut.start()
    if group:
        yield group


def _coded(parts: list[tuple[int, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word among them, and the part it is in."""
    words = [part.split() for _, part in parts]
    coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(parts)), [len(own) for own in words])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all of ``docs``: text, held_out) and c (in those that are learned from); combined before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            learned = ~batch["held_out"].to_numpy(zero_copy_only=False)
            for parts in _parts(batch["text"].cast(pa.binary()).to_pylist()):
                words, index, of = _coded(parts)
                own = learned[np.array([i for i, _ in parts])][of]
                n, c = np.bincount(index, minlength=len(words)), np.bincount(index[own], minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(c)], ["word", "n", "c"])

    return map_arrow(docs.select("text", "held_out"), count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that there are many words of each length."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= WORDS or size >= 2 * STEP_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def learn(words: DataFrame, n_texts: int, vocabulary: Vocabulary, rounds: int = ROUNDS, prior: float = PRIOR) -> Vocabulary:
    """``vocabulary`` with weights that suit the counted words (word, c): expected counts, and its own scores as prior evidence.

    A round is one pass over the distinct words. Each task sums the pieces it expects; what meets is a
    row a piece.
    """
    start, known = vocabulary, words.filter("c > 0").select("word", "c")
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, expected = Lattice(sent.value), np.zeros(len(sent.value.pieces))
            for table in _gathered(batches):
                lattice.scores(table["word"].to_pylist(), table["c"].to_numpy(), expected)
            found = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(expected[found])], ["piece", "n"])

        sums = map_arrow(known, expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(vocabulary.pieces))
        n[sums["piece"].to_numpy()] = sums["n"].to_numpy()
        total = n.sum() + n_texts + prior
        weights = np.log((n + prior * np.exp(start.weights)) / total)
        vocabulary = replace(vocabulary, weights=weights, end=math.log((n_texts + prior * math.exp(start.end)) / total))
    return vocabulary


def scored_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, n, c and ``score`` (log10 of the word's probability) of every distinct word."""
    sent = words.sparkSession.sparkContext.broadcast(vocabulary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for table in _gathered(batches):
            own = table["word"].to_pylist()
            columns = [pa.array(list(map(key_of, own)), pa.binary()), table["n"].combine_chunks(), table["c"].combine_chunks(), pa.array(lattice.scores(own) / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "c", "score"])

    return map_arrow(words.select("word", "n", "c"), score, "key binary, n long, c long, score double")


def key_of(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else hashlib.sha256(word).digest()


def frequent(words: DataFrame, most: int = HEAD) -> DataFrame:
    """The most frequent of the words, ``most`` or fewer: those over a frequency that leaves so many."""
    grade = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    steps_down = sorted(words.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["grade"])  # 512 rows at most
    total, least = 0, 1 << 20
    for row in steps_down:
        total += row["words"]
        if total > most:
            break
        least = row["grade"]
    return words.filter(grade >= least)


def partial_scores(docs: DataFrame, head: dict[bytes, tuple[float, float, bool]]) -> DataFrame:
    """One row for each document, or for each part of a very long one: sums over its frequent words, and its other words.

    ``docs``: row, doc_id, held_out, text. ``head`` has (base, score, known) of frequent words. ``rest``
    holds the other words' keys and counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head)  # HEAD words at most

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = sent.value.get, (0.0, 0.0, False)
        for batch in steps(batches):
            for parts in _parts(batch["text"].cast(pa.binary()).to_pylist()):
                words, index, of = _coded(parts)
                keys = list(map(key_of, words.to_pylist()))
                found = [*map(get, keys)]
                is_head = np.fromiter((f is not None for f in found), dtype=bool, count=len(found))
                base, score, known = (np.array(x, dtype=np.float64) for x in zip(*(f or none for f in found), strict=True)) if found else (np.zeros(0),) * 3
                sums = [np.bincount(of, values[index], len(parts)).astype(np.float64) for values in (base, score, known)]
                other = ~is_head[index]
                pair, n = np.unique(of[other] * max(len(words), 1) + index[other], return_counts=True)
                owner, word = np.divmod(pair, max(len(words), 1))
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(parts)))]).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()).take(pa.array(word)), pa.array(n.astype(np.int64))], ["key", "n"])
                source = pa.array([i for i, _ in parts])
                columns = [batch[c].take(source) for c in ("row", "doc_id", "held_out")]
                columns += [pa.array(np.bincount(of, minlength=len(parts)).astype(np.int64)), pa.array(np.round(sums[2]).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds), rest)], ["row", "doc_id", "held_out", "words", "known", "base", "score", "rest"])

    schema = "row long, doc_id long, held_out boolean, words long, known long, base double, score double, rest array<struct<key:binary,n:long>>"
    return map_arrow(docs.select("row", "doc_id", "held_out", "text"), add, schema)


def score_documents(docs: DataFrame, vocabulary_path: str, *, rounds: int = ROUNDS, prior: float = PRIOR, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and ``score`` of every row of ``docs``.

    ``score`` is the log10 of a text's probability as a sequence of words and one end, where a word's is the sum
    over all its segmentations into pieces of the vocabulary, each piece weighted by its own probability.
    The weights begin as the vocabulary's scores and are refitted to the texts that are not held out.
    ``base_score`` is a unigram model of whole words.

    Distinct words are counted and scored once in a table that grows with the corpus. The most frequent
    ones (``head``, a bound) are sent to the tasks, so no word that is joined is in a great part of
    all texts; the others of each document are joined by word and summed by document.

    A null or empty text is its end alone. Rows with one doc_id stay rows of their own; those without an
    id are learned from. Other columns are ignored; an empty table gives no rows. Sums of doubles may
    differ in their last digits between runs.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text)
    counted = cut_lineage(word_counts(rows))
    n_texts = rows.filter("not held_out").count()
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, distinct = totals[0] + n_texts, totals[1] + (n_texts > 0)
    below = tokens + 0.1 * (distinct + 1)
    vocabulary = learn(counted, n_texts, read_vocabulary(vocabulary_path), rounds, prior)
    words = cut_lineage(scored_words(counted, vocabulary))
    sent = {r["key"]: (math.log10((r["c"] + 0.1) / below), r["score"], r["c"] > 0) for r in frequent(words, head).toArrow().to_pylist()}
    partial = cut_lineage(partial_scores(rows, sent))
    other = partial.select("row", F.explode("rest").alias("w")).select("row", "w.key", "w.n")
    joined = other.join(words.select("key", "c", F.col("score").alias("own")), "key")
    n = F.col("n")
    of_rest = joined.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("words"),
        F.when(F.col("c") > 0, n).otherwise(0).alias("known"), (n * F.log10((F.col("c") + 0.1) / F.lit(below))).alias("base"), (n * F.col("own")).alias("score"),
    )
    total = partial.drop("rest").unionByName(of_rest).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("words", "known", "base", "score")]
    )
    return total.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(n_texts > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10((n_texts + 0.1) / below)).alias("base_score"), (F.col("score") + vocabulary.end / math.log(10)).alias("score"),
    )
