"""Quality rules: text statistics, and a calibrated logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import U64, WordHashes, covered, inside, map_arrow, mixed, steps, window_hashes, word_arrays

#: Hash buckets of word unigrams and of character trigrams.
BUCKETS = 1 << 12
#: Labelled rows that the classifier is fitted on at most; the rest of the corpus is only scored.
SAMPLE = 2000
#: A document stays if its calibrated probability of good quality is at least this.
THRESHOLD = 0.5
#: Buckets whose column of the sample is dense on the driver at once.
COLUMNS = 1 << 9
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
#: Share of the sample that is kept from the fit to calibrate its scores, and the strength of the penalty.
HELD_OUT, PENALTY = 0.25, 1.0
SCALE = 64.0
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Model:
    """Weights by bucket (words, then characters), and the line that turns a score into a log odds."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -500, 500)))


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\r\x0b\x0c"))


def _text_arrays(texts: list[str | None], known: WordHashes):
    """Word hashes and bounds, code points and bounds."""
    hashes, bounds = word_arrays([x and x.encode() for x in texts], known)
    coded = [(x or "").encode("utf-32-le") for x in texts]
    points = np.frombuffer(b"".join(coded), dtype=np.uint32)
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) // 4 for x in coded], out=ends[1:])
    return hashes, bounds, points, ends


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each part of ``values``; exact for counts."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def base_values(texts: list[str | None], arrays) -> dict[str, np.ndarray]:
    hashes, bounds, points, ends = arrays
    n_words = np.diff(bounds)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    symbol = np.isin(points, np.array([ord(c) for c in SYMBOLS], dtype=np.uint32))
    lines = [[x for x in (text or "").split("\n") if _has_word(x)] for text in texts]
    windows = window_hashes(hashes, WINDOW)
    places = np.flatnonzero(inside(bounds, WINDOW))
    repeated = np.zeros(len(hashes), dtype=bool)
    if len(places):
        text_of = np.searchsorted(bounds, places, side="right").astype(U64)
        own = windows[places] ^ mixed(text_of)
        order = np.argsort(own)
        equal = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(own), dtype=bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        repeated = covered(places[twice], WINDOW, len(hashes))
    n_repeat = _sums(repeated, bounds)
    return {
        "n_words": n_words,
        "word_chars": np.diff(ends) - _sums(space, ends),
        "n_symbols": _sums(symbol, ends),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED_PERCENT * n_words),
    }


def _buckets(arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and of each character trigram, with the bounds of the texts."""
    hashes, bounds, points, ends = arrays
    shift = 64 - BUCKETS.bit_length() + 1
    words = (mixed(hashes) >> U64(shift)).astype(np.int64)
    lower = np.where((points >= 65) & (points <= 90), points + 32, points).astype(U64)
    grams = (lower[:-2] << U64(42) | lower[1:-1] << U64(21) | lower[2:]) * U64(0x9E3779B97F4A7C15) if len(lower) > 2 else np.empty(0, U64)
    whole = inside(ends, 3)
    grams = ((grams ^ (grams >> U64(32))) * U64(0xD6E8FEB86659FD93) >> U64(shift)).astype(np.int64)[whole] + BUCKETS
    sizes = np.maximum(np.diff(ends) - 2, 0)
    return words, bounds, grams, np.concatenate([[0], np.cumsum(sizes)])


def _scores(weights: np.ndarray, arrays) -> np.ndarray:
    """The mean weight of a text's words plus that of its trigrams; an empty text scores 0."""
    words, word_bounds, grams, gram_bounds = _buckets(arrays)
    out = np.zeros(len(word_bounds) - 1)
    for buckets, bounds in ((words, word_bounds), (grams, gram_bounds)):
        out += SCALE * _sums(weights[buckets], bounds) / np.maximum(np.diff(bounds), 1)
    return out


def _logistic(gram: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps in the space of the rows (there are few): the factor of each row.

    ``gram`` has the products of all rows; its diagonal is changed.
    """
    diagonal = slice(None, None, len(y) + 1)
    gram.flat[diagonal] += 1e-9
    a = np.zeros(len(y))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(gram @ a, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        target = gram @ a + (y - p) / r
        system = gram.copy()
        system.flat[diagonal] += penalty * (1 / r)
        new = np.linalg.solve(system, target)
        step, a = np.abs(new - a).max(), new
        if step < 1e-8:
            break
    return a


def _platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds; targets are drawn in as Platt does for few rows."""
    good = y.sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x, beta = np.column_stack([scores, np.ones(len(scores))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p) - 1e-6 * (beta - np.array([1.0, 0.0])))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled documents, chosen by the hash of their id: sparse counts and label.

    Labels other than 0 and 1 and null ids are left out; of several labels the smallest counts, of
    several documents with one id that with the smallest text hash.
    """
    draw = F.md5(F.col("doc_id").cast("string"))
    labelled = (
        labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("doc_id is not null")
        .orderBy(draw, "doc_id").limit(sample)
    )
    # at most ``sample`` rows of two numbers: small enough for every executor whatever the corpus
    chosen = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(labelled), "doc_id")
    schema = "doc_id long, quality int, text_hash long, bucket array<int>, share array<float>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in steps(batches):
            texts = batch["text"].to_pylist()
            words, wb, grams, gb = _buckets(_text_arrays(texts, known))
            buckets, shares, keys = [], [], []
            for i in range(len(texts)):
                parts = [np.bincount(v[b[i] : b[i + 1]], minlength=2 * BUCKETS) / max(1, b[i + 1] - b[i]) for v, b in ((words, wb), (grams, gb))]
                total = parts[0] + parts[1]
                kept = np.flatnonzero(total)
                buckets.append(kept.astype(np.int32))
                shares.append(total[kept].astype(np.float32))
                keys.append(int(kept.sum()) * 1_000_003 + len(texts[i]))
            columns = [batch["doc_id"], batch["quality"], pa.array(keys, pa.int64()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "text_hash", "bucket", "share"])

    counted = map_arrow(chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text"), count, schema)
    one = counted.groupBy("doc_id").agg(F.min_by(F.struct("quality", "bucket", "share"), "text_hash").alias("row"))
    return one.select("doc_id", "row.*")


def _columns(row: np.ndarray, bucket: np.ndarray, share: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The matrix of ``n`` texts by buckets, COLUMNS of it at a time; all of it is never dense at once."""
    for start in range(0, 2 * BUCKETS, COLUMNS):
        own = np.flatnonzero((bucket >= start) & (bucket < start + COLUMNS))
        x = np.zeros((n, COLUMNS), dtype=np.float32)
        x[row[own], bucket[own] - start] = SCALE * share[own]
        yield slice(start, start + COLUMNS), x


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the sample and calibrate on its held-out part; without both labels every text has odds 1.

    The driver holds the sample's counts as they come from Arrow and the products of its rows; with
    ``SAMPLE`` rows that is a fraction of the dense matrix.
    """
    rows = sample_rows(docs, labels, sample).toArrow()
    ids, n = rows["doc_id"].to_numpy(), rows.num_rows
    order = np.argsort(ids)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    y = rows["quality"].to_numpy()[order].astype(np.float64)
    held = mixed((ids[order] & (2**63 - 1)).astype(U64)) % U64(1000) < U64(int(1000 * HELD_OUT))
    if len({*y[~held]}) < 2:
        return Model(np.zeros(2 * BUCKETS), 1.0, 0.0)
    counts = np.repeat(place, pc.list_value_length(rows["bucket"]).to_numpy()), pc.list_flatten(rows["bucket"]).to_numpy(), pc.list_flatten(rows["share"]).to_numpy()
    del rows
    centred = lambda x: (x[~held] - x[~held].mean(axis=0)).astype(np.float64)
    gram = np.zeros((int((~held).sum()),) * 2)
    for _, x in _columns(*counts, n):
        part = centred(x)
        gram += part @ part.T
    factors = _logistic(gram, y[~held], PENALTY)
    del gram
    fit = held if len({*y[held]}) == 2 else ~held
    weights, scores = np.empty(2 * BUCKETS), np.zeros(int(fit.sum()))
    for own, x in _columns(*counts, n):
        weights[own] = centred(x).T @ factors
        scores += x[fit].astype(np.float64) @ weights[own]
    return Model(weights, *_platt(scores, y[fit]))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """doc_id, the base values, ``probability`` and ``kept``; with ``keep_columns`` all columns of ``docs`` first.

    Every whole text is scored in Arrow batches, without a shuffle. A null text has no words, so it
    fails the base rules. Repeated and null ids keep one row each; an empty table gives no rows.
    Other columns are ignored; with ``keep_columns`` the values are under ``quality_rules``, which
    replaces a column of that name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = f"{BASE}, probability double, kept boolean"
    names = [x.split()[0] for x in inner.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = WordHashes(), sent.value
        for batch in steps(batches):
            texts = batch["text"].to_pylist()
            arrays = _text_arrays(texts, known)
            values = base_values(texts, arrays)
            values["probability"] = model.probability(_scores(model.weights, arrays))
            values["kept"] = ~values["base_failed"] & (values["probability"] >= threshold)
            columns = [pa.array(values[n]) for n in names]
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names)], [*batch.schema.names, "quality_rules"])
            else:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

    if keep_columns:
        docs = docs.drop("quality_rules")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return map_arrow(docs, score, f"{fields}, quality_rules struct<{inner.replace(' ', ':').replace(',:', ',')}>")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), score, f"doc_id {kind}, {inner}")
