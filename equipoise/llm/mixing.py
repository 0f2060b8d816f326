"""Mixing of sources to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.bpe import encode_bytes, encoder, read_tokenizer
from equipoise.llm.common import map_arrow, ship, steps

#: All values of a dimension that have no target of their own share one.
REST = "(rest)"
#: Values and the cells that occur are held on the driver and sent to the executors; more of either raise.
MAX_CELLS = 1_000_000
#: Topics in the order they are tried: the signs that a text has this share of or more; else it is prose.
TOPICS = (("numbers", "0123456789", 0.02), ("markup", "#*$%&|<>{}[]=_", 0.01), ("lines", "\n", 0.01))
SIGN_CLASS = np.zeros(256, dtype=np.uint8)
for _k, (_, _signs, _) in enumerate(TOPICS):
    SIGN_CLASS[np.frombuffer(_signs.encode(), dtype=np.uint8)] = _k + 1


def topic(text: str = "text") -> Column:
    """A class of format, not a subject, from the whole text: what it holds more of than prose does."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))) / F.greatest(F.length(t), F.lit(1))
    return F.coalesce(*[F.when(share(chars) >= least, F.lit(name)) for name, chars, least in TOPICS], F.lit("prose"))


def topics(texts: pa.Array) -> pa.Array:
    """``topic`` of whole texts in a task: the signs that decide are ASCII, so their bytes are counted."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    inside = lambda found: np.diff(np.searchsorted(np.flatnonzero(found), bounds - bounds[0]))
    n = np.maximum(np.diff(bounds) - inside((raw & 0xC0) == 0x80), 1)  # characters: bytes without those that continue one
    kinds = np.select([inside(SIGN_CLASS[raw] == k + 1) / n >= least for k, (_, _, least) in enumerate(TOPICS)], range(len(TOPICS)), len(TOPICS))
    return pa.array([*(name for name, _, _ in TOPICS), "prose"]).take(pa.array(kinds))


def with_tokens(docs: DataFrame, tokenizer_path: str, column: str = "n_tokens", topic_column: str | None = None, lean: bool = False) -> DataFrame:
    """``docs`` with the number of tokens of the whole text (null: 0) in ``column``, and its topic; columns of these names are replaced.

    With ``lean`` the tasks remember fewer words: slower, for runs that have little memory left.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    names = [c for c in docs.columns if c not in (column, topic_column)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, lean).encode
        for batch in steps(batches, size=encode_bytes(lean)):
            _, bounds = encode(batch["text"])
            added = {column: pa.array(np.diff(bounds))} | ({topic_column: topics(batch["text"])} if topic_column else {})
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *added.values()], [*names, *added])

    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` long", *([f"`{topic_column}` string"] if topic_column else [])]
    return map_arrow(docs, count, ", ".join(kinds))


def _held(rows: DataFrame, what: str) -> pa.Table:
    """The rows on the driver; too many raise, none are left out."""
    out = rows.limit(MAX_CELLS + 1).toArrow()
    if out.num_rows > MAX_CELLS:
        raise ValueError(f"over {MAX_CELLS} {what}; at most so many are held at once")
    return out


def _value(dimension: str) -> Column:
    return F.coalesce(F.col(f"`{dimension}`").cast("string"), F.lit(REST))


def tempered_targets(docs: DataFrame, dimensions: Sequence[str], weight: str, power: float, keep: float | None = None) -> dict[str, dict[str, float]]:
    """Targets that lie between the corpus (power 1) and equal shares (power 0).

    Every value has its own share, however many there are; over MAX_CELLS raise.
    With ``keep`` no target is more than the corpus holds when that share of it is kept: such a value's
    target is all it has, and the dimension's other values share the rest by the same rule.
    """
    targets = {}
    for d in dimensions:
        sums = docs.groupBy(_value(d).alias("v")).agg(F.sum(weight).cast("double").alias("w")).filter("w > 0")
        found = _held(sums, f"values of {d}").sort_by("v")
        own, held = found["v"].to_pylist(), found["w"].to_numpy()
        total = float(held.sum())
        shares = held**power / max((held**power).sum(), 1e-300)
        if keep is not None and total > 0:
            shares = reachable(shares, held / total, keep)
            shares = shares / shares.sum()
        targets[d] = dict(zip(own, shares.tolist(), strict=True))
    return targets


def _raised(weights: np.ndarray, others: np.ndarray, own: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The factor of each value with which its cells, each taken whole at most, weigh as much as its margin.

    What a value's cells weigh is concave in its factor, so steps along the tangent come to the root
    from below. A value whose margin is all it has gets a factor that takes its last cell whole.
    """
    sums = lambda x: np.bincount(own, x, len(margin))
    least = np.full(len(margin), np.inf)
    np.minimum.at(least, own, others)
    whole = margin >= sums(weights) * (1 - 1e-12)
    slope = sums(weights * others)
    factor = np.divide(margin, slope, out=np.zeros_like(slope), where=slope > 0)
    for _ in range(1000):
        full = factor[own] * others >= 1
        slope = sums(np.where(full, 0.0, weights * others))
        more = np.divide(margin - sums(np.where(full, weights, 0.0)), slope, out=np.zeros_like(slope), where=slope > 0)
        if not (more[~whole] > factor[~whole] * (1 + 1e-13)).any():
            break
        factor = np.maximum(factor, more)
    return np.where(whole & (margin > 0) & (least > 0), 1 / np.maximum(least, 1e-300), factor)


def reachable(margin: np.ndarray, held: np.ndarray, budget: float) -> np.ndarray:
    """``budget`` dealt out in proportion to ``margin``, to no value more than it ``held``; less if those with a margin hold less."""
    there = (margin > 0) & (held > 0)
    out = np.zeros(len(margin))
    if there.any():
        ratio = margin[there] / held[there]
        factor = _raised(held[there], ratio, np.zeros(int(there.sum()), np.int64), np.array([budget]))
        out[there] = held[there] * np.minimum(1.0, factor[0] * ratio)
    return out


def fit(weights: np.ndarray, codes: Sequence[np.ndarray], wanted: Sequence[np.ndarray], whole: bool, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """The factor of each cell (``codes`` say which value of each dimension it has) with which the sums by value are ``wanted``.

    Iterative proportional fitting: a cell's factor is the product of its values' factors, and one
    dimension's factors after the other are set so that its margin holds. With ``whole`` no cell's
    factor is over 1: the cells that would be are held there while the open ones are fitted to the
    rest of each margin. Margins that contradict the cells are met as closely as the last round comes.
    """
    if not len(weights):
        return np.ones(0)
    factors = [np.ones(len(m)) for m in wanted]
    product = lambda but: np.prod([f[c] for i, (f, c) in enumerate(zip(factors, codes, strict=True)) if i != but], axis=0) * np.ones(len(weights))
    limited = lambda x: np.minimum(1.0, x) if whole else x
    for _ in range(rounds):
        worst = 0.0
        for axis, (own, margin) in enumerate(zip(codes, wanted, strict=True)):
            others = product(axis)
            have = np.bincount(own, weights * limited(factors[axis][own] * others), len(margin))
            worst = max(worst, float(np.abs(have - margin).max(initial=0)))
            if whole:
                raised = _raised(weights, others, own, margin)
            else:
                slope = np.bincount(own, weights * others, len(margin))
                raised = np.divide(margin, slope, out=np.zeros_like(slope), where=slope > 0)
            factors[axis] = np.where(raised > 0, np.clip(raised, 1e-90, 1e90), 0.0)
        if worst < tolerance:
            break
    return limited(product(None))


def rake(weights: np.ndarray, margins: Sequence[np.ndarray], rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Iterative proportional fitting: ``weights`` scaled along one axis after the other until all margins hold.

    A margin's share of values that have no weight at all goes to the others in proportion. Margins
    that contradict the empty cells are met as closely as the last round comes.
    """
    codes, out = np.nonzero(weights > 0), np.zeros(weights.shape)
    cells = weights[codes] / max(weights.sum(), 1e-300)
    out[codes] = cells * fit(cells, codes, _present(cells, codes, margins), False, rounds, tolerance)
    return out


def _present(cells: np.ndarray, codes: Sequence[np.ndarray], margins: Sequence[np.ndarray]) -> list[np.ndarray]:
    wanted = [np.where(np.bincount(own, cells, len(m)) > 0, m, 0.0) for own, m in zip(codes, margins, strict=True)]
    return [m / m.sum() if m.sum() > 0 else m for m in wanted]


def chances(weights: np.ndarray, codes: Sequence[np.ndarray], margins: Sequence[np.ndarray], keep: float | None) -> np.ndarray:
    """The probability of each cell."""
    cells = weights / max(weights.sum(), 1e-300)
    wanted = _present(cells, codes, margins)
    if keep is None:
        ratio = fit(cells, codes, wanted, False)
        return ratio / max(ratio.max(initial=0), 1e-300)
    held = [np.bincount(own, cells, len(m)) for own, m in zip(codes, wanted, strict=True)]
    budget = min([keep, *(h[m > 0].sum() for h, m in zip(held, wanted, strict=True))])
    return fit(cells, codes, [reachable(m, h, budget) for m, h in zip(wanted, held, strict=True)], True)


def draw(seed: int) -> Column:
    """A number in [0, 1) from the document's id, the same in every run and engine."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10)
    return digits.cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], weight: str = "n_tokens", keep: float | None = None, seed: int = 0, chance: str = "probability", mark: str = "sampled") -> DataFrame:
    """``docs`` with ``probability`` and ``sampled`` (or the names given; columns called so are replaced): weights raked to the targets, and a draw for each document.

    ``targets`` names dimensions (columns) and the share of each value; values without one, and null,
    count as ``(rest)``, whose share is what the others leave. Weights are summed by cell, the table of
    cells is raked, and a cell's documents get the probability (raked weight / own weight). Without
    ``keep`` all are scaled as far as the targets allow with no probability over 1, which a rare value
    with a high target can make small. With ``keep`` (0 to 1) the expected weight is that share of the
    corpus: cells that would have a probability over 1 are taken whole and the others are raked again to
    what is left of each margin, so the margins hold. A value of which the corpus holds less than its
    target at this ``keep`` is taken whole, and the other values of its dimension share what is missing
    in proportion. Rows with one id are drawn together, as are all without an id; documents of weight 0
    count like those of their cell. An empty table gives no rows.
    Sampling is what this operator does: rows are marked, none are dropped.
    """
    dimensions = list(targets)
    shares = {d: {**targets[d]} for d in dimensions}
    for own in shares.values():
        own.setdefault(REST, max(0.0, 1.0 - sum(own.values())))
    values = {d: sorted(own) for d, own in shares.items()}
    spark, marked = docs.sparkSession, docs
    keys = [f"_equipoise_{i}" for i in range(len(dimensions))]
    for k, d in zip(keys, dimensions, strict=True):
        numbers = spark.createDataFrame(pa.table({f"{k}v": pa.array(values[d], pa.string()), k: pa.array(range(len(values[d])), pa.int32())}))
        marked = marked.withColumn(f"{k}v", _value(d)).join(F.broadcast(numbers), f"{k}v", "left").drop(f"{k}v")  # as many rows as targets
        marked = marked.withColumn(k, F.coalesce(F.col(k), F.lit(values[d].index(REST))))
    sums = marked.groupBy(*keys).agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).cast("double").alias("w")).filter("w > 0")
    found = _held(sums, "cells")  # a row a cell
    codes = [found[k].to_numpy().astype(np.int64) for k in keys]
    probability = chances(found["w"].to_numpy(), codes, [np.array([shares[d][v] for v in values[d]]) for d in dimensions], keep)
    cells = spark.createDataFrame(found.select(keys).append_column("probability", pa.array(probability, pa.float64())))
    cells = cells.withColumnRenamed("probability", "_equipoise_chance")
    joined = marked.join(F.broadcast(cells), keys, "left").drop(*keys, chance, mark)  # as many rows as cells
    rows = joined.withColumn(chance, F.coalesce(F.col("_equipoise_chance"), F.lit(0.0))).drop("_equipoise_chance")
    return rows.withColumn(mark, draw(seed) < F.col(f"`{chance}`"))
