"""Edit-aware token counts: a segment tree of pre-token segments for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equipoise.llm.bpe import ENCODE_BYTES, Encoder, encoder, read_tokenizer
from equipoise.llm.common import map_arrow, ship, steps
from equipoise.session import cut_lineage

#: Characters after which a leaf ends at the next place where it may.
LEAF_CHARS = 256


def segments(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in leaves: each but the first begins with a space that a non-space follows.

    There the tokenizer begins a new piece whatever stands before, so leaves can be encoded alone.
    """
    out, begin = [], 0
    while (at := text.find(" ", begin + size)) >= 0:
        while 0 <= at < len(text) - 1 and text[at + 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0 or at == len(text) - 1:
            break
        out.append(text[begin:at])
        begin = at
    out.append(text[begin:])
    return out


class Tree:
    """Leaves of one text, with the sums of characters and tokens of every subtree."""

    def __init__(self, leaves: list[str], tokens: np.ndarray):
        self.leaves, self.first = leaves, 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.first, 2), dtype=np.int64)
        self.sums[self.first : self.first + len(leaves), 0] = [len(x) for x in leaves]
        self.sums[self.first : self.first + len(leaves), 1] = tokens
        for low in (1 << k for k in range(self.first.bit_length() - 2, -1, -1)):
            self.sums[low : 2 * low] = self.sums[2 * low : 4 * low : 2] + self.sums[2 * low + 1 : 4 * low : 2]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and that leaf's first character."""
        node, begin = 1, 0
        while node < self.first:
            node *= 2
            if char >= begin + self.sums[node, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.first, begin

    def set_leaf(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.first + leaf
        change = np.array([len(text), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, at: int, deleted: int, inserted: str) -> tuple[int, str]:
        """Empty the leaves that an edit touches; returns the leaf that takes their text, and that text.

        The leaf before the edit takes it, so that no later leaf loses the space it begins with. If the
        edit comes within two characters of a leaf's own beginning, the leaf before joins in.
        """
        at = min(max(at, 0), self.chars)
        deleted = min(max(deleted, 0), self.chars - at)
        if not self.chars:
            return 0, inserted
        first, begin = self.leaf_at(max(at - 1, 0))
        if at - begin < 2 and begin > 0:
            first, begin = self.leaf_at(begin - 1)
        last, last_begin = self.leaf_at(at + deleted - 1) if deleted else self.leaf_at(max(at - 1, 0))
        text = "".join(self.leaves[first : last + 1])
        for leaf in range(first + 1, last + 1):
            self.set_leaf(leaf, "", 0)
        return first, text[: at - begin] + inserted + text[at - begin + deleted :]


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _counts(encode: Encoder, texts: list[str]) -> np.ndarray:
    return np.diff(encode.encode(pa.array(texts, pa.string()))[1]) if texts else np.empty(0, np.int64)


def token_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """key (of the text), leaf_chars, leaf_tokens and n_tokens: the leaves of the tree of each text.

    Texts that stand several times have one row. Inner sums follow from the leaves, so they are put up
    when a tree is loaded. A null text is empty; other columns are ignored.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        for batch in steps(batches, size=ENCODE_BYTES):
            leaves = [segments(t or "") for t in batch["text"].to_pylist()]
            flat = [x for own in leaves for x in own]
            tokens = _counts(encode, flat)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int32)
            listed = lambda values, b=bounds: pa.ListArray.from_arrays(pa.array(b), pa.array(np.asarray(values, dtype=np.int32)))
            sums = np.add.reduceat(tokens, bounds[:-1])
            yield pa.RecordBatch.from_arrays([batch["key"], listed([len(x) for x in flat]), listed(tokens), pa.array(sums.astype(np.int64))], ["key", "leaf_chars", "leaf_tokens", "n_tokens"])

    rows = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text"))
    trees = map_arrow(rows, build, "key binary, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")
    once = trees.groupBy("key").agg(F.any_value(F.struct("leaf_chars", "leaf_tokens", "n_tokens")).alias("tree"))
    return cut_lineage(once.select("key", "tree.*"))


def edited_counts(docs: DataFrame, trees: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token counts after the edits of each document, without encoding it anew.

    ``docs`` has doc_id, text and ``edits``: an array of (at, deleted, inserted) that act one after
    the other, in characters of the text as it then is. Places beyond the text mean its end, negative
    ones its beginning; null edits and null fields do nothing. Returns doc_id, n_tokens (before),
    n_edits, n_tokens_after, n_leaves, n_encoded (leaves encoded again), chars_encoded. Rows stay one
    to one; a tree must be there for every text, as ``token_trees`` of the same documents gives them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits", text_key().alias("key"))
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_leaves", "n_encoded", "chars_encoded"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = pa.array([squeeze((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], packed, batch["edits"], batch["key"]], ["doc_id", "packed", "edits", "key"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, expand = encoder(sent.value), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            loaded, edits = [], []
            for packed, own, chars, tokens in zip(*(batch[c].to_pylist() for c in ("packed", "edits", "leaf_chars", "leaf_tokens")), strict=True):
                text = expand(packed).decode()
                ends = np.cumsum(chars).tolist()
                loaded.append(Tree([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.array(tokens)))
                edits.append([e for e in own or () if e is not None])
            before = [t.tokens for t in loaded]
            encoded, chars = np.zeros(len(loaded), np.int64), np.zeros(len(loaded), np.int64)
            for turn in range(max(map(len, edits), default=0)):
                # the turn's edits of all texts are encoded in one call
                touched = [(i, *loaded[i].edit(e[turn]["at"] or 0, e[turn]["deleted"] or 0, e[turn]["inserted"] or "")) for i, e in enumerate(edits) if turn < len(e)]
                for (i, leaf, text), n in zip(touched, _counts(encode, [x[2] for x in touched]), strict=True):
                    loaded[i].set_leaf(leaf, text, int(n))
                    encoded[i] += 1
                    chars[i] += len(text)
            values = [before, [len(e) for e in edits], [t.tokens for t in loaded], [len(t.leaves) for t in loaded], encoded, chars]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(np.asarray(v, dtype=np.int64)) for v in values)], names)

    edit_type = docs.schema["edits"].dataType.simpleString()
    # texts go through the shuffle compressed
    packed = map_arrow(rows, pack, f"doc_id long, packed binary, edits {edit_type}, key binary")
    return map_arrow(packed.join(trees.drop("n_tokens"), "key"), apply, ", ".join(f"{n} long" for n in names))
