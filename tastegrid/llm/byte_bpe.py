"""Byte-level byte-pair encoding by a segment tree over byte positions, and decoding.

A pattern cuts a text into pieces; a piece is encoded by itself. Its bytes are the leaves of a segment tree: the leaf
of a live position, where a token starts, holds the rank of the pair of this token and the next one, and every inner
node the smallest rank below it, at its leftmost position. The root names the next merge. A merge changes
three leaves, each in a logarithmic number of steps: the pair's own position, that of the live neighbour before it, and
the second half's, which dies. A piece of n bytes so takes n log n steps, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import BATCH_BYTES, arrow_type, column_values, text_of

# Pieces of a generation that a Python worker keeps with their tokens. A full generation becomes the old one, and what
# is used of that moves on, so frequent pieces stay.
PIECE_MEMORY = 400_000
# Longer pieces are encoded without being remembered.
LONGEST_KEPT = 48
# White space as the Unicode property has it: ``\s`` of Python's engines has other control characters in it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Leaf of a position whose pair has no rank, or where no token starts.
NONE = 1 << 62
PLACE = (1 << 32) - 1


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """Token bytes and their rank, which is also their id, from lines of base64 and number."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}


def piece_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space spelt out; it must not escape a backslash before ``s``."""
    spelt = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelt)


class ByteTokenizer(dict):
    """Pieces and their ids (little-endian 32-bit integers): a missing piece is encoded, and kept if it is short."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.ranks = ranks
        self.labels = {r: t for t, r in ranks.items()}
        self.pieces = piece_pattern(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECE_MEMORY:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a piece that is a token stays whole."""
        ranks, labels = self.ranks, self.labels
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        tokens = [ranks[piece[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        rank_of = ranks.get
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            low, high = tree[2 * k], tree[2 * k + 1]
            tree[k] = low if low < high else high
        while (best := tree[1]) != NONE:
            i = best & PLACE
            j, p = after[i], before[i]
            k = after[j]
            tokens[i], tokens[j], after[i] = best >> 32, -1, k
            merged = labels[tokens[i]]
            rank = None
            if k < n:
                before[k] = i
                rank = rank_of(merged + labels[tokens[k]])
            changed = [(size + j, NONE), (size + i, NONE if rank is None else rank << 32 | i)]
            if p >= 0:
                rank = rank_of(labels[tokens[p]] + merged)
                changed.append((size + p, NONE if rank is None else rank << 32 | p))
            for at, value in changed:
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    if other < value:
                        value = other
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [t for t in tokens if t >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def _tokenizer(rank_file: bytes, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(read_ranks(rank_file), pattern)


def encode_decode(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column with ``n_tokens`` long, ``ids`` array of int and ``decoded`` binary. One row per row of
    ``docs``, repeated rows included; a null or empty text has no tokens and decodes to no bytes; a null id stays null;
    other columns are not read, whatever their names. There are no special tokens: their strings are plain text.
    The driver reads the rank file and broadcasts it: its size is that of the vocabulary. A worker remembers at
    most ``PIECE_MEMORY`` short pieces, which changes no result. Letters that are newer than the Unicode tables of
    the regex module may be cut into other pieces than newer libraries cut.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    key_type = arrow_type(source, "id")
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded binary"

    def rows(keys: list, codes: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(c) // 4 for c in codes], np.int64)
        places = pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32))
        ids = pa.ListArray.from_arrays(places, pa.array(np.frombuffer(b"".join(codes), "<i4")))
        columns = [pa.array(keys, key_type), pa.array(sizes), ids, pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value, pattern)
        keys, codes, texts, held = [], [], [], 0
        for batch in batches:
            for key, text in zip(column_values(batch, "id"), column_values(batch, "text")):
                ids = tokenizer.encode(text)
                decoded = tokenizer.decode(np.frombuffer(ids, "<u4").tolist())
                keys.append(key)
                codes.append(ids)
                texts.append(decoded)
                held += len(ids) + len(decoded)
                if held >= BATCH_BYTES:
                    yield rows(keys, codes, texts)
                    keys, codes, texts, held = [], [], [], 0
        if keys:
            yield rows(keys, codes, texts)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The encoded rows with SHA-256 digests in the place of ids (decimal, joined by a space) and decoded bytes."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
