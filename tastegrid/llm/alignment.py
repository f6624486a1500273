"""Alignment of two tokenizations of the same texts by the bytes their tokens cover.

A task encodes a block of texts both ways and goes on in Arrow: the token lists are flattened beside the index of
their text, cumulative sums of the tokens' bytes within a text give their ends, and a full outer hash join on
(text, end) brings the ends of both sides together. Sorted, every row is a stretch of bytes that no end cuts, so it lies
in exactly one token of each side: the next one whose end is known. These rows are the links, and the rows that
have an end of both sides close the groups. Grouping the links gives each block's distinct pairs of ids with the
number of its documents that hold them; Spark adds these up over all blocks.

Corpus-wide counts go back the same way: a block asks once for each of its distinct pairs, however many of its
documents hold it, and its documents, written beside the pairs' places in the block, add them up.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.bpe import byte_symbols
from tastegrid.llm.byte_bpe import ByteTokenizer
from tastegrid.llm.common import arrow_type, column_values, text_of
from tastegrid.sources.session import materialize, scratch_tables

# Bytes of whole texts that a task aligns together: a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
# Longer texts are cut into pieces here: the library's pattern engine has too little stack for long runs of white space.
LONGEST_DIRECT = 200_000
# A text's index in its block and a token's end in the text share a 64-bit key; so do the two ids of a pair.
END_BITS, ID_BITS = 40, 24


class ByteLevel:
    """A byte-level tokenizer file: ids of space and text, and the bytes of each id."""

    def __init__(self, spec: str, pattern: str):
        from tiktoken import Encoding

        spec = json.loads(spec)
        model, added = spec["model"], {t["content"] for t in spec["added_tokens"]}
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level tokenizer file")
        byte = {s: i for i, s in enumerate(byte_symbols())}
        labels = {i: bytes(map(byte.__getitem__, t)) for t, i in model["vocab"].items() if t not in added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"][m.replace(" ", "")] for m in merges]
        if made != sorted(made):
            raise ValueError("the ids of the file are not in the order of its merges")
        self.labels = [labels.get(i, b"") for i in range(max(model["vocab"].values()) + 1)]
        ranks = {t: i for i, t in labels.items()}
        self.library = Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = ByteTokenizer(ranks, pattern)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(f" {t}") for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if len(text) > LONGEST_DIRECT:
            return np.frombuffer(self.tokenizer.encode(text), "<i4")
        return np.array(self.library.encode_ordinary(text), np.int32)


class Pieces:
    """A piece model with byte fallback, which sets a space before each text."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = p = SentencePieceProcessor(model_proto=model)
        self.labels = [
            bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()
            for i in range(p.get_piece_size())
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _encoders(spec: str, pattern: str, model: bytes) -> tuple:
    sides = ByteLevel(spec, pattern), Pieces(model)
    numbers = pa.array([str(i) for i in range(max(len(s.labels) for s in sides))])
    return sides, [pa.array(s.labels, pa.binary()) for s in sides], numbers


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    places = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))


def _ends(tokens: pa.ListArray, labels: pa.Array, side: str) -> pa.Table:
    """(key, side): text and end of every token, by the cumulative sum of bytes since the text's first token."""
    ids, text = pc.list_flatten(tokens), pc.list_parent_indices(tokens).cast(pa.int64())
    sums = pc.cumulative_sum(pc.binary_length(pc.take(labels, ids)).cast(pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), sums])
    since = pc.take(before, tokens.offsets)
    end = pc.subtract(sums, pc.take(since, text))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(text, END_BITS), end), side: ids})


def _spelt(ids: pa.Array, closes: np.ndarray, numbers: pa.Array) -> pa.Array:
    """The ids of each group, joined by commas; ``closes`` are the numbers of tokens up to the ends of the groups."""
    groups = pa.ListArray.from_arrays(pa.array(np.append(0, closes).astype(np.int32)), pc.take(numbers, ids))
    return pc.binary_join(groups, ",")


def align_block(texts: list[str], sides: tuple, labels: list[pa.Array], numbers: pa.Array) -> tuple[dict, dict]:
    """Columns of a row per text, and the block's distinct pairs with the number of texts that hold each."""
    spaced = pa.array([f" {t}".encode() if t else b"" for t in texts], pa.binary())
    tokens = [_lists([ids if t else ids[:0] for ids, t in zip(s.encode(texts), texts)]) for s in sides]
    # A text counts only if the tokens of both sides spell it.
    same = np.ones(len(texts), bool)
    for rows, label in zip(tokens, labels):
        spelt = pc.binary_join(pa.ListArray.from_arrays(rows.offsets, pc.take(label, pc.list_flatten(rows))), b"")
        same &= pc.equal(spelt, spaced).to_numpy(zero_copy_only=False)
    if not same.all():
        tokens = [_lists([r if ok else r[:0] for r, ok in zip(_rows(t), same)]) for t in tokens]
    a, b = (_ends(t, label, side) for t, label, side in zip(tokens, labels, "ab"))
    rows = a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    text = pc.shift_right(rows["key"], END_BITS).combine_chunks()
    ends = [pc.is_valid(rows[side]).to_numpy() for side in "ab"]
    closes = ends[0] & ends[1]
    count = lambda where: np.bincount(text.filter(pa.array(where)).to_numpy(), minlength=len(texts))
    n_groups = count(closes)
    spelt = [_spelt(t[side].combine_chunks(), e.cumsum()[closes], numbers) for t, side, e in zip((a, b), "ab", ends)]
    groups = pa.ListArray.from_arrays(
        pa.array(np.append(0, n_groups.cumsum()).astype(np.int32)), pc.binary_join_element_wise(*spelt, "|")
    )
    id_a, id_b = (pc.fill_null_backward(rows[side]).cast(pa.int64()) for side in "ab")
    links = pa.table({"text": text, "pair": pc.bit_wise_or(pc.shift_left(id_a, ID_BITS), id_b)})
    held = links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    pairs = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair").combine_chunks()
    place = pc.index_in(held["pair"], value_set=pairs["pair"].combine_chunks()).combine_chunks()
    lists = pa.array(np.append(0, np.bincount(held["text"].to_numpy(), minlength=len(texts)).cumsum()).astype(np.int32))
    per_text = {
        "n_a": pc.list_value_length(tokens[0]).cast(pa.int64()),
        "n_b": pc.list_value_length(tokens[1]).cast(pa.int64()),
        "n_groups": pa.array(n_groups),
        "n_links": pa.array(np.bincount(text.to_numpy(), minlength=len(texts))),
        "groups": pc.binary_join(groups, ";"),
        "links": pa.ListArray.from_arrays(lists, place.cast(pa.int32())),
        "times": pa.ListArray.from_arrays(lists, held["count_all"].combine_chunks().cast(pa.int32())),
    }
    return per_text, {"pair": pairs["pair"].combine_chunks(), "n": pairs["count_all"].combine_chunks()}


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    return np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1])


def _blocks(
    docs: DataFrame, spec: str, pattern: str, model: bytes, id_col: str, text_col: str, digest: bool
) -> DataFrame:
    """A row per text, and a row per block (``pairs`` not null) with its distinct pairs and their numbers of texts."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, pattern, model))
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    fields = pa.schema(
        [
            ("block", pa.int64()),
            ("id", arrow_type(source, "id")),
            *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
            ("groups", pa.string()),
            ("links", pa.list_(pa.int32())),
            ("times", pa.list_(pa.int32())),
            ("pairs", pa.list_(pa.int64())),
            ("held", pa.list_(pa.int64())),
        ]
    )
    schema = (
        f"block long, id {source.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
        "groups string, links array<int>, times array<int>, pairs array<long>, held array<long>"
    )

    def batch(size: int, columns: dict) -> pa.RecordBatch:
        filled = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields]
        return pa.RecordBatch.from_arrays(filled, schema=fields)

    def aligned(block: int, keys: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        per_text, pairs = align_block(texts, *_encoders(*shared.value))
        if digest:
            groups = per_text["groups"].to_pylist()
            per_text["groups"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
        number = pa.array(np.full(len(keys), block))
        yield batch(len(keys), {"block": number, "id": pa.array(keys, fields.field("id").type), **per_text})
        whole = pa.array([0, len(pairs["pair"])], pa.int32())
        lists = {n: pa.ListArray.from_arrays(whole, pairs[k]) for n, k in (("pairs", "pair"), ("held", "n"))}
        yield batch(1, {"block": number[:1], **lists})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        keys, texts, size = [], [], 0
        for part in batches:
            for key, text in zip(column_values(part, "id"), column_values(part, "text")):
                if keys and size + len(text) > BLOCK_BYTES:
                    yield from aligned(block, keys, texts)
                    block, keys, texts, size = block + 1, [], [], 0
                keys.append(key)
                texts.append(text)
                size += len(text)
        if keys:
            yield from aligned(block, keys, texts)

    return source.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): the texts that hold a pair of ids linked; ``best`` is true if no pair of the A id has more."""
    held = blocks.where(F.col("pairs").isNotNull()).select(F.inline(F.arrays_zip("pairs", "held")))
    counts = materialize(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")), "pair-counts")
    first = F.shiftright("pair", ID_BITS).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))  # a row per A id: bounded by its vocabulary
    return counts.select("pair", "n", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    docs: DataFrame,
    byte_level_file: str,
    pattern: str,
    piece_model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """Groups and links between the tokens of a byte-level tokenizer (A) and of a piece model (B), for every whole text.

    A encodes a space and the text, B the text, before which it sets a space itself; special tokens are plain text.
    Returns the id column with n_a and n_b (tokens), n_groups (ends that both sides share), n_links (pairs of tokens
    whose bytes overlap), ``groups`` (``a1,a2|b1;a3|b2``: ids of each group; with ``digest`` its SHA-256 in hex, which
    keeps the tables small), n_best (links whose pair of ids is held by as many texts as any pair of its A id) and count_sum
    (the texts that hold a link's pair, summed over the links). Every row counts as a text, repeated rows included.
    A null or empty text, or one whose tokens don't spell space and text on both sides (such as one with U+2581), has no
    tokens: zeros and the empty string. A null id stays null; other columns are not read, whatever their names.

    The driver reads the files and broadcasts them: their size is that of the vocabularies. A task holds about
    ``BLOCK_BYTES`` of texts, or one longer text, with some tables of numbers per token.
    """
    with open(byte_level_file, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    with scratch_tables(docs.sparkSession):
        blocks = materialize(_blocks(docs, spec, pattern, model, id_col, text_col, digest), "aligned")
        asked = blocks.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("place", "pair"))
        known = asked.join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "place", "n", "best")
        rows = blocks.where(F.col("pairs").isNull()).drop("pairs", "held")
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
        schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString() if n in rows.columns else 'long'}" for n in names)

        def add_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
            texts, pairs = texts.combine_chunks(), pairs.sort_by("place")
            lists = pa.array(texts["links"].combine_chunks())
            places = pc.list_flatten(lists)
            times = pc.list_flatten(texts["times"]).to_numpy()
            bounds = np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False).cumsum())
            for name, value in (("n_best", pairs["best"].cast(pa.int64())), ("count_sum", pairs["n"])):
                total = np.append(0, (pc.take(value, places).to_numpy() * times).cumsum())
                texts = texts.append_column(name, pa.array(total[bounds[1:]] - total[bounds[:-1]]))
            return texts.select(names)

        done = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add_up, schema)
        return materialize(done, "alignment", keep=True).withColumnRenamed("id", id_col)
