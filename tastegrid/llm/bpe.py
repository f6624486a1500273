"""Byte-pair encoding by a tokenization automaton, and decoding.

The merges are compiled, in their order, into a deterministic automaton whose arcs are tokens and whose
accepted paths are exactly the token sequences that the merges produce. It starts as one state with a
loop per base symbol. The gadget of the merge (u, v) takes the state reached by u, gives u a copy of it
without the arc v, and adds an arc uv, to the state that v reaches, wherever u may start. Hence all arcs
of a token reach one state, and a copied state differs from its origin by the arcs cut later: states are
held as those differences. An arc is looked up through them once and then kept in a transition table.

Encoding walks the table over a pre-split word from left to right. At most one state is alive at each
place, because a word's prefix has one tokenization. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import arrow_type, column_values, emit, text_of

# Words kept with their codes by a Python worker; beyond that the memory starts anew.
WORD_MEMORY = 300_000
# Longer words are encoded without being remembered.
LONGEST_KEPT = 48
# Arcs kept in a worker's transition table before it starts anew.
ARC_MEMORY = 4_000_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies (fixed rule: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Automaton:
    """States, arcs and labels compiled from ``vocab`` (label to id) and ``merges`` (pairs in order).

    ``suffix`` ends the last symbol of a word (for instance ``</w>``; may be empty).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.labels: dict[int, str] = {i: t for t, i in vocab.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self._arcs: dict[tuple[int, int], bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self._arcs.clear()
        self._root = self._trie()

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        """Give u a copy of its state without the arc v, and add the arc uv beside every arc u."""
        if (u, v) in self.cut:
            return  # an earlier merge of the pair already cut the arc
        if uv in self.born:
            raise ValueError(f"two merges make the token {self.labels[uv]!r}")
        if not self._open(u, v):
            self.born[uv] = -1  # v can never follow u here, so no path makes uv
            return
        self.cut[u, v] = rank
        self.left[uv], self.right[uv], self.born[uv] = u, v, rank

    def _open(self, a: int, b: int) -> bool:
        """Whether the state that ``a`` reaches has an arc ``b``.

        ``a``'s state has the cuts of its right part up to ``a``'s own gadget, and so on; the arc ``b``
        stands beside its left part's arc, if that was still there at ``b``'s gadget. In a merge of equal
        parts the cut comes before the new arc: runs pair up from the left.
        """
        cut, left, right, born = self.cut, self.left, self.right, self.born
        if born.get(a) == -1 or born.get(b) == -1:
            return False
        y, until = a, 1 << 60
        while True:
            x, before = b, 1 << 60
            while True:
                rank = cut.get((y, x))
                if rank is not None and rank < until and rank <= before:
                    return False
                if x not in left:
                    break
                x, before = left[x], born[x]
            if y not in right:
                return True
            y, until = right[y], born[y]

    def _trie(self) -> list:
        """Nodes ``[children, token, token at a word's end]`` over the symbols of all usable labels."""
        root: list = [{}, -1, -1]
        for token, label in self.labels.items():
            if self.born.get(token) == -1:
                continue
            ends = bool(self.suffix) and label.endswith(self.suffix) and len(label) > len(self.suffix)
            node = root
            for symbol in label[: -len(self.suffix)] if ends else label:
                node = node[0].setdefault(symbol, [{}, -1, -1])
            if ends or not self.suffix:
                node[2] = token
            if not ends:
                node[1] = token
        return root

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word, given in the vocabulary's symbols."""
        n = len(word)
        state: list[int] = [-1] * (n + 1)  # the token that ends at a place: it names the state
        start: list[int] = [-1] * (n + 1)
        start[0] = 0
        arcs, root, is_open = self._arcs, self._root, self._open
        for i in range(n):
            if start[i] < 0:
                continue
            here, node = state[i], root
            for j in range(i, n):
                node = node[0].get(word[j])
                if node is None:
                    break
                token = node[2] if j == n - 1 else node[1]
                if token < 0:
                    continue
                if i:
                    ok = arcs.get((here, token))
                    if ok is None:
                        if len(arcs) >= ARC_MEMORY:
                            arcs.clear()
                        ok = arcs[here, token] = is_open(here, token)
                    if not ok:
                        continue
                elif self.born.get(token) == -1:
                    continue
                state[j + 1], start[j + 1] = token, i
        if n and start[n] < 0:
            raise ValueError(f"the vocabulary lacks symbols of {word[:40]!r}")
        out = []
        while n > 0:
            out.append(state[n])
            n = start[n]
        return out[::-1]

    def decode(self, ids) -> list[str]:
        return [self.labels[i] for i in ids]


# Rules of the word tokenizer's file, as it states them: text normalisation and the split into words.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """A tokenizer file with NFC, white-space and lower-case normalisation, a split into words, byte
    symbols and merges with word ends; special tokens are found in the raw text."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        known = steps == ["NFC", "Replace", "Lowercase"] and splits[0]["pattern"]["Regex"] == SPLIT
        if not known or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("the tokenizer file has rules that are not known here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels.update({i: t for t, i in self.special.items()})
        strings = sorted(self.special, key=len, reverse=True)
        self.mark = os.path.commonprefix(strings)  # texts without it have no special token
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        # white space is already one kind of space, so the class of the file needs no \s here
        self.words = regex.compile(SPLIT.replace(r"\s", " ")).findall
        self.symbols = byte_symbols()
        self.memory: dict[str, tuple[bytes, str]] = {}

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = SPACE.sub(" ", text).replace("Σ", "σ")  # no final form of sigma
        elif not text.isprintable():
            text = SPACE.sub(" ", text)
        return text.lower()

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids of a word as little-endian 32-bit integers, and its labels joined by spaces."""
        known = self.memory.get(word)
        if known is None:
            symbols = self.symbols
            ids = self.automaton.encode("".join([symbols[b] for b in word.encode()]))
            known = np.array(ids, "<u4").tobytes(), " ".join(self.automaton.decode(ids))
            if len(word) <= LONGEST_KEPT:
                if len(self.memory) >= WORD_MEMORY:
                    self.memory.clear()
                self.memory[word] = known
        return known

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of a whole text."""
        ids: list[bytes] = []
        labels: list[str] = []
        parts = self.special_pattern.split(text) if self.special_pattern and self.mark in text else [text]
        get, slow = self.memory.get, self.word
        for part in parts:
            if part in self.special:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                labels.append(part)
                continue
            for w in self.words(self.normalise(part)):
                code, label = get(w) or slow(w)
                ids.append(code)
                labels.append(label)
        return b"".join(ids), " ".join(labels)


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> WordTokenizer:
    return WordTokenizer(spec)


def encode_decode(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns the id column with ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit integers)
    and ``decoded`` string (labels joined by spaces: the file has no decoder rules). One row per row of
    ``docs``, repeated rows included; a null or empty text has no tokens and decodes to the empty text; a
    null id stays null; other columns are not read, whatever their names. Letters that are newer than the
    Unicode tables of this Python may be split or lower-cased in another way than newer libraries do. The driver reads the file and
    broadcasts it: its size is that of the vocabulary. A worker compiles it once and remembers at most
    ``WORD_MEMORY`` words, which changes no result.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)

        def rows():
            for batch in batches:
                for key, text in zip(column_values(batch, "id"), column_values(batch, "text")):
                    ids, decoded = tokenizer.encode(text)
                    yield key, len(ids) // 4, ids, decoded

        return emit(rows(), fields, lambda r: len(r[2]) + len(r[3]))

    fields = pa.schema(
        [
            ("id", arrow_type(source, "id")),
            ("n_tokens", pa.int64()),
            ("ids", pa.binary()),
            ("decoded", pa.string()),
        ]
    )
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The encoded rows with SHA-256 digests in the place of ids and decoded text."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
