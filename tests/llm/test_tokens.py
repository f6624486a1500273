"""Periodic runs, byte-level tokens and alignment against brute force and the libraries."""

import os
import random

import brute
import numpy as np
import pytest

from tastegrid.llm import alignment, byte_bpe, periods, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
STRANGE = [
    "Hello <|endoftext|>WORLD <s> </s><unk>", "don't we'LL I'D", "naïve ΑΣ ½ 1234", "é ﬁ \x1c\x85 a  \n\n b",
    "日本語 テキスト", "🙂🙂", "▁ a", "▁", " lead", "tail ", "  ", "\n", "\x00 zero", "a" * 3000, " " * 500 + "x", "é" * 200,
]


def table(df, rows):
    return sorted(map(tuple, df.collect()), key=repr), sorted(rows, key=repr)


# ---------------------------------------------------------------- periodic runs


def words_of(rng):
    n, kind = rng.randint(0, 90), rng.randrange(5)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:  # squares of words that are periodic themselves
        u, out = [rng.randint(0, 2) for _ in range(rng.randint(1, 4))], []
        while len(out) < n:
            out += (u * rng.randint(1, 6) + u[: rng.randint(0, len(u))]) * rng.randint(1, 3)
        return out
    if kind == 2:  # Fibonacci words
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:  # one period with changed words
        u = [rng.randint(0, 1) for _ in range(rng.randint(1, 20))]
        out = [u[i % len(u)] for i in range(n)]
        for _ in range(rng.randint(0, 2) if out else 0):
            out[rng.randrange(len(out))] = rng.randint(0, 2)
        return out
    u = [0] * rng.randint(0, 9) + [1]
    return (u * 20)[rng.randint(0, 5) : rng.randint(5, 150)] + [0] * rng.randint(0, 30) + u * 9


@pytest.mark.parametrize("lengths", [[12], [2, 3, 4, 5, 8, 11, 23, 24, 40]])
def test_runs_of_random_words(lengths, monkeypatch):
    rng = random.Random(len(lengths))
    for turn in range(1500):
        monkeypatch.setattr(periods, "PAIRS_AT_ONCE", rng.choice([1, 50, 1 << 22]))
        texts, least = [words_of(rng) for _ in range(rng.randint(1, 4))], rng.choice(lengths)
        line = np.array([w for t in texts for w in t], np.int64)
        got = periods.find_runs(line, np.array([len(t) for t in texts]), least)
        want = [(i, *r) for i, t in enumerate(texts) for r in brute.word_runs(t, least)]
        assert [tuple(r) for r in got.tolist()] == want, (turn, least, texts)


def test_long_periodic_texts():
    """Work that grows with the words: a million equal words, and blocks of them."""
    found = periods.find_runs(np.zeros(1_000_000, np.int64), np.array([1_000_000]))
    assert found.tolist() == [[0, 0, 1_000_000, 1]]
    blocks = np.array(([0] * 100 + [1]) * 300)
    found = periods.find_runs(blocks, np.array([len(blocks)]))
    assert [r[1:] for r in found.tolist() if r[3] == 101] == [[0, len(blocks), 101]] and len(found) == 301


def test_least_length():
    with pytest.raises(ValueError):
        periods.lowest_level(1)


def test_runs_of_documents(spark, make, corpus, odd, monkeypatch):
    """Whole texts over several portions; words are split at the white space of the contract only."""
    monkeypatch.setattr(periods, "WORDS_AT_ONCE", 500)
    rng = random.Random(8)
    repeats = [(1000 + i, "\x0b".join(rng.choice(["x ", "y", "z"]) for _ in range(i)) + "\n a\x1cb " * 20) for i in range(40)]
    rows = corpus + odd + repeats + [(2000, "very long text of five words " * 30_000)]
    got = periods.periodic_runs(make(rows))
    want = []
    for d, t in rows:
        w = [x for x in brute.re.findall(brute.WORD, t or "")]
        runs = brute.word_runs(w) if d != 2000 else [(0, 180_000, 6)]
        want.append((d, len(w), [tuple(r) for r in runs], brute.collapsed(w, runs)))
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(make([])).collect() == []


def test_period_query(spark, make, corpus, odd):
    rows = corpus + odd + [(3000 + i, " ".join(f"w{k % (20 + i)}" for k in range(15 * i))) for i in range(60)]
    want = []
    for d, t in rows:
        w = brute.planted(d, t)
        runs = brute.word_runs(w)
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), s, n, q, n and 1000 * n // q, brute.sha(lines), brute.sha(brute.collapsed(w, runs))))
    got = periods.digests(periods.periodic_runs(queries.with_planted_runs(make(rows))))
    have, want = table(got, want)
    assert have == want and sum(r[1] > 0 for r in have) > 30


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken():
    import tiktoken

    ranks = byte_bpe.read_ranks(open(RANK_FILE, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_tokens_equal_the_library(make, corpus, odd, tiktoken, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_BYTES", 2000)
    rows = corpus + odd + [(500 + i, t) for i, t in enumerate(STRANGE)]
    got = byte_bpe.encode_decode(make(rows), RANK_FILE, public_tokenizers.PATTERN)
    want = []
    for d, t in rows:
        ids = tiktoken.encode_ordinary(t or "")
        want.append((d, len(ids), ids, tiktoken.decode_bytes(ids)))
    have = [(r.doc_id, r.n_tokens, list(r.ids), bytes(r.decoded)) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    digests = {(d, brute.sha(" ".join(map(str, ids))), brute.sha(b)) for d, _, ids, b in want}
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(got).collect()} == digests
    assert byte_bpe.encode_decode(make([]), RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_every_letter_and_random_texts(tiktoken):
    tokenizer = byte_bpe.ByteTokenizer(tiktoken._mergeable_ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    parts = ["a", "aa", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "½", "\x1c", "\x85", "\xa0", "日", "ﬁ", "🙂", "́", "-", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    letters = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a {chr(c)} {chr(c)}1{chr(c)}\n{chr(c)}" for c in letters[i : i + 64]) for i in range(0, len(letters), 64)]
    for t in texts:
        assert np.frombuffer(tokenizer.encode(t), "<u4").tolist() == tiktoken.encode_ordinary(t), t


def test_tree_of_random_ranks():
    """Merges by the leftmost smallest rank, as a plain scan finds it; the last leaf and runs of one letter too."""
    for seed in range(40):
        rng = random.Random(seed)
        tokens = [bytes([c]) for c in b"abc"]
        for _ in range(20):
            t = rng.choice(tokens) + rng.choice(tokens)
            if t not in tokens:
                tokens.append(t)
        ranks = {t: i for i, t in enumerate(tokens)}
        tokenizer = byte_bpe.ByteTokenizer(ranks, r"\S+|\s+")
        for _ in range(100):
            piece = bytes(rng.choice(b"aab" if seed % 2 else b"abc") for _ in range(rng.randint(1, 40)))
            parts = [piece] if piece in ranks else [piece[i : i + 1] for i in range(len(piece))]
            while True:
                best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert tokenizer.merge(piece) == [ranks[p] for p in parts], (seed, piece)


def test_piece_memory_is_bounded(tiktoken, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_MEMORY", 5)
    tokenizer = byte_bpe.ByteTokenizer(tiktoken._mergeable_ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} thing{i} a" for i in range(50)) + " " + "long" * 40
    for _ in range(2):
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tiktoken.encode_ordinary(text)
    assert len(tokenizer) <= 5 and len(tokenizer.old) <= 5


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=FILES[2])
    from tastegrid.llm.bpe import byte_symbols

    byte = {s: i for i, s in enumerate(byte_symbols())}
    spell_a = lambda i: bytes(byte[c] for c in a.id_to_token(i))

    def spell_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda t: a.encode(t, add_special_tokens=False).ids, b.encode, spell_a, spell_b


def test_alignment(make, corpus, odd, sides, monkeypatch):
    """Several small blocks; the counts of all of them meet."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1500)
    rows = corpus + odd + [(500 + i, t) for i, t in enumerate(STRANGE)]
    want = [(d, *r) for (d, _), r in zip(rows, brute.alignments([t or "" for _, t in rows], *sides))]
    have, want = table(alignment.align(make(rows).repartition(3), *FILES), want)
    assert have == want
    assert sum(r[1] == 0 for r in have) > sum(not t for _, t in rows)  # texts that the tokens do not spell


def test_long_texts_are_cut_here(corpus, sides, monkeypatch):
    side = alignment.ByteLevel(open(FILES[0], encoding="utf-8").read(), FILES[1])
    texts = [t for _, t in corpus if t] + STRANGE
    for limit in (alignment.LONGEST_DIRECT, 100, 0):
        monkeypatch.setattr(alignment, "LONGEST_DIRECT", limit)
        assert [x.tolist() for x in side.encode(texts)] == [sides[0](" " + t) for t in texts]


def test_alignment_digest_and_empty_tables(make, sides):
    rows = [(1, "one two  three"), (None, None), (2, "▁"), (2, "▁")]
    want = brute.alignments([t or "" for _, t in rows], *sides)
    got = alignment.align(make(rows), *FILES, digest=True).collect()
    assert sorted(r.groups for r in got) == sorted(brute.sha(w[4]) if w[4] else "" for w in want)
    assert alignment.align(make([]), *FILES).collect() == []
    only_empty = alignment.align(make([(1, ""), (2, None)]), *FILES).collect()
    assert sorted(tuple(r)[1:] for r in only_empty) == [(0, 0, 0, 0, "", 0, 0)] * 2


SMALL = os.environ.get("TASTEGRID_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small test tables")
def test_token_queries(spark, tiktoken, sides):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = set()
    for d, t in docs:
        ids = tiktoken.encode_ordinary(t)
        want.add((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t)))
    assert {tuple(r) for r in queries.op12_byte_bpe(spark, SMALL).collect()} == want
    aligned = brute.alignments([t for _, t in docs], *sides)
    want = {(d, *a[:4], *a[5:], brute.sha(a[4]) if a[4] else "") for (d, _), a in zip(docs, aligned)}
    assert {tuple(r) for r in queries.op13_token_alignment(spark, SMALL).collect()} == want
