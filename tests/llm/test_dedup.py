import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import chunks, components, lines, simhash, suffixes


def by_id(df, *columns):
    rows = df.collect()
    out = {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
    assert len(out) == len(rows)
    return out


# ---------------------------------------------------------------- exact


def test_exact_against_brute_force(make, corpus):
    found = chunks.exact_duplicates(make(corpus))
    assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == brute.exact(corpus)


def test_chunks_that_share_a_hash_are_told_apart(make, corpus):
    found = chunks.exact_duplicates(make(corpus), identify=lambda c: F.length(c).cast("long"))
    assert by_id(found, "keep_id", "group_size", "kept", "text_sha256") == brute.exact(corpus)


def test_chunks_cover_long_texts(spark):
    texts = ["", "a", "x" * 20_000, "word, " * 3000, "é. " * 5000, "no end " * 4000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, parts in df.select("t", chunks.chunks_of(F.col("t"))).collect():
        assert "".join(parts) == text
        assert all(len(p) <= chunks.LONGEST for p in parts)


def test_exact_odd_rows(make, odd):
    rows = chunks.exact_duplicates(make(odd)).collect()
    assert len(rows) == 7  # repeated rows are one document, and null is the empty text
    assert sorted((r.keep_id, r.group_size) for r in rows if r.doc_id is None) == [(5, 2)]
    assert [r.kept for r in rows if r.doc_id == 5] == [True, True]  # two texts, two groups
    empty = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows if r.text_sha256 == brute.sha(""))
    assert empty == [(2, 2, 2, True), (3, 2, 2, False)]


def test_drop_duplicates_keeps_all_columns(make, odd, corpus):
    df = make(odd)
    left = chunks.drop_duplicates(df)
    assert left.columns == df.columns
    stays = [(5, odd[0][1]), (5, "other"), (2, ""), (9, "a b"), (1, odd[-1][1])]
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted(stays)
    want = sorted(d for d, (_, _, kept, _) in brute.exact(corpus).items() if kept)
    assert sorted(r.doc_id for r in chunks.drop_duplicates(make(corpus)).select("doc_id").collect()) == want


def test_exact_of_nothing(make):
    assert chunks.exact_duplicates(make([])).collect() == []
    assert chunks.drop_duplicates(make([])).collect() == []


# ---------------------------------------------------------------- SimHash


def near_copies(seed=5, n=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(200)] for _ in range(n)]
    rows = []
    for words in base:
        rows.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            words = list(words)
            words[rng.randrange(len(words))] = "edited"
            rows.append(" ".join(words))
    rows += [None, "", " ", "Two words", "two WORDS", "one", "a b c", "ÀB c d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_simhash_against_brute_force(make):
    rows = near_copies()
    want = brute.near(rows)
    assert len({c for _, c in want.values()}) < len(want) - 10
    assert by_id(simhash.near_duplicates(make(rows)), "fingerprint", "component_id") == want


def test_small_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 3)
    rng = random.Random(1)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centre for _ in range(60)} | {0, 2**64 - 1}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    for radius in (0, 1, 2, 3):
        found = [tuple(r) for r in simhash.links(df, radius).collect()]
        pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
        assert brute.components(found, signed) == brute.components(pairs, signed)


def test_many_hashes_per_fingerprint():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 255, 256, 1000, 0, 3])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    at, want = 0, []
    for n in sizes:
        part = [int(h) for h in hashes[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n))
        at += n
    assert simhash.majority(hashes, sizes).tolist() == want


def test_simhash_odd_rows(make, odd):
    rows = simhash.near_duplicates(make(odd)).collect()
    assert len(rows) == len(odd)
    fps = {t: brute.fingerprint(t) for _, t in odd}
    same = {t: min(d for d, u in odd if d is not None and (fps[t] ^ fps[u]).bit_count() <= 2) for _, t in odd}
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in rows))) == sorted(map(str, ((d, same[t]) for d, t in odd)))
    left = simhash.keep_one(make(odd))
    assert left.columns == make(odd).columns
    texts = sorted({t or "" for _, t in odd})
    pairs = [(a, b) for a in texts for b in texts if a < b and (brute.fingerprint(a) ^ brute.fingerprint(b)).bit_count() <= 2]
    group = brute.components(pairs, texts)
    stays = {}
    for d, t in odd:
        if d is not None:
            stays[group[t or ""]] = min(d, stays.get(group[t or ""], d))
    assert sorted((group[r.text or ""], r.doc_id) for r in left.collect()) == sorted(stays.items())


def test_simhash_of_nothing(make):
    assert simhash.near_duplicates(make([])).collect() == []
    assert simhash.keep_one(make([])).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(50)] + [(1, 1)]
    pairs += [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long")
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    want = brute.components([p for p in pairs if p[0] != p[1]], nodes)
    found = components.connected(df, "a", "b").collect()
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    a, b = components.forest(*map(np.array, zip(*pairs)))
    assert brute.components(list(zip(a.tolist(), b.tolist())), nodes) == want and len(a) <= len(nodes)


# ---------------------------------------------------------------- lines


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_runs_against_brute_force(make, corpus, k):
    rng = random.Random(k)
    rows = corpus + [(1000 + i, "\n".join(rng.choice("abc \n") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    found = by_id(lines.remove_repeated_lines(make(rows), min_lines=k), "n_lines", "n_removed", "n_runs", "longest_run", "text")
    assert found == brute.line_runs(rows, k)


def test_line_runs_odd_rows(make, odd):
    block = "l1\nl2\nl3"
    rows = odd + [(None, block), (None, block), (20, block), (20, block), (10, "x\n" + block)]
    got = lines.remove_repeated_lines(make(rows)).collect()
    assert len(got) == len(rows)
    long = odd[0][1]  # one line of eighty words
    assert {(r.doc_id, r.text) for r in got if r.n_removed} == {(None, ""), (20, ""), (5, ""), (1, long)}
    assert lines.remove_repeated_lines(make([])).collect() == []
    with pytest.raises(ValueError):
        lines.remove_repeated_lines(make(odd), min_lines=0)


@pytest.mark.parametrize("words", [1, 4, 7])
def test_runs_count_by_words(make, words):
    rng = random.Random(words)
    rows = [(i, "\n".join(rng.choice(["a b c", "d", "e f g h", "i j", " ", "k"]) for _ in range(rng.randint(0, 25)))) for i in range(30)]
    cleaned = lines.remove_repeated_lines(make(rows), min_lines=5, min_words=words)
    assert by_id(cleaned, "n_lines", "n_removed", "n_runs", "longest_run", "text") == brute.line_runs(rows, 5, words)


def test_ids_that_stand_for_several_lines(make, corpus, monkeypatch):
    """Hashes of the length only: contents take part in the ids then."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lines, "_hashes", lambda line: [F.length(line).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")])
    rows = corpus + [(1000, "one\ntwo\nsix"), (1001, "one\ntwo\nsix\nten"), (1002, "two\none\nsix")]
    found = by_id(lines.remove_repeated_lines(make(rows)), "n_lines", "n_removed", "n_runs", "longest_run", "text")
    assert found == brute.line_runs(rows)


def test_intervals_have_a_common_prefix(spark, make):
    rows = [(1, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj"), (2, "x\nb\nc\nd\ne\nf\ng\nh\ny"), (3, "b\nc\nd\nz\na\nb")]
    levels = lines.doubled_ranks(make(rows), "doc_id", "text")
    found = {(r.id, r.at): (r.length, r.run) for r in lines.longest_prefixes(levels).collect()}
    assert {k: v[0] for k, v in found.items()} == {
        (1, 0): 2, (3, 4): 2, (1, 1): 7, (2, 1): 7, (1, 2): 6, (2, 2): 6, (1, 3): 5, (2, 3): 5, (1, 4): 4, (2, 4): 4, (1, 5): 3,
        (2, 5): 3, (1, 6): 2, (2, 6): 2, (1, 7): 1, (2, 7): 1, (3, 0): 3, (3, 1): 2, (3, 2): 1, (3, 5): 1,
    }
    assert found[1, 1][1] == found[2, 1][1] != found[3, 0][1]


# ---------------------------------------------------------------- suffixes


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", 2)
    monkeypatch.setattr(suffixes, "SORT_AT_ONCE", 100)


def test_repeats_against_brute_force(make, corpus):
    got = suffixes.remove_repeats(make(corpus).repartition(5))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(corpus)
    want = {d: t for d, t in corpus}
    for r in got.collect():
        text = (want[r.doc_id] or "").encode()
        edges = [0, *r.spans, len(text)]
        assert brute.sha(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))) == r.kept_sha256


def periodic_rows(seed):
    rng = random.Random(seed)
    parts = ["ab" * 40, " " * 70, "x" * 55, "".join(rng.choice("ab") for _ in range(60)), "".join(rng.choice("abcdefgh ") for _ in range(80))]
    return [(i, "".join(rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 6)))) for i in range(60)]


def test_repeats_of_periodic_texts(make):
    rows = periodic_rows(6)
    got = suffixes.remove_repeats(make(rows).repartition(4))
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_steps_with_small_blocks(small_blocks, monkeypatch):
    """The steps one after the other without Spark, with blocks of one text and collapsed anchors."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 300)
    rows = periodic_rows(8)
    n = np.arange(3)

    def dealt(*streams):
        blocks = [r for s in streams for b in s for r in b.to_pylist()]
        blocks.sort(key=lambda r: r["bucket"])
        return [pa.RecordBatch.from_pylist(blocks, schema=pa.schema(suffixes._FIELDS))] if blocks else []

    def source():
        for d, t in rows:
            yield pa.RecordBatch.from_pydict({"id": [d], "text": [t.encode()]})

    answers = dealt(suffixes._share_anchors(iter(dealt(suffixes._find_anchors(source(), n))), n))
    texts = dealt(suffixes._send_texts(source(), n))
    spans = suffixes._sort_contexts(iter(dealt(suffixes._cut_contexts(iter(dealt(texts, answers)), n))), n)
    found = {r["sha"]: r for b in suffixes._remove(iter(dealt(texts, spans))) for r in b.to_pylist()}
    want, seen = brute.repeats(rows), set()
    for d, t in rows:
        if t not in seen and want[d][1]:
            assert (found[brute.sha(t)]["n_removed"], found[brute.sha(t)]["kept_sha"]) == (want[d][1], want[d][3])
        seen.add(t)


def test_suffixes_sort_and_survive_collisions(monkeypatch):
    rng = random.Random(9)
    contexts = ["".join(rng.choice("ab") for _ in range(4)).encode() * 16 for _ in range(30)]
    owner = np.repeat(np.arange(30), 14)
    offset = np.tile(np.arange(14), 30)
    windows = [contexts[o][i : i + 50] for o, i in zip(owner, offset)]
    s = suffixes.Suffixes(contexts, owner, offset)
    order = s.merge_sorted(np.zeros(len(owner), np.int64))
    assert [windows[i] for i in order] == sorted(windows)

    def same_classes(numbers):
        assert len(set(zip(numbers.tolist(), windows))) == len(set(windows)) == len(set(numbers.tolist()))

    same_classes(s.intervals(np.zeros(len(owner), np.int64)))
    monkeypatch.setattr(s, "_hash", lambda i, skip, length: np.zeros(len(i), np.uint64))  # every hash collides
    same_classes(s.intervals(np.zeros(len(owner), np.int64)))


def test_repeats_odd_rows(make, odd):
    rows = suffixes.remove_repeats(make(odd)).collect()
    assert len(rows) == 7
    gone = {(r.doc_id, r.n_removed) for r in rows if r.n_removed}
    size = len(odd[0][1])
    assert gone == {(5, size), (None, size)}  # document 1 has it all
    assert suffixes.remove_repeats(make([])).collect() == []
