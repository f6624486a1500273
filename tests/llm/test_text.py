import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import bpe, cotraining, licenses, mixing, quality, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(make, corpus, odd, library):
    extra = ["Hello <|endoftext|>WORLD<|startoftext|>", "don't we'LL I'D", "naïve ΑΣ ½ 1234", "e\u0301 ﬁ \x1c\x85 a", "日本語 テキスト", "🙂🙂", "<|"]
    rows = corpus + odd + [(500 + i, t) for i, t in enumerate(extra)]
    got = bpe.encode_decode(make(rows), WORD_FILE).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def plain_bpe(word, merges, suffix):
    parts = [*word[:-1], word[-1] + suffix]
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    while True:
        best = min((rank[p] for p in zip(parts, parts[1:]) if p in rank), default=None)
        if best is None:
            return parts
        a, b = merges[best]
        out, i = [], 0
        while i < len(parts):
            pair = parts[i : i + 2] == [a, b]
            out.append(a + b if pair else parts[i])
            i += 2 if pair else 1
        parts = out


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_automaton_of_random_merges(suffix):
    """Also merges of equal parts, merges that can never happen, and long runs of one letter."""
    for seed in range(25):
        rng = random.Random(seed)
        tokens = ["a", "b", "c"] + ([x + suffix for x in "abc"] if suffix else [])
        merges = []
        for _ in range(25):
            u = rng.choice([t for t in tokens if not suffix or not t.endswith(suffix)])
            v = rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        machine = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges, suffix)
        for _ in range(200):
            word = "".join(rng.choice("aab" if seed % 2 else "abc") for _ in range(rng.randint(1, 14)))
            assert machine.decode(machine.encode(word)) == plain_bpe(word, merges, suffix), (seed, word)


def test_worker_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORD_MEMORY", 5)
    monkeypatch.setattr(bpe, "ARC_MEMORY", 5)
    t = bpe.WordTokenizer(open(WORD_FILE, encoding="utf-8").read())
    text = " ".join(f"word{i} thing{i} a" for i in range(50)) + " " + "long" * 40
    assert np.frombuffer(t.encode(text)[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(t.memory) <= 5


def test_digests(make):
    row = bpe.digests(bpe.encode_decode(make([(1, None)]), WORD_FILE)).first()
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (0, brute.sha(b""), brute.sha(""))
    assert bpe.encode_decode(make([]), WORD_FILE).collect() == []


# ---------------------------------------------------------------- quality rules


def test_counts_against_brute_force(make, corpus, odd):
    rows = corpus + odd + [(700, "a b c a b c\n\n \na b c a b c\r\nx"), (701, "\v".join("abcabc" * 20)), (702, "p q r " * 200)]
    got = quality.quality_rules(make(rows)).collect()
    assert len(got) == len(rows)
    found = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == sorted(brute.counts(t) for _, t in rows)
    assert not any(r.kept for r in got if r.base_failed)


def test_limits_follow_the_group(spark):
    """A hundred symbols are usual in one source and not in the other; null sources are a group."""
    rng = random.Random(1)
    words = lambda n, by: by.join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, words(rng.randint(80, 120), " | "), "en", "tables") for i in range(150)]
    rows += [(1000 + i, words(100, " "), "en", None) for i in range(150)]
    rows += [(2000, words(100, " | "), "en", None), (2001, words(100, " | "), "en", "tables")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    assert not kept.pop(2000) and all(kept.values())
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == sorted(kept)
    assert quality.keep_good(df).columns == df.columns


def test_small_groups_use_the_merged_sketch(make, corpus):
    rows = quality.measured(make(corpus), "doc_id", "text", ("lang", "source"))
    limits = quality.limits(rows).collect()
    assert len(limits) == len({(r.g0, r.g1) for r in limits})
    values = sorted(r.upper_rate for r in rows.collect())
    assert len({r.upper_rate_limit for r in limits}) == 1  # fewer than FEWEST_ROWS in each language
    assert limits[0].upper_rate_limit >= values[3 * len(values) // 4 - 1]


def brute_kept(rows):
    """doc_id -> kept, from exact quantiles; rows are (id, text, lang, source)."""

    def pairs(text):
        n_words, chars, symbols, dups, repeated, _ = brute.counts(text)
        n_lines = sum(1 for x in text.split("\n") if x.strip(" \t\n\v\f\r"))
        upper = sum("A" <= c <= "Z" for c in text)
        return [(symbols, chars), (dups, n_lines + 3), (repeated, n_words + 50), (upper, chars), (chars, n_words)]

    found = {d: pairs(t) for d, t, _, _ in rows}

    def limit(ids, k):
        values = sorted(found[d][k][0] / found[d][k][1] for d in ids)
        middle, upper = (values[-(-len(values) * q // 100) - 1] for q in (50, 85))
        return upper + 3 * (upper - middle) + 0.005

    kept = {}
    for d, t, lang, source in rows:
        levels = [[r[0] for r in rows], [r[0] for r in rows if r[2] == lang], [r[0] for r in rows if r[2:] == (lang, source)]]
        kept[d] = not brute.counts(t)[5]
        for k, (n, size) in enumerate(found[d]):
            at = 0
            for ids in levels:
                share = 1 if ids is levels[0] else min(1, max(0, (len(ids) - 100) / 50))
                at = share * limit(ids, k) + (1 - share) * at
            kept[d] &= (n if k == 4 else n - 2 * n**0.5) / size <= at
    return kept


def test_kept_against_brute_force(spark):
    """Every measure rejects an outlier of its own source, far below a fixed cutoff; few symbols reject nothing."""
    rng = random.Random(4)

    def text(n=120, symbols=0, upper=0.02, again=0, dups=0, size=6):
        words = [f"w{rng.randrange(10 ** (size - 1), 10**size)}" for _ in range(n)]
        words = [w.upper() if rng.random() < upper * (size + 1) else w for w in words] + words[: again * 6]
        return " ".join(words + ["#"] * symbols) + "\nx y" * (dups + 1 if dups else 0)

    rows = [(i, text(rng.randint(90, 150)), "en", "a") for i in range(200)]
    rows += [(1000 + i, text(again=rng.randint(0, 2)), "en", "b") for i in range(120)]
    rows += [(2000 + i, text(size=rng.choice([3, 4])), "de", rng.choice("abc")) for i in range(90)]
    odd = {"symbols": 25, "upper": 0.15, "again": 5, "dups": 30, "size": 9}
    rows += [(3000 + i, text(**{k: v}), "en", "a") for i, (k, v) in enumerate(odd.items())]
    rows += [(4000, text(symbols=2), "en", "a"), (4001, text(dups=1), "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    assert kept == brute_kept(rows)
    assert not any(kept[3000 + i] for i in range(len(odd))) and kept[4000] and kept[4001]


def test_quality_of_nothing(make):
    assert quality.quality_rules(make([])).collect() == []
    assert quality.keep_good(make([])).collect() == []


# ---------------------------------------------------------------- mixing


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "t" * 9, "big" if i % 10 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, smoothing=0.0, epochs=2.0, seed=5)
    sums = {r["source"]: r.n for r in mixed.groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert abs(sums[None] - 4000) < 300 and abs(sums["big"] - 4000) < 300
    assert mixed.collect() == mixing.mix(df, smoothing=0.0, epochs=2.0, seed=5).collect()
    by_doc = mixed.groupBy("row.doc_id", "copies").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()
    assert all(r.n == r.copies == r.top for r in by_doc)
    weighted = mixing.mix(df, weights={"big": 1.0}, epochs=0.5)
    assert weighted.where("row.source is null").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"big": 0.0})


@pytest.mark.parametrize("rate", [0.3, 5.0, 100.0])
def test_counts_invert_the_poisson_distribution(spark, rate):
    rates = spark.createDataFrame([("s", rate)], "source string, rate double")
    draws = spark.range(4000).crossJoin(mixing.tables(rates)).select(mixing.copies(3, F.col("id").cast("string")).alias("n"))
    got = np.array([r.n for r in draws.collect()])
    assert abs(got.mean() - rate) < 5 * (rate / 4000) ** 0.5
    assert abs(got.var() - rate) < 0.15 * rate


def test_mixing_odd_rows(make, odd):
    df = make(odd)
    mixed = mixing.mixed_rows(df, epochs=5.0)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert mixing.mixed_rows(make([])).collect() == []
    assert mixing.mixed_rows(make([]), weights={"a": 1.0}).collect() == []


# ---------------------------------------------------------------- urls


def pages(spark, values):
    return spark.createDataFrame([(i, u, 1) for i, u in enumerate(values)], "page_id long, url string, host int")


def test_url_rules(spark):
    want = {
        None: ("", "", None, "allow"),
        "no-scheme.org/x": ("", "", None, "allow"),
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://www.example.org/en/19": ("www.example.org", "/en/19", "example.org/en/1", "block"),
        "http://www.example.org/en/29?x=/en/1": ("www.example.org", "/en/29", "org/", "allow"),
        "http://myexample.org/es/1": ("myexample.org", "/es/1", "org/", "allow"),
        "http://org": ("org", "", None, "allow"),
        "https://a.com/fr/x#y": ("a.com", "/fr/x", "com/fr/", "allow"),
        "https://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "https://a.com/de": ("a.com", "/de", None, "allow"),
        "https://a.com/FR/x": ("a.com", "/FR/x", None, "allow"),
        "https://casino.com/fr/x": ("casino.com", "/fr/x", "com/fr/", "allow"),
        "https://m.casino-win.net/": ("m.casino-win.net", "/", None, "block"),
        "https://ads-track.net": ("ads-track.net", "", None, "block"),
        "https://casinos.net/login": ("casinos.net", "/login", None, "block"),
        "https://casinos.net/loginpage": ("casinos.net", "/loginpage", None, "allow"),
        "ftp://x.net/a://b": ("x.net", "/a://b", None, "allow"),
    }
    values = [*want, *want]  # repeated urls
    got = urls.judge(pages(spark, values)).collect()
    assert len(got) == len(values)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == want[values[r.page_id]], values[r.page_id]
    assert urls.judge(pages(spark, [])).collect() == []


def test_url_rules_against_all_regular_expressions(spark):
    rng = random.Random(2)
    rules = [urls.Rule(f"r{i}", rng.choice(["allow", "block"]), f"{rng.choice('abc')}+/{rng.choice('ab')}", (), i) for i in range(4)]
    rules += [urls.Rule(f"t{i}", "block", rf"\b{w}\b", (w, "net"), 10 + i) for i, w in enumerate(["aa", "ab", "ba"])]
    values = ["http://" + "".join(rng.choice("ab.") for _ in range(5)) + ".net/" + "".join(rng.choice("ab/") for _ in range(5)) for _ in range(200)]
    import re

    for r in urls.judge(pages(spark, values), rules, default="none").collect():
        hits = [x for x in rules if re.search(x.pattern, r.host + r.path)]
        assert r.matched == (max(hits, key=lambda x: x.weight).name if hits else None)


def test_rules_are_indexed_by_their_rarest_token(spark):
    rules = urls.rule_table(spark, [urls.Rule("x", "block", "", ("often", "seldom"), 1), urls.Rule("y", "block", "", (), 1)])
    seen = spark.createDataFrame([("often", 9), ("seldom", 2)], "token string, urls long")
    assert {(r.name, r.token) for r in urls.index_rules(rules, seen).collect()} == {("x", "seldom"), ("y", "")}


# ---------------------------------------------------------------- licenses


def test_license_phrases_against_brute_force(make, corpus, odd):
    extra = ["MIT License, Apache License; GNU General Public License", "cc by cc by", "CC-BY", "the mit  license\nmit\tlicense", "mıt license mit licen\u212ae", "\u212aCC by"]
    rows = corpus + odd + [(800 + i, t) for i, t in enumerate(extra)]
    got = licenses.license_report(make(rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key)
    assert found == sorted(((d, *brute.licenses(t)) for d, t in rows), key=key)
    assert licenses.license_report(make([])).collect() == []


def test_statements_survive_small_changes(make):
    mit = next(t for t in licenses.STATEMENTS if t.name == "mit-grant").text.split()
    changed = mit[:5] + ["fully"] + mit[5:12] + mit[13:]
    noise = [f"n{i}" for i in range(40)]
    rows = [(1, " ".join(noise + mit + noise)), (2, " ".join(noise + changed)), (3, " ".join(mit[:8] + noise)), (4, " ".join(x for w in mit for x in (w, "z")))]
    got = {r.doc_id: r for r in licenses.license_report(make(rows)).collect()}
    assert (got[1].labels, got[1].score, got[1].n_base) == ("mit", 1.0, 0)
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert (got[3].labels, got[4].labels, got[4].score) == ("", "", 0.0)
    span = licenses.scan(make(rows[:1])).first()
    assert (span.start, span.end) == (40, 40 + len(mit) - 1)


# ---------------------------------------------------------------- classifier


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows, labels, web = [], [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        text = " ".join(w if good else w.upper() + "!!" for w in words)
        rows.append((i, text, rng.choice(["en", None]), "clean" if good == (rng.random() < 0.9) else "dirty", "clash"))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
        if i % 4 == 0:
            web.append((i, f"https://{'good' if good else 'spam'}.net/en/{i}?page=1", "<html><title>T</title><a href=x>"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    web = spark.createDataFrame(web, "page_id long, url string, html string")
    return docs, labels, web, {r[0]: "!!" not in r[1] for r in rows}


def test_classifier_on_unseen_documents(spark):
    docs, labels, web, truth = labelled(spark)
    got = cotraining.quality_scores(docs, labels, web).collect()
    assert len(got) == len(truth)
    unseen = [r for r in got if r.doc_id % 3]
    assert sum(r.kept == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    meta = [(r.meta_score > 0.5) == truth[r.doc_id] for r in unseen]
    assert sum(meta) / len(meta) > 0.75
    again = cotraining.quality_scores(docs.repartition(7), labels, web).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in got}


def test_a_strong_view_teaches_a_weak_one():
    rng = random.Random(1)
    y = np.array([rng.random() < 0.5 for _ in range(600)], int)
    text = cotraining.Examples([{10 + int(v): 5, 50 + rng.randrange(20): 1} for v in y])
    meta = cotraining.Examples([{100 + int(v) * 40 + rng.randrange(40): 1} for v in y])
    known = np.full(600, -1)
    known[:24] = y[:24]
    held = np.zeros(600, bool)
    held[:24:3] = True
    views, _ = cotraining.cotrain([text, meta], known, held)
    alone = meta.fit(known, (known >= 0) & ~held)
    right = ((meta.scores(views[cotraining.META][0]) > 0) == (y == 1))[24:].mean()
    assert right > ((meta.scores(alone) > 0) == (y == 1))[24:].mean() + 0.1


def test_every_unlabelled_document_may_teach(spark, monkeypatch):
    """All but the few labelled documents give pseudo-labels, as in one process, however the rows are dealt out."""
    docs, labels, web, truth = labelled(spark, 600)
    seen = {}
    real = cotraining.OnSpark.levels

    def levels(self, steps):
        out = real(self, steps)
        seen.setdefault("first", (self.size, out.sum() / cotraining.PARTS))
        return out

    monkeypatch.setattr(cotraining.OnSpark, "levels", levels)
    monkeypatch.setattr(cotraining, "ENTRIES", 500)
    got = cotraining.quality_scores(docs.union(docs).repartition(5), labels, web, max_labelled=60).collect()
    assert len(got) == 2 * len(truth)
    assert seen["first"][0] == 400 and seen["first"][1] > 300  # repeated rows are one document
    rows = cotraining.features(docs, labels, web, "doc_id", "text", 60).where("y < 2").orderBy("order", "id").collect()
    views = [cotraining.Examples.packed([r[a] for r in rows], [r[b] for r in rows]) for a, b in (cotraining.PACKED[:2], cotraining.PACKED[2:])]
    y, held = np.array([r.y for r in rows]), np.array([r.held for r in rows])
    source = cotraining.InMemory(views, y, held)
    source.block = source.block._replace(order=np.array([r.order for r in rows]))
    made, prior = cotraining.cotrain_on(source)
    scores = {r.doc_id: r.score for r in got}
    odds = sum(a * v.scores(w) + c for v, (w, a, c) in zip(views, made)) - prior
    assert np.allclose([scores[r.id] for r in rows], 1 / (1 + np.exp(-odds)))


def test_classifier_odd_rows(spark, make, odd):
    docs = make(odd)
    labels = spark.createDataFrame([(5, 1), (5, 0), (2, 0), (9, None), (None, 1), (77, 1), (1, 3)], "doc_id long, quality int")
    web = spark.createDataFrame([(1, None, None), (2, "http://a.net/5", None), (3, "http://a.net/x", "")], "page_id long, url string, html string")
    got = cotraining.quality_scores(docs, labels, web).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {round(r.score, 6) for r in cotraining.quality_scores(docs, none).collect()} == {0.5}
    assert cotraining.quality_scores(make([]), labels).collect() == []


def test_all_pages_whole_titles_and_whole_words_count(spark):
    """Features of each page add up; neither a title nor a word is cut."""
    title = " ".join(f"Word{i}" for i in range(300)) + " " + "a1" * 50
    rows = [
        ("http://a.org/x/5", f"<title>{title}</title><a href=1><a href=2>"),
        ("https://b.com/5.html?q=1", "<title>\nOther</title>"),
        ("http://b.com/6", None),
        ("http://b.com/no-number", "<title>x</title>"),
        (None, "<title>x</title>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r.id: dict(r.pages) for r in cotraining._page_table(df, "bigint").collect()}
    first = cotraining.page_features("http://a.org/x/5", title, 2)
    second = cotraining.page_features("https://b.com/5.html?q=1", "\nOther", 0)
    assert got == {5: dict(first + second), 6: dict(cotraining.page_features("http://b.com/6", "", None))}
    assert cotraining.shape("a1" * 50) == "a0" * 50
    features = cotraining.meta_features("en", None, 7, got[5])
    assert sum(features.values()) == 3 + sum(got[5].values())
