"""The registered queries of this subpackage, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import (
    alignment,
    bpe,
    byte_bpe,
    chunks,
    cotraining,
    licenses,
    lines,
    mixing,
    periods,
    quality,
    simhash,
    suffixes,
    urls,
)
from tastegrid.llm.common import BLANK, read_table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(twin: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if twin is not None:
            ORACLES[fn.__name__] = twin
        return fn

    return register


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that cuts texts into pieces for the byte-level vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@query()
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, as digests."""
    return bpe.digests(bpe.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file()))


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, radius=2)


@query(
    r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
    WINDOW g AS (PARTITION BY norm)
    """
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return chunks.exact_duplicates(read_table(spark, sf_dir, "documents"))


@query()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.quality_rules(read_table(spark, sf_dir, "documents")).select(columns)


MIX = {"smoothing": 0.5, "epochs": 1.0, "seed": 1}


@query(
    r"""
    WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
    sums AS (SELECT sum(size) AS all_size, sum(pow(size, 0.5)) AS all_target FROM sizes),
    rates AS (SELECT source, pow(size, 0.5) / all_target * all_size / size AS rate FROM sizes, sums),
    parts AS (SELECT source, rate, greatest(1, ceil(rate / 16))::INT AS draws, rate / greatest(1, ceil(rate / 16)) AS part FROM rates),
    cdf AS (
        SELECT source, part, 0 AS k, exp(-part) AS p, exp(-part) AS total FROM parts
        UNION ALL SELECT source, part, k + 1, p * part / (k + 1), total + p * part / (k + 1) FROM cdf WHERE k < 71),
    tables AS (SELECT source, list(total) AS entries FROM cdf GROUP BY source),
    drawn AS (
        SELECT d.*, rate, list_sum(list_transform(range(1, draws + 1), lambda i: len(list_filter(entries,
            lambda c: c <= ('0x' || substr(md5('1|' || d.doc_id || '|' || i), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS copies
        FROM documents d JOIN parts USING (source) JOIN tables USING (source))
    SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies, round(rate, 6) AS rate,
        ('0x' || substr(md5('1|order|' || doc_id || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS order_key
    FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)
    """
)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus mixed to the square roots of its sources' sizes, once over, in random order."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("row.*", "copy", "copies", F.round("rate", 6).alias("rate"), "order_key")


@query(
    r"""
    WITH places AS (
        SELECT page_id, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
        FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)),
    ruled AS (
        SELECT *, CASE
            WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN regexp_matches(host, '(^|\.)example\.org$') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/') THEN 'org/'
            END AS rule,
            regexp_matches(host || path, '^([^/]*[.-])?(adult|casino|poker|bets|betting|lottery|pills|viagra|pharmacy|porn|sex|xxx|escort|spam|seo|clickbait|ads|adserver|ads-track|track|tracker|doubleclick|banner)[.-]')
            OR regexp_matches(host || path, '^[^/]*/(.*/)?(login|signin|signup|logout|cart|checkout)([/.]|$)') AS bad
        FROM places)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled
    """
)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    judged = urls.judge(read_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and statements in every document."""
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS no FROM split),
    worded AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos,
            len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
        FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    runs AS (
        SELECT doc_id, pos, words, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(words, 1) OVER w AS more
        FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    counted AS (
        SELECT doc_id, pos, 3 AS size, [a, b, c] AS run FROM runs WHERE c IS NOT NULL
        UNION ALL SELECT doc_id, pos, 2, [a, b] FROM runs WHERE b IS NOT NULL AND words + more >= 50
        UNION ALL SELECT doc_id, pos, 1, [a] FROM runs WHERE words >= 50),
    firsts AS (
        SELECT doc_id, pos, size, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_at
        FROM counted WINDOW w AS (PARTITION BY run ORDER BY doc_id, pos)),
    gone AS (
        SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM firsts WHERE doc_id <> first_doc OR pos >= first_at + size),
    counts AS (
        SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS n_runs
        FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
    kept AS (
        SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.no) AS text, count(w.pos) AS n_worded
        FROM numbered n LEFT JOIN worded w USING (doc_id, no) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos
        WHERE g.pos IS NULL GROUP BY n.doc_id),
    ids AS (SELECT doc_id, pos, dense_rank() OVER (ORDER BY line) AS l, count(*) OVER (PARTITION BY line) AS c FROM worded),
    grown AS (
        SELECT 1 AS m, doc_id, pos, l AS g FROM ids WHERE c > 1
        UNION ALL SELECT m, doc_id, pos, g FROM (
            SELECT x.m + 1 AS m, x.doc_id, x.pos, dense_rank() OVER (ORDER BY g, l) AS g, count(*) OVER (PARTITION BY g, l) AS n
            FROM grown x JOIN ids y ON y.doc_id = x.doc_id AND y.pos = x.pos + x.m) WHERE n > 1),
    longest AS (SELECT doc_id, max(m) AS longest_run FROM grown GROUP BY doc_id)
    SELECT doc_id, coalesce(n_worded, 0) + coalesce(n_removed, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
        coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN longest USING (doc_id)
    """
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of runs of three lines, or of fifty words in fewer."""
    cleaned = lines.remove_repeated_lines(read_table(spark, sf_dir, "documents"), min_lines=3, min_words=50)
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("text", 256).alias("kept_sha256")
    )


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from the labels."""
    docs, labels, pages = (read_table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return cotraining.quality_scores(docs, labels, pages)


@query(
    r"""
    WITH d AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    places AS (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50),
    windows AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM places),
    firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
    gone AS (
        SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
        FROM windows JOIN firsts USING (s) WHERE doc_id > first),
    runs AS (
        SELECT doc_id, i, sum(CASE WHEN before + 50 >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
    ends AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d),
    pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS before FROM ends),
    kept AS (
        SELECT doc_id, any_value(n) AS n_bytes, sum(b - a) AS n_removed, count(*) - 1 AS n_spans,
            string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS x
        FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
        sha256(unhex(x)) AS kept_sha256 FROM kept
    """
)
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier document has in strings of 50."""
    found = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the ids with a periodic end, in words joined by one space.

    Of the ids whose CRC-32 h (of the decimal digits) is divisible by ten, word i from a on becomes word a + (i - a) mod p.
    Null ids and texts without words stay as they are.
    """
    words = F.filter(F.split(text_of(), f"[{BLANK}]+"), lambda w: w != "")
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = F.transform(
        "words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    )
    rows = docs.select("doc_id", text_of().alias("text"), code.alias("h"), F.when(code % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query(
    r"""
    WITH bits AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
            list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS steps
        FROM documents),
    coded AS (
        SELECT doc_id, w, len(w) AS n, xor(4294967295::BIGINT, list_reduce(steps, lambda c, x:
            xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) AS h FROM bits),
    places AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts FROM coded),
    planted AS (
        SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
            lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) END AS w FROM places),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM planted),
    grams AS (
        SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d) AS gram,
            lead(word, 3) OVER d IS NOT NULL AS whole
        FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    repeats AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
        ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND x.whole AND y.whole),
    stretches AS (
        SELECT doc_id, q, min(i) AS start, count(*) + 3 + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM repeats) GROUP BY doc_id, q, part),
    runs AS (
        SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words WHERE NOT EXISTS (
            SELECT 1 FROM runs WHERE runs.doc_id = words.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, max({'length': length, 's': -start, 'p': -period}) AS best,
            string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
        FROM runs GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.length AS length, -best.p AS period,
        1000 * best.length // -best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """
)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and its text without the repeats."""
    found = periods.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), min_length=12)
    return periods.digests(found)


@query()
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of every document, as digests."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_decode(read_table(spark, sf_dir, "documents"), ranks, split_pattern()))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens in every document."""
    files = tokenizer_file("byte_bpe_50k.json"), split_pattern(), tokenizer_file("piece_bpe_32k.model")
    found = alignment.align(read_table(spark, sf_dir, "documents"), *files, digest=True)
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum".split()
    return found.select(*columns, F.col("groups").alias("groups_sha256"))
