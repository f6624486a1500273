"""Plain Python versions of the text operators, for small inputs."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import xxhash

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SMALL = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, odd characters and very different lengths."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ßK-.") for _ in range(rng.randint(1, 8))).strip() or "a" for _ in range(300)]

    def words(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k))

    passage = words(40)
    lines = [words(6) for _ in range(4)]
    texts = [words(rng.randint(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[0].replace(" ", "\n", 1), texts[1] + "  ", texts[2] + " end", texts[3][5:]]
    texts += [words(20) + passage + words(20), passage, passage + " " + passage, "x" * 400, "ab" * 300, "x" * 49, "x" * 50]
    texts += ["\n".join([words(3), *lines, words(3)]), "\n".join([*lines, "", *lines]), "\n\n" + "\n".join(lines[1:])]
    texts += [None, "", " \t\n", "\u00a0", "MIT License and CC BY", " ".join(["same"] * 300), words(4000)]
    return list(enumerate(texts))


def exact(rows):
    """doc_id -> (keep_id, group_size, kept, sha) with unique ids."""
    norm = {d: re.sub(f"{BLANK}+", " ", t or "") for d, t in rows}
    groups = {}
    for d in norm:
        groups.setdefault(norm[d], []).append(d)
    return {d: (min(groups[x]), len(groups[x]), d == min(groups[x]), sha(x)) for d, x in norm.items()}


def fingerprint(text):
    w = re.findall(WORD, (text or "").translate(SMALL))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near(rows, bits=2):
    """doc_id -> (fingerprint, component)."""
    fps = {d: fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= bits]
    found = components(pairs, ids)
    return {d: (f"{fps[d]:016x}", found[d]) for d in ids}


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = re.findall(WORD, text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def repeats(rows, span=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept sha) with unique ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mine = [b[i : i + span] for i in range(len(b) - span + 1)]
        gone = [False] * len(b)
        for i, s in enumerate(mine):
            if s in seen:
                gone[i : i + span] = [True] * span
        seen.update(mine)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def line_runs(rows, k=3, words=50):
    """doc_id -> (n_lines, n_removed, n_runs, longest_run, kept text) with unique ids."""
    first, out, places = {}, {}, {}
    split = {d: (t or "").split("\n") for d, t in rows}
    worded = {d: [x for x in lines if re.search(WORD, x)] for d, lines in split.items()}

    def counted(d):
        for n in range(1, k + 1):
            for p in range(len(worded[d]) - n + 1):
                run = tuple(worded[d][p : p + n])
                if n == k or sum(len(re.findall(WORD, x)) for x in run) >= words:
                    yield p, n, run

    for d in sorted(split):
        for p, _, run in counted(d):
            first.setdefault(run, (d, p))
        for p in range(len(worded[d])):
            places.setdefault(worded[d][p], []).append((d, p))
    for d in sorted(split):
        gone = set()
        for p, n, run in counted(d):
            at = first[run]
            if at[0] != d or p >= at[1] + n:
                gone.update(range(p, p + n))
        longest = 0
        for p, x in enumerate(worded[d]):
            for e, q in places[x]:
                n = 0
                while (e, q) != (d, p) and worded[d][p + n : p + n + 1] == worded[e][q + n : q + n + 1] != []:
                    n += 1
                longest = max(longest, n)
        numbers = [i for i, x in enumerate(split[d]) if re.search(WORD, x)]
        drop = {numbers[p] for p in gone}
        kept = "\n".join(x for i, x in enumerate(split[d]) if i not in drop)
        out[d] = (len(worded[d]), len(gone), sum(1 for p in gone if p - 1 not in gone), longest, kept)
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    """(n_words, n_base, first, last, labels)."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(SMALL))
    hits = [(i, x) for p, x in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def planted(doc_id, text):
    """The words of a text, with the periodic end that a tenth of the ids get."""
    w = re.findall(WORD, text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def word_runs(w, min_length=12):
    """Sorted (start, length, period) of all runs: every period is tried."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def alignments(texts, encode_a, encode_b, bytes_a, bytes_b):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum), from sets of bytes."""
    done = []
    for text in texts:
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        sides = []
        for ids, spell in ((a, bytes_a), (b, bytes_b)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(spell(i)), i))
                at += len(spell(i))
            sides.append(spans)
        spelt = [b"".join(spell(i) for i in ids) for ids, spell in ((a, bytes_a), (b, bytes_b))]
        if not text or any(s != (" " + text).encode() for s in spelt):
            done.append(([], [], [], []))
            continue
        links, first = [], 0
        for s, e, i in sides[0]:
            while sides[1][first][1] <= s:
                first += 1
            k = first
            while k < len(sides[1]) and sides[1][k][0] < e:
                links.append((i, sides[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
        inside = lambda spans, lo, hi: ",".join(str(i) for s, e, i in spans if lo < e <= hi)
        groups = ["|".join(inside(spans, lo, hi) for spans in sides) for lo, hi in zip([0, *cuts], cuts)]
        done.append((a, b, groups, links))
    count = Counter(p for *_, links in done for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (len(a), len(b), len(g), len(k), ";".join(g), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k))
        for a, b, g, k in done
    ]
