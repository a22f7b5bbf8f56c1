"""Periodic runs against brute force, token counts against the tokenizer on whole texts."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tracesift.llm import periodic, tokencount
from tracesift.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())


def docs_of(spark, rows):
    schema = "doc_id long, text string, runs int, start string, n_tokens string, key string, best int, number int"
    return spark.createDataFrame([(*r, 1, "s", "t", "k", 2, 3) for r in rows], schema)


def repetitive(rng, n, letters):
    words = []
    while len(words) < n:
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
        words += unit * rng.choice([1, 1, 2, 3, 4, 5, 8])
    return words[:n]


def test_runs_of_repetitive_words_equal_brute_force():
    rng = random.Random(5)
    for letters in ("a", "ab", "abc", "abcdefgh"):
        for n in (0, 3, 5, 6, 7, 8, 9, 23, 24, 60, 150, 300):
            for _ in range(6):
                words = repetitive(rng, n, letters)
                assert sorted(periodic.runs_of(np.array([ord(w) for w in words], np.int64)), key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_splitting_keeps_every_run():
    rng = random.Random(6)
    words = []
    for _ in range(60):
        words += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30))] + repetitive(rng, rng.randrange(40), "abc")
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([numbers[w] for w in words], np.int64)
    segments = sorted(periodic.surviving_segments(ids, np.zeros(len(ids), np.int64)))
    assert sum(b - a for a, b in segments) < len(words)
    for start, length, _ in brute_runs(words):
        assert any(a <= start and start + length <= b for a, b in segments)
    for a, b in segments:
        assert min(words[a:b].count(w) for w in words[a:b]) >= 4


def test_run_digests_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(80), rng.choice(["ab", "abcd", "abcdefghijklmn"])))) for i in range(300)]
    rows += [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(400)))) for i in range(300, 400)]
    rows += [(401, None), (402, ""), (403, " \t\n\x0b"), (None, "x x x x x x x"), (5, "a b " * 9), (5, "a b " * 9), (404, "é É é É " * 7)]
    got = [tuple(r) for r in periodic.run_digests(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert periodic.run_digests(docs_of(spark, [])).count() == 0


def test_runs_of_a_very_long_text_and_many_equal_words():
    ids = np.zeros(300_000, np.int64)
    assert periodic.runs_of(ids[:60_000]) == [(0, 60_000, 1)]
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300_000, 400_000)
    ids[100_000:200_000] = np.tile(ids[100_000:110_000], 10)
    segments = list(periodic.surviving_segments(ids, np.zeros(len(ids), np.int64)))
    found = [(a + s, n, q) for a, b in segments if b - a > 50_000 for s, n, q in periodic.runs_of(ids[a:b])]
    assert (100_000, 100_000, 10_000) in found


def plain_counts(rows):
    encode = tokencount._tokenizer(PATH).encode
    return sorted(((d, len((t or "").encode()), len(encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=str)


def hard_texts(rng):
    parts = ["word", " ", "  ", "\n\n \t", "it's", "'", "we'll", "<|endoftext|>", "<|endof", "é", "漢字漢字", "🙂", "12345", "...", "x" * 70, " " * 60, " ", "don't stop"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(5, 120))) for _ in range(120)]


def test_counts_of_spliced_texts_equal_the_tokenizer(spark):
    rng = random.Random(8)
    rows = list(enumerate(hard_texts(rng)))
    rows += [(500, "a" * 3000), (501, " " * 2500), (502, "<|endoftext|>" * 150), (503, None), (504, ""), (None, "b c " * 200), (1, rows[1][1]), (505, "!?" * 900 + "tail of words " * 40)]
    found = tokencount.token_counts(docs_of(spark, rows), PATH, step=60, overlap=40)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_counts(rows)
    assert tokencount.token_counts(docs_of(spark, []), PATH).count() == 0


def test_counts_by_units_equal_the_tokenizer():
    rng = random.Random(10)
    texts = [*hard_texts(rng), *(" ".join(t) for t in hard_texts(rng)), "", " ", "a  b", "a\u3000 b", "a\u00a0 b", "a\x1f b", "x\n y", "<|endoftext|> <|endoftext|>", "a <|endof text|>"]
    encode = tokencount._tokenizer(PATH).encode
    for _ in range(2):
        assert tokencount._counts(PATH, texts) == [len(encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_with_production_sizes(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(hard_texts(rng)[:20]) * 60) for i in range(3)] + [(9, "z" * 150_000), (10, "short")]
    found = tokencount.counted_documents(docs_of(spark, rows), PATH)
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == plain_counts(rows)
    assert {r["doc_id"]: r["over_limit"] for r in found.collect()}[10] is False


def test_overlap_must_exceed_the_margin(spark):
    with pytest.raises(ValueError):
        tokencount.token_counts(docs_of(spark, []), PATH, step=100, overlap=10)
