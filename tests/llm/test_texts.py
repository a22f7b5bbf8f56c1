"""Kernel, near-duplicates, paragraphs, decontamination, packing and the pipeline against brute force."""

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracesift.llm import decontaminate, neardup, packing, paragraphs, similar_sets, textkernel
from tracesift.llm.common import components, marked, slices, text_bytes
from tracesift.llm.queries import tokenizer_path

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lo", "rin", "tas", "mu")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


def test_word_kernel_equals_split():
    texts = ["The quick  Brown fox", "", "a", "a b c d\x0be f\ng h", "  x", "ünï Ünï\x0cq", "x" * 3000, "\n", " tail "] * 3
    column = pa.array(texts)
    for most in (1, 20, 1 << 20):
        seen = {}
        for lo, hi in slices(column, most):
            data, offsets = text_bytes(column, lo, hi)
            found = textkernel.words(data, offsets)
            for u in range(hi - lo):
                span = slice(found.first[u], found.first[u + 1])
                got = [bytes(data[a:b]) for a, b in zip(found.starts[span], found.ends[span], strict=True)]
                assert got == texts[lo + u].encode().split()
                for word, value in zip(got, found.hashes[span].tolist(), strict=True):
                    assert seen.setdefault(word.translate(textkernel.LOWER_BYTES), value) == value
        assert len(set(seen.values())) == len(seen)
    assert list(slices(pa.array([], pa.string()))) == []


def test_shingles_of_short_and_long_units():
    column = pa.array(["a b c d", "a b c d", "b c", "a", "", "b a"])
    data, offsets = text_bytes(column, 0, 6)
    found = textkernel.words(data, offsets)
    hashes, first = textkernel.shingles(found.hashes, found.first, 3)
    assert np.diff(first).tolist() == [2, 2, 1, 1, 0, 1]
    assert hashes[0:2].tolist() == hashes[2:4].tolist()
    assert len(set(hashes.tolist())) == 5


def test_components_of_chains_stars_and_nothing(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (20, 30), (20, 31), (20, 32), (32, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 30: 20, 31: 20, 32: 20, 40: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).where("component <> 0").count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(5)
    values = []
    for share in (0.0, 0.5, 0.9, 1.0):
        common, own = rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 2**63, (2, 1000)).astype(np.uint64)
        n = int(1000 * share)
        rest = 1000 - n
        a, b = (np.concatenate((common[:n], own[k][:rest])) for k in (0, 1))
        fine = np.stack([similar_sets.minima(x, similar_sets.FINE) for x in (a, b)])
        values.append((n / (n + 2 * rest), *(x.tolist() for bits in (4, 1) for x in similar_sets.packed(fine, bits))))
    rows = spark.createDataFrame(values, "exact double, a array<long>, b array<long>, c array<long>, d array<long>")
    both = [similar_sets.estimate(F.col(x), F.col(y), similar_sets.FINE, bits) for x, y, bits in (("a", "b", 4), ("c", "d", 1))]
    for r in rows.select("exact", both[0].alias("four"), both[1].alias("one")).collect():
        assert abs(r["exact"] - r["four"]) < 0.06 and abs(r["exact"] - r["one"]) < 0.12


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK", 8)  # several blocks to a hub
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = prose(rng, rng.choice((8, 60, 200)))
        texts += [base, base.upper(), *(edited(rng, base, k) for k in (1, 2, 3, 5, 8, 13, 40))]
    hub = prose(rng, 150)
    texts += [edited(rng, hub, rng.randrange(1, 9)) for _ in range(80)]
    texts += ["", None, "  ", "one", "ONE", "one two", "one two", None, "", prose(rng, 20_000)]
    rows = [(i * 3, t, None, "s", None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, rows), size=3, percent=85).collect()}
    sets = {i: similar_sets.shingle_set(t or "", 3) for i, t, *_ in rows}
    assert len(got) == len(rows)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    want = brute_components(sets, 85)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_near_duplicates_of_odd_tables(spark):
    empty = docs_of(spark, [])
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.drop_near_duplicates(empty).columns == empty.columns
    a = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(7, a, "x", None, 1), (7, a, "x", None, 1), (None, a, None, None, 2), (3, a, None, None, 3), (9, None, None, None, None)]
    docs = docs_of(spark, rows).withColumn("rid", F.lit(1)).withColumn("component", F.lit("c"))
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 9]
    twice = docs_of(spark, [(7, a, "x", None, 1)] * 3)
    assert neardup.drop_near_duplicates(twice).count() == 1


def test_repeated_paragraphs_equal_brute_force(spark):
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (40, 55, 80, 300)]
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.randrange(5, 90)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), edited(rng, rng.choice(shared), rng.randrange(3)))
        if i % 7 == 0:
            lines.append("  é " + shared[1] + "\t")
        rows.append((i, "\n".join(lines), None, None, None))
    rows += [(100, "", None, None, None), (101, None, None, None, None), (102, "\n\n" + shared[0] + "\n", None, None, 5), (None, shared[0], None, None, None)]
    docs = docs_of(spark, rows)
    got = paragraphs.repeated_paragraphs(docs).collect()
    lines = {(i, k): x for i, t, *_ in rows if i is not None for k, x in enumerate((t or "").split("\n")) if len(x.split()) >= 40}
    comp = brute_components({k: similar_sets.shingle_set(x, 5) for k, x in lines.items()}, 80)
    groups = {}
    for k, c in comp.items():
        groups.setdefault(c, []).append(k)
    want = {k: c for c, ks in groups.items() if len({i for i, _ in ks}) > 1 for k in ks}
    assert {(r["doc_id"], r["paragraph"]): (r["component_doc"], r["component_paragraph"]) for r in got} == want
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]] == lines[r["doc_id"], r["paragraph"]].strip()
        assert r["kept"] == (want[r["doc_id"], r["paragraph"]] == (r["doc_id"], r["paragraph"]))
    passages = {r["doc_id"] for r in paragraphs.repeated_passages(docs).where("not kept").collect()}
    after = {r["doc_id"]: r for r in paragraphs.without_repeats(docs).collect()}
    assert len(after) == len(rows)
    for i, t in texts.items():
        gone = {p for (d, p), c in want.items() if d == i and c != (d, p)}
        words = " ".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone).split()
        left = (after[i]["text"] or "").split()
        assert left == words or (len(left) < len(words) and i in passages)
        if not gone and i not in passages:
            assert after[i]["text"] == t and after[i]["n_chars"] == dict((r[0], r[4]) for r in rows)[i]
        else:
            assert after[i]["n_chars"] == len(after[i]["text"])


def test_short_repeated_paragraphs_equal_brute_force(spark):
    rng = random.Random(23)
    shared = [prose(rng, n) for n in (3, 4, 5, 6, 10, 25, 39)]
    rows = []
    for i in range(40):
        lines = [prose(rng, rng.randrange(1, 50)) for _ in range(3)] + rng.sample(shared, 3)
        lines.append(edited(rng, shared[-1], rng.randrange(2)))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), None, None, None))
    docs = docs_of(spark, rows)
    lines = {(i, k): x for i, t, *_ in rows for k, x in enumerate(t.split("\n")) if len(x.split()) >= 5}
    groups = {}
    for k, c in brute_components({k: similar_sets.shingle_set(x, 5) for k, x in lines.items()}, 80).items():
        groups.setdefault(c, []).append(k)
    want = {k: c for c, ks in groups.items() if len({i for i, _ in ks}) > 1 for k in ks}
    got = paragraphs.repeated_paragraphs(docs).collect()
    assert {(r["doc_id"], r["paragraph"]): (r["component_doc"], r["component_paragraph"]) for r in got} == want and len(want) > 80
    after = "\n".join(r["text"] for r in paragraphs.without_repeats(docs).collect()).split("\n")
    assert [after.count(x) for x in shared[2:]] == [1] * 5


def test_passages_of_fifty_words_are_found_anywhere(spark):
    rng = random.Random(11)
    passage = prose(rng, 51)
    rows = []
    for i in range(40):
        words = prose(rng, rng.randrange(2, 120)).split()
        if i % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage.split() if i % 8 else passage.replace(" ", "\n", 3).upper().split(" ")
        rows.append((i, " ".join(words), None, None, None))
    rows += [(50, " ".join(passage.split()[:30]) + " " + prose(rng, 60), None, None, None), (51, None, None, None, None), (52, "", None, None, None),
             (53, "and " * 3000, None, None, None), (54, "and " * 90, None, None, None), (None, passage, None, None, None)]
    docs = docs_of(spark, rows)
    got = paragraphs.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} - {50} == {i for i in range(0, 40, 4)} | {53, 54}
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]]
        assert len(part.split()) == r["n_words"] and r["paragraph"] == texts[r["doc_id"]][: r["start"]].count("\n")
        if r["doc_id"] < 50:
            assert " ".join(part.lower().split()) in passage
    assert {r["doc_id"] for r in got if not r["kept"] and r["doc_id"] < 50} == set(range(4, 40, 4))
    assert {r["component_doc"] for r in got if r["doc_id"] == 0} == {0}
    after = [r["text"].lower().split() for r in paragraphs.without_repeats(docs).where("doc_id < 50").collect()]
    assert sum(passage in " ".join(w) for w in after) == 1
    assert paragraphs.repeated_passages(docs.limit(0)).count() == 0


def test_passages_are_cut_whole(spark):
    rng = random.Random(22)
    passages = [" ".join(f"p{k}w{rng.randrange(10**6)}" for _ in range(n)) for k, n in enumerate((50, 55, 90, 400))]
    quoted = " ".join(passages[3].split()[200:235])  # a part of one, and held by the first document of all
    texts = {0: f"{prose(rng, 40)} {quoted} {prose(rng, 40)}"}
    for i in range(1, 25):
        texts[i] = f"é {prose(rng, 300 + i)} before{i} {passages[i % 4]} after{i} {prose(rng, 300)}"
    docs = docs_of(spark, [(i, t, None, None, None) for i, t in texts.items()])
    after = {r["doc_id"]: r["text"].split() for r in paragraphs.without_repeats(docs).collect()}
    for i in range(1, 25):
        own = set(passages[i % 4].split())
        left = own & set(after[i])
        assert left == (set() if i > 4 else own if i % 4 != 3 else own - set(quoted.split()) if own - left else own)
    for r in paragraphs.repeated_passages(docs).where("doc_id > 4").collect():
        assert texts[r["doc_id"]][r["start"] :][: r["n_chars"]] == passages[r["doc_id"] % 4] and r["n_words"] == len(passages[r["doc_id"] % 4].split())


def test_a_passage_survives_whose_first_holder_is_a_cut_paragraph(spark):
    rng = random.Random(21)
    paragraph, passage = prose(rng, 220), prose(rng, 50)
    texts = {1: paragraph, 2: paragraph + " " + passage, 5: f"{prose(rng, 90)} {passage} {prose(rng, 90)}", 7: f"{prose(rng, 60)} {passage} {prose(rng, 60)}"}
    docs = docs_of(spark, [(i, t, None, None, None) for i, t in texts.items()])
    after = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs).collect()}
    assert after[1] == paragraph and after[2] == ""
    assert after[5] == texts[5] and passage not in after[7]


def test_paragraphs_of_odd_tables(spark):
    assert paragraphs.repeated_paragraphs(docs_of(spark, [])).count() == 0
    text = " ".join(WORDS[:60])
    docs = docs_of(spark, [(1, text, "a", "b", 1), (1, text, "a", "b", 1), (2, text, None, None, None)]).withColumn("rid", F.lit("r"))
    got = sorted((r["doc_id"], r["kept"]) for r in paragraphs.repeated_paragraphs(docs).collect())
    assert got == [(1, True), (1, True), (2, False)]
    assert paragraphs.without_repeats(docs).columns == docs.columns


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randrange(20, 45))) for k in range(30)] + [(40, "too few words"), (41, None), (42, "")]
    rows = []
    for i in range(40):
        words = prose(rng, rng.randrange(3, 300)).split()
        if i % 2:
            words[len(words) // 2 : len(words) // 2] = edited(rng, items[i % 30][1], 0 if i % 4 == 1 else 1).split()
        rows.append((i, " ".join(words).title() if i % 5 == 0 else "  ".join(words), None, None, None))
    rows += [(90, None, None, None, None), (91, "", None, None, None), (92, items[0][1] + " " + items[1][1], None, None, None), (93, "Too few WORDS", None, None, None)]
    docs = docs_of(spark, rows).withColumn("item_id", F.lit(5)).withColumn("similarity", F.lit(5))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(docs, table).collect()}

    index = decontaminate.build_index(items, 5)
    want = {}
    for i, t, *_ in rows:
        words = (t or "").lower().split()
        for item, text in items:
            own = (text or "").split()
            n = len(own)
            if not n or len(words) < n or (n < 5 and len(words) > n):
                continue
            for s in range(len(words) - n + 1):
                value = brute_similarity(index, own, words[s : s + n], items)
                if value >= 0.8 and value > want.get((i, item), (0,))[0] + 1e-6:
                    want[i, item] = (value, s)
    assert set(got) == set(want)
    for key, r in got.items():
        assert r["similarity"] == pytest.approx(want[key][0], abs=1e-5) and r["start_word"] == want[key][1]
        text = dict((i, t) for i, t, *_ in rows)[key[0]]
        assert len(text[r["start"] : r["start"] + r["n_chars"]].split()) == r["n_words"]
    clean = decontaminate.without_contaminated(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_ in rows} - {i for i, _ in want}
    assert decontaminate.contaminations(docs, table.limit(0)).count() == 0
    assert decontaminate.contaminations(docs.limit(0), table).count() == 0
    assert decontaminate.without_contaminated(docs, table.limit(0)).count() == len(rows)


def test_short_documents_and_short_items_are_decontaminated(spark):
    rng = random.Random(24)
    items = [(k, prose(rng, 50)) for k in range(8)] + [(20, "four quite short words"), (21, "Yes indeed"), (22, "unheard")]
    rows = [(k, " ".join(items[k][1].split()[k % 4 : 46 + k % 3]), None, None, None) for k in range(8)]
    rows += [(20, f"{prose(rng, 9)} Four quite  short WORDS {prose(rng, 30)}", None, None, None), (21, "yes indeed", None, None, None),
             (22, f"{prose(rng, 30)} unheard", None, None, None), (23, "yes", None, None, None), (24, "four quite short", None, None, None),
             (25, f"{items[0][1]} yes indeed unheard", None, None, None), (26, " ".join(items[1][1].split()[:30]), None, None, None)]
    index = decontaminate.build_index(items, 5)
    want = {}
    for i, t, *_ in rows:
        words = t.lower().split()
        for item, text in items:
            own = text.lower().split()
            n = min(len(own), len(words))
            for s in range(len(words) - n + 1):
                value = brute_similarity(index, own, words[s : s + n], items)
                if value >= 0.8 and value > want.get((i, item), (0,))[0] + 1e-6:
                    want[i, item] = (value, s, n)
    docs, table = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminations(docs, table).collect()}
    assert set(got) == set(want) and {(0, 0), (20, 20), (21, 21), (22, 22), (25, 22)} <= set(got)
    for key, r in got.items():
        assert (r["similarity"], r["start_word"], r["n_words"]) == (pytest.approx(want[key][0], abs=1e-5), *want[key][1:])
    assert {r["doc_id"] for r in decontaminate.without_contaminated(docs, table).collect()} == {i for i, *_ in rows} - {i for i, _ in want}


def brute_similarity(index, a, b, items):
    def bag(words):
        size = min(5, len(words))
        out = {}
        for k in range(len(words) - size + 1):
            x = tuple(w.lower() for w in words[k : k + size])
            out[x] = out.get(x, 0) + 1
        return out

    holders = {}
    for _, text in items:
        if text:
            for x in bag(text.split()):
                holders[x] = holders.get(x, 0) + 1
    n = sum(bool(t) for _, t in items)
    x, y = bag(a), bag(b)
    weight = {s: np.log1p(n / holders[s]) if s in holders else np.log1p(n) for s in {*x, *y}}
    total = sum(weight[s] * max(x.get(s, 0), y.get(s, 0)) for s in weight)
    return sum(weight[s] * min(x.get(s, 0), y.get(s, 0)) for s in weight) / total


def test_prints_within_the_radius_are_found():
    rng = np.random.default_rng(1)
    items = [(k, " ".join(rng.choice(WORDS, 30))) for k in range(200)]
    index = decontaminate.build_index(items, 5)
    n = 30
    for _ in range(100):
        value = int(rng.integers(0, 2**63)) if rng.random() < 0.3 else int(index.prints[rng.integers(200)])
        for bit in rng.choice(64, int(rng.integers(0, 24)), replace=False).tolist():
            value ^= 1 << bit
        near = {item for _, item, _ in decontaminate._near_items(index, n, np.array([value], np.uint64))}
        distance = np.bitwise_count(index.prints ^ np.uint64(value))
        assert near == set(np.flatnonzero(distance <= decontaminate.RADIUS).tolist())


def test_best_fit_against_a_plain_search():
    rng = random.Random(8)
    for most in (1, 3, 1000):
        fit, bins, closed = packing.BestFit(100, most), [], set()
        for _ in range(2000):
            size = rng.randrange(1, 101)
            fitting = [(100 - s, b) for b, s in enumerate(bins) if b not in closed and 0 < 100 - s and 100 - s >= size]
            bin_, offset = fit.put(size)
            if fitting:
                assert 100 - bins[bin_] == min(fitting)[0] and bin_ not in closed
            else:
                assert bin_ == len(bins)
                bins.append(0)
            assert offset == bins[bin_]
            bins[bin_] += size
            assert bins[bin_] <= 100
            open_ = {b for space in fit.bins for b in space}
            now_closed = set(range(len(bins))) - open_
            for b in now_closed - closed:
                assert bins[b] == 100 or all(bins[b] >= bins[o] for o in open_)
            closed = now_closed
            assert len(open_) <= most


def test_packed_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(40)] + [
        None, "", "   ", prose(rng, 9000), "Don't STOP now x 123 éte İ ΑΣ <|endoftext|> a<|startoftext|>b", "x" * 500, "́ y \x1c z"]
    docs = docs_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]).withColumn("piece", F.lit("p")).withColumn("length", F.lit(1))
    got = packing.packed(docs, tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    held = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 4096
    assert len(held) <= -(-sum(held.values()) // 4096) + 1
    assert packing.packed(docs.limit(0), tokenizer_path()).count() == 0
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))
    assert packing.packed(twice, tokenizer_path()).count() == 2


def test_large_buckets_are_dealt_and_keep_one_hub(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "EVIDENCE", 3)
    rng = random.Random(4)
    rows = [(k, [7, 1000 + rng.randrange(30), 5000 + k]) for k in rng.sample(range(200), 80)]
    rows += rows[:10] + [(300, [-1]), (301, [-1]), (302, [-2]), (302, [-2])]
    items = spark.createDataFrame(rows, "rid long, bands array<long>")
    want = {}
    for rid, keys in rows:
        for key in keys:
            want.setdefault(key, set()).add(rid)
    expected = sorted((key, min(own), rid) for key, own in want.items() if len(own) > 1 for rid in own)
    for sample in (items, items.limit(0)):
        found = similar_sets._members(items.repartition(5), sample)
        assert sorted(tuple(r) for r in found.select("key", "hub", "rid").collect()) == expected
    assert similar_sets._large_buckets(items).where("key = 7").count() == 1
    assert similar_sets._members(items.limit(0), items.limit(0)).count() == 0


def test_evenly_spaced_runs_are_one_row(spark):
    """A text that repeats two words has one row a print, and the passages it shares are one row a text."""
    places = np.array([3, 5, 7, 9, 20, 4, 6])
    rows, step, more = paragraphs.progressions(np.array([0, 0, 0, 0, 0, 1, 1]), np.array([7, 7, 7, 7, 7, 7, 8]), places)
    assert [(int(places[r]), int(s), int(m)) for r, s, m in zip(rows, step, more)] == [(3, 2, 3), (20, 0, 0), (4, 0, 0), (6, 0, 0)]
    texts = [(1, "tick tock " * 300), (2, "tick tock " * 900), (3, "one two " * 200 + "tick tock " * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert df.mapInArrow(paragraphs._run_finder, paragraphs._RUNS).count() <= 10  # before: one row every two words
    got = {(r.doc_id, r.kept): r.n_words for r in paragraphs.repeated_passages(df).collect()}
    assert got[2, False] == 1800 and got[3, False] == 600


def test_marked_rows_hold_all_ids_and_few_others(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") != 7, F.col("id").cast("int")).alias("k"))
    marks = marked(rows, "k", spark.range(0, 100_000, 100).select(F.col("id").alias("x")))
    told = {r["k"]: r["_maybe"] for r in marks.collect()}
    assert len(told) == 100_000 and all(told[k] for k in range(0, 100_000, 100)) and told[None] is False and sum(told.values()) < 1100
    assert marked(rows, "k", spark.range(0).select("id")).where("_maybe").count() == 0


def test_texts_that_share_nothing_are_not_shuffled(spark):
    rng = random.Random(5)
    own = lambda n, size: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(n))
    passage, line = own(60, 6), own(8, 6)
    texts = [own(40, 300) for _ in range(300)]
    for k in (3, 250):
        texts[k] = f"{own(5, 6)} {passage} {own(5, 6)}\n{line}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shuffled():
        store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(store.apply(k).totalShuffleWrite() for k in range(store.size()))

    before = shuffled()
    after = {r["doc_id"]: r["text"] for r in paragraphs.without_repeats(docs).collect()}
    assert shuffled() - before < sum(map(len, texts)) / 5
    assert passage in after[3] and line in after[3] and passage not in after[250] and line not in after[250]
    assert all(after[k] == t for k, t in enumerate(texts) if k != 250)


def test_a_vocabulary_holds_few_bytes_a_run():
    path, rng = tokenizer_path(), random.Random(6)
    runs = [f"{rng.choice('abc')}{k:05d}" for k in range(40_000)]
    packing._tokenizer(path), textkernel.powers(1 << 18)
    tracemalloc.start()
    held = packing.Vocabulary(path)
    for part in (runs[:15_000], runs[10_000:]):
        data = np.frombuffer(" ".join(part).encode(), np.uint8)
        ids, bounds = held.encode(data, np.array([0, len(data)]), 1)
        assert ids.tolist() == [*packing._tokenizer(path).encode(" ".join(part), add_special_tokens=False).ids, 1] and bounds.tolist() == [0, len(ids)]
    del ids, bounds, data
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 120 * len(runs)
