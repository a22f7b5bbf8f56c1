"""The Merkle manifest against a plain tree in Python."""

import zlib
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from tracesift.llm import merkle


def sha(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 16])) for k in range(0, len(last), 16)])
    return levels


def climb(levels, index, start):
    proof, cur = [], start
    for level in levels[:-1]:
        up = index // 16
        run = level[up * 16 : up * 16 + 16]
        left, right = "".join(run[: index - up * 16]), "".join(run[index - up * 16 + 1 :])
        proof.append(left + right)
        cur, index = sha(left + cur + right), up
    return proof, cur


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        bad = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            bad = leaf_of(doc_id, source, lang, n_chars, text.translate(lower))
        by_source.setdefault(source, []).append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, bad))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: x[0])
        trees[s] = levels_of([x[2] for x in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for tree, s in enumerate(order):
        for index, (_, doc_id, leaf, bad) in enumerate(by_source[s]):
            low, cur = climb(trees[s], index, bad)
            high, cur = climb(top, tree, cur)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(low + high)), cur, cur == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, index int, proof string, part int, subroot string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9, "y", 9, "z") for r in rows], SCHEMA)


def got(spark, rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle.verified_documents(frame(spark, rows)).collect()), key=str)


def test_manifest_of_odd_tables_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_LEVELS", 1)
    monkeypatch.setattr(merkle, "SECTOR_LEVELS", 2)
    rows = [(i, f"Text {i} Ä", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(900)]
    rows += [(7, None, None, None, None), (None, "", "de", None, 0), (5, "ABC", "en", "é", 3), (5, "ABC", "en", "é", 3)]
    rows += [(10_000, "Long " * 60_000, None, "lone", 300_000), (2**40, "T", "en", "", 1), (-3, "T", "en", "", 1)]
    found = got(spark, rows)
    assert found == sorted(brute(rows), key=str)
    assert {r[6] for r in found} == {True, False}
    assert got(spark, rows[3:4]) == brute(rows[3:4])
    assert got(spark, []) == []


def test_manifest_with_production_sizes(spark):
    rows = [(i, f"Text {i}", "en", "one" if i % 50 else "two", i) for i in range(4_400)]
    assert got(spark, rows) == sorted(brute(rows), key=str)


def test_proofs_of_a_part_of_the_leaves(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(200)]
    leaves = frame(spark, rows).select("doc_id", "source", merkle.leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    made = merkle.manifest(leaves)
    wanted = made.leaves.where("doc_id in (3, 4, 150, 151)")
    found = merkle.proofs(made, wanted).select("doc_id", merkle.folded(F.col("leaf"), F.col("proof")).alias("to"), "root").collect()
    root = made.root().head()["root"]
    assert sorted(r["doc_id"] for r in found) == [3, 4, 150, 151]
    assert all(r["to"] == r["root"] == root for r in found)


def test_missing_nodes_are_the_minimal_union():
    for own, size in (([5], 40), ([0, 1, 17, 300], 1000), (list(range(16, 32)), 5000), ([0], 1), (list(range(256)), 256)):
        widths = [size]
        while widths[-1] > 1:
            widths.append(-(-widths[-1] // 16))
        paths = [{i // 16**level for i in own} for level in range(len(widths))]
        need = {(level, k) for level in range(len(widths) - 1) for c in paths[level] for k in range(c // 16 * 16, min(widths[level], c // 16 * 16 + 16)) if k not in paths[level]}
        got_nodes = {(level, int(k)) for level, nodes in merkle.missing_nodes(np.array(own), size, 0, 64) for k in nodes}
        assert got_nodes == need
