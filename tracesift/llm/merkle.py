"""A Merkle manifest of a table and inclusion proofs by octopus multiproofs.

Rows are leaves of one 16-ary tree per source; the sources' roots are the leaves
of a top tree. Proofs are made per leaf partition: 4,096 neighbouring leaves work
out which nodes beside their own they need, get them in one join, derive the
interior nodes they share and expand each leaf's proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import fold
from tracesift.operators.ranking import bucket_shifts, numbered, placed, with_shifts
from tracesift.session import written_once

ARITY = 16
#: Levels below the root of a leaf partition, and of a sector, which fetches the nodes further up once for its partitions.
PART_LEVELS, SECTOR_LEVELS = 3, 6
#: The number of the top tree among the trees of the sources, which count from 0.
TOP = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(*columns: Column) -> Column:
    """Lowercase hex sha256 of the values: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass
class Manifest:
    """``leaves``: the rows with ``tree``, ``size`` (its leaves) and ``index`` (from 0), ``leaf``.

    ``nodes``: ``tree``, ``level`` (1 up), ``index``, ``hash`` of all interior nodes and, for the
    top tree, of its leaves, the ``trees`` subroots. ``sources``: ``tree``, ``source``.
    """

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    trees: int

    def root(self) -> DataFrame:
        """One row with ``root``; none for an empty table."""
        at = (F.col("tree") == TOP) & (F.col("level") == depth_of(self.trees))
        return self.nodes.where(at).select(F.col("hash").alias("root"))


def depth_of(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    depth = 0
    while size > 1:
        size, depth = -(-size // ARITY), depth + 1
    return depth


def _parents(nodes: DataFrame) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("index", "hash")))
    grouped = nodes.groupBy("tree", "size", F.expr(f"index div {ARITY}").alias("_up")).agg(kids.alias("_kids"))
    joined = F.concat_ws("", F.transform("_kids", lambda k: k["hash"])).cast("binary")
    return grouped.select("tree", F.ceil(F.col("size") / ARITY).alias("size"), F.col("_up").alias("index"), F.sha2(joined, 256).alias("hash"))


def _grown(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``leaves``, each a sixteenth of the one below and written once, up to the root of the largest tree, of ``most`` leaves."""
    levels, below = [], leaves
    for _ in range(depth_of(most)):
        below = written_once(_parents(below.where("size > 1")))
        levels.append(below)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    out = levels[0].where("size = 1").select("tree", "hash")
    for level in levels[1:]:
        out = out.union(level.where("size = 1").select("tree", "hash"))
    return out


def manifest(rows: DataFrame) -> Manifest:
    """The trees over ``rows``, which hold ``source``, ``doc_id``, ``leaf`` and any further columns.

    Leaves of a source ascend by ``doc_id`` (null first, ties by ``leaf``), trees by
    ``source`` (null first, bytewise). Places come from range partitions and prefix
    sums, so a source with a third of all rows is spread over many tasks. Repeated
    rows are leaves each. An empty table gives no leaves, nodes or roots.
    """
    kept = placed(rows, ["source"], F.asc("doc_id"), F.asc("leaf"))
    shifts = bucket_shifts(kept, ["source"])
    sources = numbered(shifts.select("source").distinct(), [], F.asc("source"), name="tree")
    trees = written_once(sources.withColumn("tree", F.col("tree") - 1).withColumnRenamed("source", "_source"))
    facts = shifts.join(trees, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaves = with_shifts(kept, facts, ["source"]).select(
        *rows.columns, "tree", F.col("_size").alias("size"), (F.col("_place") + F.col("_shift")).alias("index"))
    first = leaves.select("tree", "size", "index", F.col("leaf").alias("hash"))
    count, most = facts.agg(F.countDistinct("tree"), F.max("_size")).head()
    levels = _grown(first, most or 0)
    subroots = _tops([first, *levels])
    top_leaves = written_once(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("index"), "hash"))
    top_levels = _grown(top_leaves, count)
    nodes = None
    for level, part in [*enumerate(levels, 1), *enumerate([top_leaves, *top_levels])]:
        mine = part.select("tree", F.lit(level).alias("level"), "index", "hash")
        nodes = mine if nodes is None else nodes.union(mine)
    return Manifest(leaves, nodes, trees.withColumnRenamed("_source", "source"), count)


def missing_nodes(own: np.ndarray, size: int, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per level from ``first`` to below ``stop``: the nodes that proofs of ``own`` (nodes of level ``first``) need and can't derive.

    ``size`` counts the tree's leaves. The union over all of ``own``: a node that
    lies above one of them is derived, one that several need comes up once.
    """
    mine = np.unique(own)
    for level in range(first, stop):
        width = -(-size // ARITY**level)
        if width <= 1:
            return
        runs = np.unique(mine // ARITY)
        kids = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(kids[kids < width], mine, assume_unique=True)
        mine = runs


def _needs_of(keys: list[str], trees: int | None):
    """Arrow function: rows with ``keys``, ``size`` and ``own`` to rows with ``keys``, ``_tree``, ``level``, ``index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                if trees is None:
                    found += [(row["tree"], *x) for x in missing_nodes(np.array(row["own"]), row["size"], 0, SECTOR_LEVELS)]
                else:
                    found += [(row["tree"], *x) for x in missing_nodes(np.array([row["sector"]]), row["size"], SECTOR_LEVELS, 64)]
                    found += [(TOP, *x) for x in missing_nodes(np.array([row["tree"]]), trees, 0, 64)]
                    found += [(TOP, 0, np.array([row["tree"]])), (TOP, depth_of(trees), np.array([0]))]
                for tree, level, nodes in found:
                    n = len(nodes)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([row[k]] * n, pa.int64()) for k in keys], pa.array([tree] * n, pa.int64()),
                         pa.array([level] * n, pa.int32()), pa.array(nodes, pa.int64())], names=[*keys, "_tree", "level", "index"])

    return run


def _fetched(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    return needs.join(nodes.withColumnRenamed("tree", "_tree"), ["_tree", "level", "index"])


def expand(own: list[tuple[int, str]], size: int, tree: int, trees: int, fetched: dict[tuple[int, int, int], str]) -> Iterator[list[tuple[str, str]]]:
    """For each leaf (index, hash) its proof: per level up to the root, the siblings left of the path and right of it, joined.

    ``fetched`` holds the needed nodes by (tree, level, index); interior nodes of the leaves are derived here, once each.
    """
    known = dict(fetched)
    known.update(((tree, 0, index), leaf) for index, leaf in own)
    chain, path, width = [], sorted({i for i, _ in own}), size
    for number in (tree, TOP):
        level = 0
        while width > 1:
            ups = {}
            for up in sorted({i // ARITY for i in path}):
                run = [known[number, level, k] for k in range(up * ARITY, min(width, (up + 1) * ARITY))]
                known[number, level + 1, up] = sha256("".join(run).encode()).hexdigest()
                ups[up] = run
            chain.append(ups)
            path, width, level = list(ups), -(-width // ARITY), level + 1
        if number == tree:
            known[TOP, 0, tree] = known[tree, level, 0]
            lower, path, width = len(chain), [tree], trees
    above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def rest(depth: int, index: int) -> list[tuple[str, str]]:
        if depth == len(chain):
            return []
        if depth == lower:
            index = tree
        if (depth, index) not in above:
            up, place = divmod(index, ARITY)
            run = chain[depth][up]
            above[depth, index] = [("".join(run[:place]), "".join(run[place + 1 :])), *rest(depth + 1, up)]
        return above[depth, index]

    for index, _ in own:
        if lower == 0:
            yield rest(0, tree)
        else:
            up, place = divmod(index, ARITY)
            run = chain[0][up]
            yield [("".join(run[:place]), "".join(run[place + 1 :])), *rest(1, up)]


_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _expander(trees: int):
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        nodes = dict(zip(zip(*[fetched[c].to_pylist() for c in ("_tree", "level", "index")], strict=True), fetched["hash"].to_pylist(), strict=True))
        own = list(zip(leaves["index"].to_pylist(), leaves["leaf"].to_pylist(), strict=True))
        tree = leaves["tree"][0].as_py()
        subroot, root = nodes[TOP, 0, tree], nodes[TOP, depth_of(trees), 0]
        found = expand(own, leaves["size"][0].as_py(), tree, trees, nodes)
        pairs = [[{"left": a, "right": b} for a, b in proof] for proof in found]
        for name, value in (("subroot", subroot), ("root", root)):
            leaves = leaves.append_column(name, pa.array([value] * len(leaves), pa.string()))
        return leaves.append_column("proof", pa.array(pairs, _PROOF))

    return run


def proofs(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves of ``made`` (those of ``wanted``, a part of its leaves) with the ``subroot`` and ``root`` of the manifest and ``proof``: per level ``left`` and ``right`` siblings.

    A leaf partition gets the nodes of six levels by itself; those further up, and
    the top tree's, its sector of 4,096 partitions gets once, so that no node is
    asked for by all partitions.
    """
    leaves = made.leaves if wanted is None else wanted
    nodes = made.nodes
    if wanted is not None:
        nodes = nodes.union(made.leaves.select("tree", F.lit(0), "index", "leaf"))
    trees = made.trees
    part, sector = ARITY**PART_LEVELS, ARITY**SECTOR_LEVELS
    mine = leaves.select("*", F.expr(f"index div {part}").alias("part"))
    parts = mine.groupBy("tree", "size", "part").agg(F.collect_set("index").alias("own"))
    near = _fetched(parts.mapInArrow(_needs_of(["tree", "part"], None), "tree long, part long, _tree long, level int, index long"), nodes)
    placed_parts = parts.select("tree", "size", "part", F.expr(f"part div {sector // part}").alias("sector"))
    sectors = placed_parts.select("tree", "size", "sector").distinct()
    far = _fetched(sectors.mapInArrow(_needs_of(["tree", "sector"], trees), "tree long, sector long, _tree long, level int, index long"), nodes)
    far = placed_parts.join(far, ["tree", "sector"]).select("tree", "part", "_tree", "level", "index", "hash")
    fetched = near.select("tree", "part", "_tree", "level", "index", "hash").union(far)
    out = ", ".join(f"`{c}` {t}" for c, t in mine.dtypes) + ", subroot string, root string, proof array<struct<left:string,right:string>>"
    return mine.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(_expander(trees), out).drop("part")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def verified_documents(docs: DataFrame) -> DataFrame:
    """Leaf, roots, digest of the proof and root refolded after tampering, for every document.

    A document whose ``crc32`` of the decimal id is divisible by 5 is tampered with:
    A-Z of its text become a-z (a null text stays, a null id is left alone). Null
    values hash as ``-``; columns beyond doc_id, source, lang, n_chars and text play
    no part. Repeated rows are leaves each; an empty table gives no rows.
    """
    doc_id, text = F.col("doc_id"), F.col("text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(fold(doc_id, 5) == 0, leaf_hash(*fields, F.translate(text, _UPPER, _LOWER)))
    made = manifest(docs.select("doc_id", "source", leaf_hash(*fields, text).alias("leaf"), tampered.alias("tampered")))
    found = proofs(made)
    digest = F.sha2(F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"]))).cast("binary"), 256)
    return found.select(
        doc_id.cast("long").alias("doc_id"), "leaf", "subroot", "root", digest.alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_STEP = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {_CRC_STEP})), 4294967295)"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || ({c}::VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of a tree's nodes and of each node's joined siblings to the left and right."""
    run = f"OVER (PARTITION BY tree, level, idx // {ARITY} ORDER BY idx ROWS BETWEEN"
    return f"""{name} AS (
    {leaves}
    UNION ALL
    SELECT tree, level + 1, idx // {ARITY}, (size + {ARITY - 1}) // {ARITY}, sha256(string_agg(hash, '' ORDER BY idx))
    FROM {name} WHERE size > 1 GROUP BY tree, level, idx // {ARITY}, size),
{name}_sides AS (SELECT tree, level, idx,
    coalesce(string_agg(hash, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name} WHERE size > 1)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    return f"""{name} AS (
    {start}
    UNION ALL
    SELECT w.row_no, w.tree, s.level + 1, s.idx // {ARITY}, proof || l || r, sha256(l || w.hash || r)
    FROM {name} AS w JOIN {tree}_sides AS s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx),
{name}_end AS (SELECT row_no, tree, arg_max(proof, level) AS proof, arg_max(hash, level) AS hash FROM {name} GROUP BY row_no, tree)"""


#: DuckDB SQL for ``verified_documents`` over the view ``documents``.
ORACLE = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS tampered
    FROM documents),
trees AS (SELECT source AS tree_source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM hashed)),
leaves AS (
    SELECT h.*, tree, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS size
    FROM hashed AS h JOIN trees ON source IS NOT DISTINCT FROM tree_source),
{_tree_sql("low", "SELECT tree, 0 AS level, idx, size, leaf AS hash FROM leaves")},
subroots AS (SELECT tree, hash FROM low WHERE size = 1),
{_tree_sql("top", "SELECT 0 AS tree, 0 AS level, tree AS idx, (SELECT count(*) FROM trees) AS size, hash FROM subroots")},
{_walk_sql("climb", "low", "SELECT row_no, tree, 0 AS level, idx, '' AS proof, coalesce(tampered, leaf) AS hash FROM leaves")},
{_walk_sql("rise", "top", "SELECT row_no, 0 AS tree, 0 AS level, tree AS idx, proof, hash FROM climb_end")}
SELECT doc_id, leaf, s.hash AS subroot, t.hash AS root, sha256(proof) AS proof_sha256, e.hash AS folded_root, e.hash = t.hash AS verified
FROM leaves JOIN subroots AS s USING (tree) JOIN rise_end AS e USING (row_no), (SELECT hash FROM top WHERE size = 1) AS t
"""
