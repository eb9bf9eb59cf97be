"""Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof per row."""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import ascii_lower, stored
from slotwise.session import sized

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, level int, place long, digest string"
_TOP = "root"


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    coded = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*coded), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes up to the first that has one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class LabelQueue:
    """An external priority queue of messages: the least label first, in memory up to ``limit`` of them.

    What is more goes to sorted runs in a file of the task's own, which no other task reads.
    """

    def __init__(self, limit: int = 1 << 16):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                pickle.dump(m, file)
            file.seek(0)
            self.heap = []
            self._refill(file)

    def _refill(self, file) -> None:
        try:
            self.runs.append((pickle.load(file), len(self.runs), file))
            heapq.heapify(self.runs)
        except EOFError:
            file.close()

    def least(self) -> tuple | None:
        heads = ([self.heap[0]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, _, file = heapq.heappop(self.runs)
            self._refill(file)
            return message
        return heapq.heappop(self.heap)


def rising(nodes: Iterator[tuple[int, str]], levels: int, arity: int, limit: int = 1 << 16) -> Iterator[tuple[int, int, list[str]]]:
    """(level, place, children) of every node above ``nodes`` (place, digest), in the order of its label (level, place).

    Time-forward processing: a node sends its digest to its parent through the
    queue, which hands messages over in the order of their labels, so all of a
    node's children are there when its turn comes. Nodes of level 0 are the input.
    """
    queue = LabelQueue(limit)
    if levels:
        for place, digest in nodes:
            queue.push((1, place // arity, place % arity, digest))
    while (head := queue.least()) is not None:
        level, place, children = head[0], head[1], []
        while (head := queue.least()) is not None and head[:2] == (level, place):
            children.append(queue.pop()[3])
        if level < levels:
            queue.push((level + 1, place // arity, place % arity, _digest(children)))
        yield level, place, children


def falling(nodes: list[tuple[int, str]], levels: int, arity: int, proof: str, path: list[int],
            limit: int = 1 << 16) -> Iterator[tuple[int, str, list[int]]]:
    """(place, proof, path) of every one of ``nodes``, given those of their common top.

    The reversed sweep: labels run backwards, every node sends its children their
    siblings and its own suffix behind them. A path has two numbers a level: the
    siblings to the left, and all siblings.
    """
    runs = {(level, place): children for level, place, children in rising(iter(nodes), levels, arity, limit)}
    if not levels:
        yield nodes[0][0], proof, path
        return
    queue = LabelQueue(limit)
    top = max(runs)
    queue.push((-top[0], -top[1], proof, path))
    while queue.least() is not None:
        level, place, suffix, above = queue.pop()
        level, place = -level, -place
        children = runs[level, place]
        for k, _ in enumerate(children):
            siblings = "".join(children[:k] + children[k + 1:])
            mine, way = siblings + suffix, [k, len(children) - 1, *above]
            child = place * arity + k
            if level > 1:
                queue.push((1 - level, -child, mine, way))
            else:
                yield child, mine, way


def _numbered(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in each tree in the order of ``keys``, and ``nodes``, the tree's number of rows.

    Range slices are numbered one by one and then moved by the rows of the tree in
    earlier slices, so a tree of any size is dealt out. ``rows`` has to be read
    from files, with keys that tell all rows apart.
    """
    kind = rows.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for t in batch.column(tree).to_pylist():
                n = n + 1 if t == last else 0
                last = t
                at.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([piece] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "slice", "inner"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    sliced = stored(rows.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(
        number, f"{columns}, slice int, inner long"), "slices", "zstd")
    counts = sliced.groupBy(tree, "slice").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(tree)  # a row a slice at most
    before = counts.select(F.col(tree).alias("_t"), F.col("slice").alias("_s"), F.sum("c").over(whole).alias("nodes"), (
        F.sum("c").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("_before"))
    return sliced.join(sized(before), (F.col(tree) == F.col("_t")) & (F.col("slice") == F.col("_s"))).withColumn(
        "place", F.col("inner") + F.col("_before")).drop("_t", "_s", "_before", "slice", "inner")


class Forest:
    """Trees over numbered leaves (tree, place, nodes, digest, and more), block by block.

    A block is ``block_levels`` levels of a tree, so no task holds more than
    ``arity ** block_levels`` nodes of one; the tops of blocks are the leaves of
    the next layer. Layers grow with the logarithm of the largest tree.
    """

    def __init__(self, leaves: DataFrame, arity: int, block_levels: int, limit: int):
        self.arity, self.block_levels, self.limit = arity, block_levels, limit
        self.layers = [leaves]
        tallest = leaves.agg(F.max("nodes")).first()[0] or 0
        self.levels = height(tallest, arity)
        for base in range(0, self.levels, block_levels):
            self.layers.append(self._raised(self.layers[-1], base))

    def _block(self) -> Column:
        return F.expr(f"place div {self.arity ** self.block_levels}")

    def _raised(self, nodes: DataFrame, base: int) -> DataFrame:
        """The tops of the blocks of ``nodes``, which are ``base`` levels above the leaves."""
        arity, most, limit = self.arity, self.block_levels, self.limit

        def sweep(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("place")
            first, total = rows["place"][0].as_py(), rows["nodes"][0].as_py()
            levels = min(most, max(height(total, arity) - base, 0))
            digest, place = rows["digest"][0].as_py(), first // arity ** levels
            for level, _, children in rising(zip(rows["place"].to_pylist(), rows["digest"].to_pylist()), levels, arity, limit):
                if level == levels:
                    digest = _digest(children)
            return pa.table({"tree": [rows["tree"][0].as_py()], "place": [place], "nodes": [total], "digest": [digest]})

        return stored(nodes.select("tree", "place", "nodes", "digest", self._block().alias("block")).groupBy("tree", "block").applyInArrow(
            sweep, "tree string, place long, nodes long, digest string"), "tops")

    def roots(self) -> DataFrame:
        """(tree, nodes, digest), a row a tree."""
        return self.layers[-1].select("tree", "nodes", "digest")

    def proofs(self, tops: DataFrame, keep: list[str]) -> DataFrame:
        """Leaves (tree, digest, ``keep``) with proof and path, given those of every tree's root (tree, proof, path, and more)."""
        most = self.block_levels
        carried = [f for f in tops.schema if f.name not in ("tree", "proof", "path")]
        suffixes = tops.withColumn("block", F.lit(0).cast("long"))
        for layer in range(max(len(self.layers) - 2, 0), -1, -1):
            nodes, base = self.layers[layer], layer * most
            columns = ["tree", "place", "nodes", "digest", *(keep if layer == 0 else [])]

            kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema, *carried]}
            schema = ", ".join(f"{c} {kinds[c]}" for c in [*columns, *[f.name for f in carried]])
            left = nodes.select(*columns, self._block().alias("block")).groupBy("tree", "block")
            swept = left.cogroup(suffixes.groupBy("tree", "block")).applyInArrow(
                self._lowered(base, columns, [f.name for f in carried]), f"{schema}, proof string, path array<int>")
            if layer == 0:
                return swept
            # A node of this layer is the top of the block with its number, one layer below.
            suffixes = stored(swept.select("tree", F.col("place").alias("block"), *[f.name for f in carried], "proof", "path"), "suffixes", "zstd")
        raise AssertionError

    def _lowered(self, base: int, columns: list[str], carried: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """The nodes of a block with proofs and paths, given those of its top."""
        arity, most, limit = self.arity, self.block_levels, self.limit

        def sweep(rows: pa.Table, above: pa.Table) -> pa.Table:
            rows = rows.sort_by("place")
            levels = min(most, max(height(rows["nodes"][0].as_py(), arity) - base, 0))
            found = sorted(falling(list(zip(rows["place"].to_pylist(), rows["digest"].to_pylist())), levels, arity,
                                   above["proof"][0].as_py(), above["path"][0].as_py(), limit))
            same = {c: pa.array([above[c][0].as_py()] * len(rows), above[c].type) for c in carried}
            return pa.table({**{c: rows[c] for c in columns}, **same, "proof": pa.array([p for _, p, _ in found], pa.string()),
                             "path": pa.array([w for _, _, w in found], pa.list_(pa.int32()))})

        return sweep


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = 8,
             block_levels: int = 4, limit: int = 1 << 16, more: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: the group and order columns, leaf, subroot, root, proof and path, and the columns of ``more``.

    Leaves are digests of ``fields``; per group they ascend by ``order`` and every
    ``arity`` consecutive nodes become their digest until one, the subroot, is
    left. Subroots, ordered by group (null first, UTF-8 bytewise), likewise give
    the root. The proof is the siblings' digests in hex, level by level, left to
    right; the path says how many of a level's siblings stand to the left, and how
    many there are. ``fold`` leads from a leaf to the root.

    Time-forward processing: nodes are labelled by level and place; digests travel
    up to parents in the order of labels, and proofs travel down in the reverse
    order. Between blocks of a tree Spark's sorted exchange carries the messages,
    in a block the queue does, which goes to disk beyond ``limit`` messages.

    Null ids come first, equal ids are ordered by leaf; equal rows are leaves of
    their own. Null and empty texts differ (``-`` and ``0:``). Texts are digested
    where they are read and never shuffled. A group of a third of all rows is many
    blocks. An empty table gives no rows. Other columns are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    more = more or {}
    leaves = stored(docs.select(
        tree.alias("tree"), F.col(order).cast("long").alias("position"), leaf_digest(*[F.col(c) for c in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("tie"), *[c.alias(name) for name, c in more.items()]), "leaves", "zstd")
    numbered = stored(_numbered(leaves, ["tree", "position", "digest", "tie"], "tree").drop("tie"), "numbered", "zstd")
    forest = Forest(numbered, arity, block_levels, limit)
    subroots = forest.roots().select(F.col("tree").alias("member"), "digest", F.lit(_TOP).alias("tree"))
    tops = stored(_numbered(stored(subroots, "subroots"), ["tree", "member"], "tree"), "numbered")
    crown = Forest(tops, arity, block_levels, limit)
    start = crown.roots().select("tree", F.col("digest").alias("root"), F.lit("").alias("proof"), F.array().cast("array<int>").alias("path"))
    groups = crown.proofs(start, ["member"]).select(
        F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "proof", "path")
    rows = forest.proofs(stored(groups, "groups"), ["position", *more])
    name = F.when(F.col("tree") != "n", F.expr("substring(tree, 2)")).alias(group)
    return rows.select(F.col("position").alias(order), name, F.col("digest").alias("leaf"), "subroot", "root", "proof", "path", *more)


def fold(leaf: Column, proof: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to beside the siblings of its proof."""
    def step(state: Column, level: Column) -> Column:
        left, others = F.get(path, 2 * level), F.get(path, 2 * level + 1)
        here = state["at"]
        before = F.substring(proof, here, left * 64)
        after = F.substring(proof, here + left * 64, (others - left) * 64)
        return F.struct(F.sha2(F.concat(before, state["digest"], after), 256).alias("digest"), (here + others * 64).alias("at"))

    levels = F.when(F.size(path) > 0, F.sequence(F.lit(0), F.expr("1").cast("int") * (F.size(path) / 2).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(levels, F.struct(leaf.alias("digest"), F.lit(1).alias("at")), step)["digest"]


def tamper_check(docs: DataFrame, **options: object) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 3 divides the CRC-32 of the decimal doc_id, A-Z of the text are
    lower-cased before the proof is checked; rows without id are left as they are.
    """
    changed = leaf_digest(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, more={"tampered": F.when(hit, changed)}, **options)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_levels(rows: str, start: int, levels: int) -> str:
    """Levels of ``rows`` (g, i, d, proof, h and more): siblings of each row's node go to its proof and its fold h."""
    out, cur = [], rows
    for k in range(start, start + levels):
        out.append(f"""n{k} AS (SELECT g, i // 8 AS p, list(d ORDER BY i) AS run, sum(count(*)) OVER (PARTITION BY g) AS n
  FROM (SELECT DISTINCT g, i, d FROM {cur}) GROUP BY g, i // 8),
r{k} AS (SELECT {cur}.* EXCLUDE (i, d, proof, h), {cur}.i // 8 AS i,
  CASE WHEN n = 1 THEN {cur}.d ELSE sha256(array_to_string(run, '')) END AS d,
  proof || array_to_string(run[1:({cur}.i % 8)::INT] || run[({cur}.i % 8 + 2)::INT:], '') AS proof,
  CASE WHEN n = 1 THEN h ELSE sha256(array_to_string(run[1:({cur}.i % 8)::INT] || [h] || run[({cur}.i % 8 + 2)::INT:], '')) END AS h
  FROM {cur} JOIN n{k} ON {cur}.g = n{k}.g AND {cur}.i // 8 = n{k}.p)""")
        cur = f"r{k}"
    return ",\n".join(out)


_SQL_LEAF = " || ".join(f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
                        for v in ("doc_id", "source", "lang", "n_chars", "{text}"))
SQL = f"""
WITH tab AS (SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t
  FROM (SELECT unnest(range(256)) AS x)),
base AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce(xor(list_reduce(
  list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit FROM documents, tab),
leaves AS (SELECT doc_id, coalesce('v' || lang, 'n') AS g, sha256({_SQL_LEAF.format(text="text")}) AS leaf,
  sha256({_SQL_LEAF.format(text="low")}) AS tampered, hit FROM base),
start AS (SELECT doc_id, leaf, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, '' AS proof,
  CASE WHEN hit THEN tampered ELSE leaf END AS h FROM leaves),
{_sql_levels("start", 0, 8)},
tops AS (SELECT * EXCLUDE (g, i, d), 'root' AS g, dense_rank() OVER (ORDER BY g) - 1 AS i, d, d AS subroot FROM r7),
{_sql_levels("tops", 8, 4)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = d AS verified FROM r11
"""
