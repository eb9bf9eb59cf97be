"""Similarity join of word shingles by parity sketches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import FILE_TEXTS, fresh, stored
from slotwise.llm.components import components

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Sizes of a band lie within this factor, and a block of its sketch has this many shingles at its upper end.
_BAND, _PER_BLOCK = 2, 2.6


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _C1
        x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


_MARKS = _mixed(np.arange(1, 257, dtype=np.uint64))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of A-Z-lowered words.

    Texts of fewer words have one shingle, the whole sequence; texts without
    words none.
    """
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    after = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & after)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    which = np.cumsum(~space & after) - 1
    place = np.arange(len(data)) - starts[np.maximum(which, 0)]
    with np.errstate(over="ignore"):
        bytes_ = _mixed(_MARKS[data] + place.astype(np.uint64) * _C3)
        bytes_[space] = 0
        hashes = _mixed(np.add.reduceat(bytes_, starts))
        first = np.searchsorted(starts, np.concatenate([[0], ends]))  # of every text's words
        n = len(hashes) - words + 1
        rolled = hashes[:max(n, 0)].copy()
        for k in range(1, words):
            rolled = _mixed(rolled * _C3 + hashes[k:k + max(n, 0)])
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a:b - words + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for k in range(a, b):
                    h = _mixed(h * _C3 + hashes[k:k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _text_parts(texts: Iterable[bytes], most: int = 1 << 17) -> Iterator[list[bytes]]:
    """Parts of some ``most`` bytes; a byte takes some 70 in ``shingle_sets``, which a worker keeps after."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _bands() -> list[int]:
    bounds = [1]
    while bounds[-1] < 1 << 60:
        bounds.append(bounds[-1] * _BAND)
    return bounds


_BOUNDS = np.array(_bands(), dtype=np.int64)


def block_values(shingles: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(size band, values of its blocks, whether each is weak, whether they are too few), for one or two bands.

    A shingle flips the bits of its hash in one block of the band's sketch, so
    texts whose sets differ in d shingles differ in at most d blocks. Blocks of a
    single shingle are weak: chance agrees on them more often. A text with fewer
    filled blocks than ``needed`` adds the empty ones and has to use all; of a pair
    with two such texts both do.
    """
    n = len(shingles)
    own, reach = (int(np.searchsorted(_BOUNDS, x, "right")) for x in (n, n * 5 // 4))
    out = []
    for band in sorted({own, reach}):
        blocks = int(int(_BOUNDS[band]) / _PER_BLOCK) + 2
        block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # rises with the sorted hashes
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(start, n))
        with np.errstate(over="ignore"):
            parity = np.bitwise_xor.reduceat(shingles, start)
            values = _mixed(parity ^ _mixed((block[start] * np.uint64(64) + np.uint64(band)) * _C3 + np.minimum(size, 3).astype(np.uint64)))
            weak = size < 2
            few = len(values) < needed(n)
            if few:
                empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block)
                values = np.concatenate([values, _mixed((empty * np.uint64(64) + np.uint64(band)) * _C3)])
                weak = np.concatenate([weak, np.ones(len(empty), bool)])
        out.append((band, values, weak, few))
    return out


def needed(n: int) -> int:
    """Blocks that a text of n shingles takes to the join.

    At a Jaccard similarity of 0.8, sizes a <= b <= 1.25 a differ in d <= (a + b)
    / 9 <= a / 4 shingles. Put the block values of all texts in any one order. Of
    the values of either text that stand before the first one they share, each is
    from a block in which they differ; so the first n / 4 + 1 values of both hold it.
    """
    return n // 4 + 1


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits: every shingle flips one. At least four bits a shingle, a power of two of them."""
    bits = 1 << max(8, int(4 * len(shingles) - 1).bit_length())
    at = (_mixed(shingles ^ _C3) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """No more than the shingles that only one of the two sets has; the longer sketch is folded to the shorter."""
    x, y = (np.frombuffer(s, np.uint64) for s in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _node(shingles: np.ndarray) -> int:
    """64 bits of the set: texts with equal sets are one node of the join."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(_mixed(shingles)) if len(shingles) else np.uint64(0)
        return int(_mixed(np.array([a ^ (np.uint64(len(shingles)) * _C3)]))[0].astype(np.int64))


_SENT = "part long, kind int, keys binary, nodes binary, marks binary"
_MET = ("kind int, g1 long, g2 long, members array<long>, node long, mark int, doc_id long, text_hash long, n int, "
        "band1 int, strong1 int, weak1 int, band2 int, strong2 int, weak2 int")
#: A value's mark: its band times two, and one more if it is weak; and that of a stand-in for a frequent value.
_STAND_IN = 255
#: Taken from what a text has where it has to use all its values.
_ALL = 10**9


def _send(docs: DataFrame, parts: int, frequent: int, words: int, flush: int = 400_000) -> DataFrame:
    """Block values dealt into parts, in a few long rows a task instead of a row a value."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        held = 0

        def rows() -> pd.DataFrame:
            """Sorted by value, each text once; a value frequent in this task alone goes out as such, with a stand-in."""
            v, o, s = np.concatenate(values), np.concatenate(nodes), np.concatenate(marks)
            by = np.lexsort((o, v))
            v, o, s = v[by], o[by], s[by]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            v, o, s = v[new], o[new], s[new]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            size = np.diff(np.append(start, len(v)))
            often = np.repeat(size > frequent, size)
            out = []
            if often.any():
                name = (v[often] // np.uint64(parts)).astype(np.uint32).astype(np.uint64) * np.uint64(parts) + v[often] % np.uint64(parts)
                out.append((int(v[0] % np.uint64(parts)), 1, name.tobytes(), o[often].tobytes(), s[often].tobytes()))
                stay = ~often
                stay[start[size > frequent]] = True
                s = np.where(often, _STAND_IN, s).astype(np.uint8)
                o = np.where(often, 0, o)
                v, o, s = v[stay], o[stay], s[stay]
            part = (v % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            part, v, o, s = part[by], v[by], o[by], s[by]
            edge = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
            short = (v // np.uint64(parts)).astype(np.uint32)  # a part needs no more to tell its values apart
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                out.append((int(part[a]), 0, short[a:b].tobytes(), o[a:b].tobytes(), s[a:b].tobytes()))
            return pd.DataFrame(out, columns=["part", "kind", "keys", "nodes", "marks"])

        for batch in batches:
            facts = np.full((11, len(batch)), -1, np.int64)
            facts[0] = [0 if i is None else int(i) for i in batch["doc_id"]]
            facts[1] = batch["text_hash"]
            facts[4] = [i is None for i in batch["doc_id"]]
            texts = (("" if t is None else t).encode("utf-8", "surrogatepass") for t in batch["text"])
            i = -1
            for part in _text_parts(texts):  # so that few sets are held at a time
                for found in shingle_sets(part, words):
                    i += 1
                    node = _node(found)
                    facts[2, i], facts[3, i] = node, len(found)
                    for k, (band, v, weak, few) in enumerate(block_values(found) if len(found) else []):
                        values.append(v)
                        nodes.append(np.full(len(v), node))
                        marks.append((band * 2 + weak).astype(np.uint8))
                        facts[5 + 3 * k:8 + 3 * k, i] = band, len(v) - weak.sum(), -_ALL if few else weak.sum()
                        held += len(v)
                if held >= flush:
                    yield rows()
                    values, nodes, marks, held = [], [], [], 0
            at = int(abs(int(facts[2, 0])) % parts) if len(batch) else 0
            yield pd.DataFrame({"part": [at], "kind": [2], "keys": [b""], "nodes": [facts.tobytes()], "marks": [b""]})
        if held:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, _SENT)


def _frame(rows: int, /, **columns: object) -> pd.DataFrame:
    """All columns of ``_MET``, 64-bit numbers kept exact beside missing ones."""
    names = [c.split()[0] for c in _MET.split(", ")]
    return pd.DataFrame({c: pd.Series(columns.get(c, [None] * rows), dtype=object) if c == "members"
                         else pd.array(columns.get(c, [pd.NA] * rows), "Int64") for c in names})


def _meet(sent: DataFrame, most: int) -> DataFrame:
    """Kind 0: groups of texts that share a value; 1: texts of frequent values; 2: the documents; 3: texts that share a weak value."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for facts in rows.loc[rows["kind"] == 2, "nodes"]:
            doc, text_hash, node, n, null, *counts = np.frombuffer(facts, np.int64).reshape(11, -1)
            ids = pd.array(doc, "Int64")
            ids[null.astype(bool)] = pd.NA
            out.append(_frame(len(n), kind=np.full(len(n), 2), doc_id=ids, text_hash=text_hash, node=node, n=n, **dict(zip(
                ("band1", "strong1", "weak1", "band2", "strong2", "weak2"), counts))))
        often = rows[rows["kind"] == 1]
        for keys, nodes, marks in zip(often["keys"], often["nodes"], often["marks"]):
            n = len(marks)
            out.append(_frame(n, kind=np.ones(n, np.int64), g1=np.frombuffer(keys, np.int64),
                              node=np.frombuffer(nodes, np.int64), mark=np.frombuffer(marks, np.uint8)))
        plain = rows[rows["kind"] == 0]
        if len(plain):
            v = np.frombuffer(b"".join(plain["keys"]), np.uint32)
            o = np.frombuffer(b"".join(plain["nodes"]), np.int64)
            s = np.frombuffer(b"".join(plain["marks"]), np.uint8)
            by = np.argsort(v, kind="stable")
            v, o, s = v[by], o[by], s[by]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            several = np.repeat(np.diff(np.append(start, len(v))) > 1, np.diff(np.append(start, len(v))))
            v, o, s = v[several], o[several], s[several]
            by = np.lexsort((o, v))
            v, o, s = v[by], o[by], s[by]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
            v, o, s = v[new], o[new], s[new]
            if len(v):
                start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                size = np.diff(np.append(start, len(v)))
                stand_in = (o == 0) & (s == _STAND_IN)
                frequent = (np.add.reduceat(stand_in, start) > 0) | (size > most)
                weak = ~frequent & (s[start] % 2 == 1) & (size > 1)
                whole = v.astype(np.uint64) * np.uint64(int(key[1])) + np.uint64(int(key[0]))
                for kind, which in ((1, frequent), (3, weak)):
                    rest = np.repeat(which, size) & ~stand_in
                    n = int(rest.sum())
                    out.append(_frame(n, kind=np.full(n, kind), g1=whole[rest].view(np.int64), node=o[rest], mark=s[rest]))
                with np.errstate(over="ignore"):
                    m = _mixed(o.view(np.uint64))
                    g1 = np.add.reduceat(m, start).view(np.int64)
                    g2 = np.bitwise_xor.reduceat(_mixed(m + _C3), start).view(np.int64)
                take = np.flatnonzero(~frequent & ~weak & (size > 1))
                take = take[np.unique(np.stack([g1[take], g2[take]]), axis=1, return_index=True)[1]] if len(take) else take
                n = len(take)
                out.append(_frame(n, kind=np.zeros(n, np.int64), g1=g1[take], g2=g2[take],
                                  members=[o[a:a + k] for a, k in zip(start[take], size[take])]))
        return pd.concat([_frame(0), *out], ignore_index=True)

    return sent.groupBy("part", "parts").applyInPandas(run, _MET)


def _grouped(met: DataFrame) -> DataFrame:
    """(g1, g2, u, v, w): members v of every group, and the member u of most rows, w."""
    each = met.filter("kind = 2").select("node", "n", F.explode(F.array(
        *[F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("band", "strong", "weak")]) for k in (1, 2)])).alias("b"))
    each = each.filter("b.band >= 0").select("node", "b.band", F.expr("n div 4 + 1").alias("need"), "b.strong", "b.weak").distinct()
    shared = met.filter("kind in (1, 3)").select(
        "kind", "g1", "node", F.shiftright("mark", 1).alias("band"), (F.col("mark") % 2).alias("low")).distinct()
    often = shared.filter("kind = 1")
    lost = often.groupBy("node", "band").agg(F.sum(1 - F.col("low")).alias("ls"), F.sum("low").alias("lw"))
    left = each.join(lost, ["node", "band"], "left").na.fill(0, ["ls", "lw"])
    # Texts whose values at most ``frequent`` texts share, strong ones, do not suffice; and how many frequent ones they need.
    unsure = stored(left.filter("strong - ls < need").select(
        "node", "band", F.expr("need - (strong - ls) - (weak - lw)").alias("want")), "unsure", most=2 * met.filter("kind = 2").count())
    number = often.groupBy("g1").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("node", "band").orderBy("c", "g1"))  # a text's own values
    used = often.join(unsure.filter("want > 0"), ["node", "band"]).join(number, "g1").withColumn("rank", rank).filter("rank <= want")
    weak = shared.filter("kind = 3").join(unsure, ["node", "band"])
    groups = met.filter("kind = 0").select("g1", "g2", "members").dropDuplicates(["g1", "g2"])
    zero = F.lit(0).cast("long").alias("g2")
    number_of = F.when(F.col("kind") == 0, F.size("members")).when(F.col("kind").isin(1, 3), 1)
    most = met.agg(F.sum(number_of).alias("n")).first()["n"] or 0
    rows = stored(groups.select("g1", "g2", F.explode("members").alias("v")).unionByName(
        used.select("g1", zero, F.col("node").alias("v"))).unionByName(
        weak.select("g1", zero, F.col("node").alias("v"))), "met-rows", "zstd", most=most)
    n = rows.count()
    weight = rows.groupBy("v").agg(F.count("*").alias("w"))
    hubs = stored(rows.join(weight, "v").groupBy("g1", "g2").agg(
        F.max(F.struct("w", "v")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("g1", "g2", "m.w", F.col("m.v").alias("u")), "hubs", most=n)
    return stored(rows.join(hubs, ["g1", "g2"]), "stars-of-groups", "zstd", most=n)


class _Texts:
    """Texts of the nodes in question, ``most`` of them, for checking pairs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, facts: DataFrame, words: int, most: int):
        chosen = facts.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("p")).select(
            F.col("p.doc_id").alias("_id"), F.col("p.text_hash").alias("_hash"), "node")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                data = [z.compress(("" if t is None else t).encode("utf-8", "surrogatepass")) for t in batch["text"]]
                yield batch.drop(columns="text").assign(packed=data)

        packed = docs.select(F.col("doc_id").cast("long").cast("string"), F.xxhash64("text").alias("text_hash"), "text").mapInPandas(
            pack, "doc_id string, text_hash long, packed binary").withColumn("doc_id", F.col("doc_id").cast("long"))
        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = zstandard.ZstdDecompressor()
            for batch in batches:
                sets = [s for part in _text_parts([z.decompress(p) for p in batch["packed"]]) for s in shingle_sets(part, words)]
                yield batch.assign(size=[len(s) for s in sets], sketch=[sketch(s) for s in sets])

        same = packed["text_hash"].eqNullSafe(chosen["_hash"]) & packed["doc_id"].eqNullSafe(chosen["_id"])
        self.table = stored(packed.join(chosen, same).select("node", "packed").dropDuplicates(["node"]).mapInPandas(
            measure, "node long, packed binary, size long, sketch binary"), "near-texts", most=most, task_rows=FILE_TEXTS)

    def near(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (u, v) that sizes and sketches do not rule out."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hit = [(100 + percent) * differing_bits(x, y) <= (100 - percent) * (a + b)
                       for x, y, a, b in zip(batch["x"], batch["y"], batch["a"], batch["b"])]
                yield batch.loc[hit, ["u", "v"]]

        a = self.table.select(F.col("node").alias("u"), F.col("size").alias("a"), F.col("sketch").alias("x"))
        b = self.table.select(F.col("node").alias("v"), F.col("size").alias("b"), F.col("sketch").alias("y"))
        sized = pairs.join(b, "v").join(a, "u").filter(100 * F.least("a", "b") >= percent * F.greatest("a", "b"))
        return sized.select("u", "v", "a", "b", "x", "y").mapInPandas(run, "u long, v long")

    def linked(self, pairs: DataFrame, words: int, percent: int, most: int) -> DataFrame:
        """The pairs (u, v), of ``most``, whose sets are alike: sketches first, then the whole sets."""
        pairs = self.near(pairs, percent)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = zstandard.ZstdDecompressor()
            kept: dict[int, np.ndarray] = {}
            for batch in batches:
                hit = []
                for u, v, a, b in zip(batch["u"], batch["v"], batch["a"], batch["b"]):
                    if u not in kept:
                        kept = {u: shingle_sets([z.decompress(a)], words)[0]}  # the hub of a star stays
                    x, y = kept[u], shingle_sets([z.decompress(b)], words)[0]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.loc[hit, ["u", "v"]]

        return stored(self._with_texts(pairs).mapInPandas(run, "u long, v long"), "links", most=most, task_rows=FILE_TEXTS)

    def _with_texts(self, pairs: DataFrame, *more: str) -> DataFrame:
        a = self.table.select(F.col("node").alias("u"), F.col("packed").alias("a"))
        b = self.table.select(F.col("node").alias("v"), F.col("packed").alias("b"))
        return pairs.join(b, "v").join(a, "u").select("u", "v", *more, "a", "b")

    def differences(self, around: DataFrame, words: int, percent: int, most: int = 1 << 18) -> DataFrame:
        """The shingles by which nodes v differ from their hub u, as many as ``_needed_differences`` takes.

        A key stands for the hub, the shingle and whether the node or the hub has
        it; rest counts the node's differences of this kind from here on, rare ones
        first (``_order``); hub is the hub's size where the node lacks the
        shingle, else -1.
        """
        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
            z = zstandard.ZstdDecompressor()
            kept: dict[int, np.ndarray] = {}
            for batch in batches:
                for u, v, failed, a, b in zip(batch["u"], batch["v"], batch["failed"], batch["a"], batch["b"]):
                    if u not in kept:
                        kept = {u: shingle_sets([z.decompress(a)], words)[0]}
                    yield u, v, bool(failed), kept[u], shingle_sets([z.decompress(b)], words)[0]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(1 << _CELL_BITS, np.int64)
            for u, _, _, x, y in sets(batches):
                for cells in _difference_cells(u, x, y, percent):
                    n += np.bincount(cells, minlength=len(n))
            at = np.flatnonzero(n)
            yield pd.DataFrame({"cell": at, "n": n[at]})

        pairs = self._with_texts(around, "failed")
        often = np.zeros(1 << _CELL_BITS, np.int64)
        for cell, n in pairs.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").collect():
            often[cell] = n
        counts = around.sparkSession.sparkContext.broadcast(often)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out: list[pd.DataFrame] = []
            held = 0
            for u, v, failed, x, y in sets(batches):
                for role, rest, keys, common, hub in _needed_differences(u, x, y, failed, percent, counts.value):
                    out.append(pd.DataFrame({"key": keys.view(np.int64), "role": role, "node": v, "size": len(y), "common": common,
                                             "rest": rest, "hub": hub}))
                    held += len(keys)
                if held >= most:
                    yield pd.concat(out, ignore_index=True)
                    out, held = [], 0
            if out:
                yield pd.concat(out, ignore_index=True)

        return pairs.mapInPandas(run, "key long, role int, node long, size int, common int, rest int, hub int")


#: What a node does with a difference: look for others, be found, or both.
_SEEKS, _FOUND, _BOTH = 1, 2, 3


#: Differences are counted in so many cells (2 to this power), whatever the table's size.
_CELL_BITS = 16


def _difference_keys(u: int, found: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(found ^ _mixed(np.array([u], np.int64).view(np.uint64) * _C3 + np.uint64(salt)))


def _cells(u: int, found: np.ndarray, lacks: bool) -> np.ndarray:
    return (_difference_keys(u, found, int(lacks)) >> np.uint64(64 - _CELL_BITS)).astype(np.int64)


def _difference_cells(u: int, hub: np.ndarray, own: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Cells of the differences that ``_needed_differences`` chooses from."""
    more = np.setdiff1d(own, hub, assume_unique=True)
    yield _cells(u, more, False)
    if 100 * (len(own) - len(more)) >= percent * len(own):
        yield _cells(u, np.setdiff1d(hub, own, assume_unique=True), True)


def _order(u: int, found: np.ndarray, lacks: bool, often: np.ndarray | None) -> np.ndarray:
    """Differences by how often their cell occurs, then by hash: one order for all nodes around a hub.

    Any one order is exact. With rare ones first, a passage that many nodes have
    beside the hub comes last, and brings nodes together only if they share little else.
    """
    return found if often is None else found[np.argsort(often[_cells(u, found, lacks)], kind="stable")]


def _needed_differences(u: int, hub: np.ndarray, own: np.ndarray, failed: bool, percent: int, often: np.ndarray | None = None,
                        ) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """(role, rest, keys, shingles shared with the hub, hub's size or -1) of the differences by which a node that failed meets all it could link to.

    Let x and y have a and b shingles and share p and q of the c of their hub. They
    link if they share s (a + b) or more, s = percent / (100 + percent); then
    neither size is below r = percent / 100 of the other, so s (a + b) is at least
    r a and r b. Of two sets that share k elements or more, in any one order, the
    first n - k + 1 of each hold a shared one.

    - They share shingles outside the hub: at least r a - p, and r b - q, since
      they share no more than p, nor q, inside it.
    - They share none outside: all of s (a + b) is in the hub, so p is at least
      r a and q at least r b. The hub's shingles that both lack number at least
      k = c - p - q + s (a + b). If x failed, p < s (a + c), so b < c. With
      D = b + c - 2 q, the differences of y, k is more than s D >= 0: both sums of
      differences less what may differ, halved, and x has more than may differ
      from the hub. For x, k is least where b is as near to c as sizes allow.
      Sizes are matched by bins of c / 16, so that only those below p / s - a meet.
    """
    a, c = len(own), len(hub)
    more = _order(u, np.setdiff1d(own, hub, assume_unique=True), False, often)
    less = _order(u, np.setdiff1d(hub, own, assume_unique=True), True, often)
    p, whole = a - len(more), 100 + percent

    def keys(found: np.ndarray, salt: int) -> np.ndarray:
        return _difference_keys(u, found, salt)

    def rest(found: np.ndarray, n: int) -> np.ndarray:
        return len(found) - np.arange(n)

    take = len(more) - max(1, -(-percent * a // 100) - p) + 1
    if take > 0 and len(more):
        yield _BOTH if failed else _FOUND, rest(more, take), keys(more[:take], 0), p, -1
    if 100 * p < percent * a:
        return
    width = max(1, c // 16)
    take = len(less) - percent * (a + c - 2 * p) // whole
    if a < c and take > 0:
        yield _FOUND, rest(less, take), keys(less[:take], 1 + a // width), p, c
    low, high = -(-percent * a // 100), min(c - 1, whole * p // percent - a)
    if failed and low <= high and len(less):
        near = min(max(c, low), 100 * a // percent)
        k = max(1, -((whole * -(a + c - 2 * p + abs(c - near)) + (100 - percent) * (a + near)) // (2 * whole)))
        take = len(less) - k + 1
        for size in range(low // width, high // width + 1) if take > 0 else ():
            yield _SEEKS, rest(less, take), keys(less[:take], 1 + size), p, c


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, parts: int | None = None,
                    frequent: int = 16, few: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, text_hash, label.

    Texts link at a Jaccard similarity of at least ``percent`` (80 or more); the
    component is named by the smallest doc_id that links reach.

    1. Every text sends the values of its sketch's blocks (``block_values``) in its
       size band to parts dealt by value; texts with equal sets are one node.
    2. Texts that share a value form a group. Values are in one order: first those
       of at most ``frequent`` texts, strong ones before weak, then the others by
       their number of texts. Of this order a text uses no more than the first
       values that it needs to be sure of every partner (``needed``), so a passage
       of many texts brings candidates only where a text has little else.
    3. In a group pairs with the node that shares most values, the hub, are
       checked: by size, by sketch (the bits that differ are no more than the
       shingles that do), and what is left over whole sets. A node that fails and
       stays in another component can still link to others around the hub. Where
       at most ``few`` nodes failed, each is checked with those in other
       components, so pairs grow with the hub's nodes. Around other hubs such
       pairs differ from the hub in the same shingles (``_needed_differences``):
       nodes meet by their rarest differences from it, and only those that share enough
       of them are checked. Nothing that could link is left out either way, and
       neither copies of one text nor texts that each went their own way from it
       cost the square of their number.

    Null and empty texts have no shingles and are their own component; an empty
    table gives no rows, and columns other than doc_id and text are not read. Rows that
    repeat a doc_id and text share a result; a null doc_id is named by the
    smallest other id of its component, or null. Ids need not tell components
    apart; label does, but for texts without words, which share one.
    """
    if percent < 80:
        raise ValueError("the sketches are laid out for similarities of 80 percent and more")
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    met = stored(_meet(_send(docs, parts, frequent, words).withColumn("parts", F.lit(parts).cast("long")), frequent), "met", "zstd",
                 most=n, task_rows=FILE_TEXTS)
    facts = met.filter("kind = 2").select("doc_id", "text_hash", "node", "n")
    rows = _grouped(met)
    texts = _Texts(docs, rows.select(F.col("v").alias("node")).distinct(), facts, words, n)

    stars = stored(rows.filter("u <> v").groupBy("u", "v").agg(F.max("w").alias("w")), "stars", most=rows.count())
    first = stars.groupBy("v").agg(F.max(F.struct("w", "u")).alias("m")).select("m.u", "v")
    stars, most = stars.select("u", "v"), stars.count()
    links = texts.linked(first, words, percent, min(n, most))
    labels = _components(links)
    more = _apart(stars.join(first, ["u", "v"], "left_anti"), labels).select("u", "v")
    more = texts.linked(more, words, percent, most)
    links = stored(links.unionByName(more), "links", most=links.count() + more.count())
    labels = _components(links)

    around = _around_hubs(rows, labels, facts)
    crowded = around.groupBy("u").agg(F.sum(F.col("failed").cast("int")).alias("k"), F.count("*").alias("n")).filter(F.col("k") > few)
    most = crowded.agg(F.sum("n").alias("n")).first()["n"] or 0
    crowded = crowded.select("u")
    apart = _labelled(texts.differences(around.join(crowded, "u", "left_semi"), words, percent), labels, "node")
    apart = stored(apart, "differences", "zstd", most=most, task_rows=FILE_TEXTS)  # some dozens of a node
    again = _could_link(apart, percent).unionByName(
        _beside_failed(around.join(crowded, "u", "left_anti"), percent)).withColumn("seen", F.lit(False)).unionByName(
        stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("seen")))
    # Not an anti join, which Spark would put before the aggregate, over every row of a pair.
    again = stored(again.groupBy("u", "v").agg(F.max("seen").alias("seen")).filter("NOT seen").drop("seen"), "again")
    most = again.count()
    if most:
        links = links.unionByName(texts.linked(again, words, percent, most))
        labels = _components(links)

    named = facts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "label")


def _components(links: DataFrame) -> DataFrame:
    """(node, label) of stored links, whose files tell their number."""
    n = links.count()
    return stored(components(links, most=n), "labels", most=2 * n)


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    name = f"l{column}"
    own = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return rows.join(own, F.col(column) == F.col("_n"), "left").withColumn(name, F.coalesce("_l", column)).drop("_n", "_l")


def _apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (u, v) whose nodes are in different components."""
    return _labelled(_labelled(rows, labels, "u"), labels, "v").filter("lu <> lv")


def _around_hubs(rows: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """(u, v, failed, lv, n): nodes v of groups in which one failed against the hub u and two are in different components."""
    n = rows.count()
    seen = stored(_labelled(_labelled(rows.filter("u <> v"), labels, "u"), labels, "v").select(
        "g1", "g2", "u", "v", (F.col("lu") != F.col("lv")).alias("failed"), "lv"), "around", most=n)
    mixed = seen.groupBy("g1", "g2").agg(F.max("failed").alias("any"), F.min("lv").alias("l1"), F.max("lv").alias("l2")).filter(
        "any and l1 <> l2").select("g1", "g2")
    sizes = facts.select(F.col("node").alias("v"), "n").distinct()
    return stored(seen.join(mixed, ["g1", "g2"], "left_semi").groupBy("u", "v", "lv").agg(F.max("failed").alias("failed")).join(
        sizes, "v"), "around-hubs", most=n)


def _beside_failed(around: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of a node that failed against a hub and another around it, in different components, of sizes that could link."""
    x, y = (around.select(F.col("u").alias(f"hub_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("v", "lv", "n", "failed")])
            for side in "xy")
    met = x.filter("failed_x").join(y, F.col("hub_x") == F.col("hub_y")).filter(
        (F.col("lv_x") != F.col("lv_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (
            ~F.col("failed_y") | (F.col("v_x") < F.col("v_y"))))
    return met.select(F.least("v_x", "v_y").alias("u"), F.greatest("v_x", "v_y").alias("v"))


def _could_link(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in different components that share a difference early enough to share as many as a link takes."""
    def side(name: str, *roles: int) -> DataFrame:
        return apart.filter(F.col("role").isin(*roles)).select(
            "key", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "lnode", "role", "size", "common", "rest", "hub")])

    both = percent * (F.col("size_x") + F.col("size_y"))
    least = (100 + percent) * F.least("common_x", "common_y")
    # What a link has to share beside the hub's shingles, or lack of them, is there from this difference on.
    outside = both - least <= (100 + percent) * F.least("rest_x", "rest_y")
    lacking = both + (100 + percent) * (F.col("hub_x") - F.col("common_x") - F.col("common_y")) <= (100 + percent) * F.least("rest_x", "rest_y")
    enough = F.when(F.col("hub_x") < 0, outside).otherwise((least >= both) & lacking)
    sized = 100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y")
    once = (F.col("role_x") != _BOTH) | (F.col("role_y") != _BOTH) | (F.col("node_x") < F.col("node_y"))
    met = side("x", _SEEKS, _BOTH).join(side("y", _FOUND, _BOTH), "key").filter(
        (F.col("lnode_x") != F.col("lnode_y")) & (F.col("hub_x") == F.col("hub_y")) & sized & enough & once)
    return met.select(F.least("node_x", "node_y").alias("u"), F.greatest("node_x", "node_y").alias("v"))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, a null one only where there is no other.

    Texts without words are kept; of rows that repeat an id and text one is.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), **options)
    blank = F.col("n_shingles") == 0
    keep = judged.groupBy("label", F.when(blank, F.col("doc_id")).alias("_own_id"), F.when(blank, F.col("text_hash")).alias("_own")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    kept = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(keep["_hash"]), "left_semi")
    own = fresh(docs, "own_hash")
    return kept.withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own]).drop(own)
