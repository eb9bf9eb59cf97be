"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

_RUN = re.compile(r"[^\W\d_]+")
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The longest n-grams; a word stands between two marks in them.
LONGEST, _MARK = 4, ord("_")
#: The lowest bits of a key tell what it is of: 0 a word, n an n-gram.
_KIND = np.uint64(7)

_UNITS = ("block long, part int, keys binary, langs array<string>, counts binary, docs binary, words binary, ids binary, "
          "sizes binary, index binary, times binary")
_ANSWERS = "block long, langs array<string>, keys binary, counts binary, kind int, lang string, total long, values long"


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _C1
        x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed with equal bytes of neighbours side by side."""
    return zstandard.compress(np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T).tobytes(), 3)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Of ascending keys."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, np.uint64), dtype=np.uint64)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for run in _RUN.findall(text.lower()) for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Keys:
    """Of distinct words: the key of each, and those of their n-grams with the word of each."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("_".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum([0] + [len(w) + 1 for w in words])  # of the marks
        self.words = self._tagged(self._folded(codes, ends), 0)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mark = codes == _MARK
        owner = np.cumsum(mark) - 1  # a mark opens the word after it
        rolled = codes + np.uint64(1)
        for n in range(1, LONGEST + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    rolled = _mixed(rolled[:-1] * _C3 + codes[n - 1:] + np.uint64(1))
            here = len(rolled)
            inner = np.zeros(here, np.int32)
            for k in range(1, n - 1):
                inner += mark[k:k + here]
            if n == 1:
                fits = ~mark
            else:  # no mark inside, and not a mark and nothing else; a mark at both ends is a word of n - 2 letters
                fits = inner == 0
                fits &= ~(mark[:here] & mark[n - 1:n - 1 + here] & (n == 2))
            at = np.flatnonzero(fits)
            self.grams[n] = self._tagged(_mixed(rolled[at]), n), owner[at]

    @staticmethod
    def _tagged(keys: np.ndarray, kind: int) -> np.ndarray:
        return (keys & ~_KIND) | np.uint64(kind)

    @staticmethod
    def _folded(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(ends) < 2:
            return np.zeros(0, np.uint64)
        place = np.arange(len(codes), dtype=np.int64)
        place[:] -= np.repeat(ends, np.diff(np.append(ends, len(codes))))
        with np.errstate(over="ignore"):
            each = _mixed(codes * _C1 + place.astype(np.uint64) * _C3)
            each[ends] = 0
            return _mixed(np.add.reduceat(each, ends[:-1]))


class _Block:
    """Documents of one map task, with their words as places in the block's vocabulary."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.sizes, self.index, self.times = [], [], array("I"), array("I")
        self.learned: dict[str, Counter] = {}
        self.held: Counter = Counter()
        self.chars = self.letters = 0

    def add(self, doc_id: int | None, text: str | None, lang: str | None) -> None:
        counts = Counter(words_of(text or ""))
        known = len(self.place)
        at = [self.place.setdefault(w, len(self.place)) for w in counts]
        self.letters += sum(len(w) for w, k in zip(counts, at) if k >= known)
        self.ids.append(doc_id)
        self.sizes.append(len(at))
        self.index.extend(at)
        self.times.extend(counts.values())
        if lang is not None:
            self.learned.setdefault(lang, Counter()).update(dict(zip(at, counts.values())))
            self.held.update(at)
        self.chars += len(text or "")

    def full(self, most: int) -> bool:
        """By characters, letters of distinct words, or cells of words and languages."""
        return self.chars >= most or self.letters >= most // 2 or len(self.place) * (len(self.learned) + 1) >= most // 4

    def rows(self, block: int, parts: int) -> Iterator[dict]:
        """A row with the documents, and rows with keys and what was learned about them, dealt by key."""
        words, sizes, index = list(self.place), np.array(self.sizes, np.int64), np.frombuffer(self.index, np.uint32)
        # The words of most documents first and each document's in that order, so that steps between them are small.
        often = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((rank[index], owner))
        steps = np.diff(rank[index[by]], prepend=0)
        first = np.cumsum(sizes)[:-1][sizes[1:] > 0]
        steps[first] = rank[index[by]][first]
        yield {"block": block, "part": -1, "words": zstandard.compress(" ".join([words[k] for k in often]).encode("utf-8", "surrogatepass"), 3),
               "ids": _packed(np.array([(0, 0) if i is None else (1, i) for i in self.ids], np.int64).reshape(-1, 2).T.reshape(-1)),
               "sizes": _packed(sizes.astype(np.uint32)), "index": _packed(steps.astype(np.uint32)),
               "times": _packed(np.frombuffer(self.times, np.uint32)[by])}
        keys, langs = Keys(words), sorted(self.learned)
        dense = np.zeros((len(langs) + 1, len(words)))
        for row, counts in zip(dense, [*[self.learned[x] for x in langs], self.held]):
            row[np.fromiter(counts.keys(), np.int64, len(counts))] = np.fromiter(counts.values(), np.float64, len(counts))
        for kind in range(LONGEST + 1):
            found, owner = (keys.words, np.arange(len(words))) if kind == 0 else keys.grams[kind]
            distinct, inverse = np.unique(found, return_inverse=True)
            learned = np.stack([np.bincount(inverse, row[owner], len(distinct)) for row in dense]).astype(np.uint32)
            part = (_mixed(distinct) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                mine = order[edge[p]:edge[p + 1]]
                yield {"block": block, "part": p, "keys": _packed_keys(distinct[mine]), "langs": langs,
                       "counts": _packed(learned[:-1, mine].reshape(-1)), "docs": _packed(learned[-1, mine])}


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()),
             "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _units(docs: DataFrame, parts: int, most: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, block, done = _arrow(_UNITS), _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                block.add(doc_id, text, lang)
                if block.chars >= most:
                    yield pa.RecordBatch.from_pylist(list(block.rows(first + done, parts)), schema)
                    block, done = _Block(), done + 1
        if block.ids:
            yield pa.RecordBatch.from_pylist(list(block.rows(first + done, parts)), schema)

    return docs.mapInArrow(run, _UNITS)


def _answers(units: DataFrame, least_docs: int) -> DataFrame:
    """Per block and part the keys that are known, with their counts by language; and the totals by kind and language."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        langs = sorted({x for r in rows for x in r["langs"]})
        asked = [_unpacked_keys(r["keys"]) for r in rows]
        distinct, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        counts, docs = np.zeros((len(langs), len(distinct)), np.int64), np.zeros(len(distinct), np.int64)
        at = 0
        for r, keys in zip(rows, asked):
            mine = inverse[at:at + len(keys)]
            at += len(keys)
            docs[mine] += _unpacked(r["docs"], np.uint32)
            for x, row in zip(r["langs"], _unpacked(r["counts"], np.uint32).reshape(len(r["langs"]), len(keys))):
                counts[langs.index(x), mine] += row
        kind = (distinct & _KIND).astype(np.int64)
        known = docs >= np.where(kind == 0, least_docs, 1)
        out, at = [], 0
        for r, keys in zip(rows, asked):
            mine = inverse[at:at + len(keys)]
            at += len(keys)
            mine = mine[known[mine]]
            if len(mine):
                out.append({"block": r["block"], "langs": langs, "keys": _packed_keys(distinct[mine]),
                            "counts": _packed(counts[:, mine].reshape(-1))})
        for k in range(LONGEST + 1):
            chosen = known & (kind == k)
            for x, row in zip(langs, counts):
                out.append({"kind": k, "lang": x, "total": int(row[chosen].sum()), "values": int(chosen.sum())})
        return pa.Table.from_pylist(out, _arrow(_ANSWERS))

    return units.filter("part >= 0").select("block", "part", "keys", "langs", "counts", "docs").groupBy("part").applyInArrow(run, _ANSWERS)


class Model:
    """What is known of the keys of a block: log frequencies by language."""

    def __init__(self, langs: list[str], totals: dict[tuple[int, str], int], values: dict[int, int], keys: np.ndarray, counts: np.ndarray,
                 added: float):
        self.langs, self.keys = langs, keys
        kind = (keys & _KIND).astype(np.int64)
        total = np.array([[totals.get((k, x), 0) for x in langs] for k in range(LONGEST + 1)], float)
        kept = np.array([max(values.get(k, 0), 1) for k in range(LONGEST + 1)], float)
        self.logs = np.log((counts + added) / (total + added * kept[:, None]).T[:, kind]) if len(keys) else np.zeros((len(langs), 0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its place."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)), at

    def scores(self, words: list[str]) -> np.ndarray:
        """Per language and word: its log frequency; if it is unknown, the mean of its longest known n-grams'; else 0."""
        keys = Keys(words)
        out = np.zeros((len(self.langs), len(words)))
        hit, at = self.find(keys.words)
        out[:, hit] = self.logs[:, at[hit]]
        open_ = ~hit
        for n in range(LONGEST, 0, -1):
            found, owner = keys.grams[n]
            mine = open_[owner]
            found, owner = found[mine], owner[mine]
            hit, at = self.find(found)
            owner, at = owner[hit], at[hit]
            number = np.bincount(owner, minlength=len(words))
            some = number > 0
            for row, logs in zip(out, self.logs):
                row[some] = np.bincount(owner, logs[at], len(words))[some] / number[some]
            open_ &= ~some
        return out


def predict_language(docs: DataFrame, learn: str = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2", least_docs: int = 2,
                     added: float = 0.5, block_chars: int = 1 << 24, docs_a_part: int = 20_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred and score, the share of the best language among all.

    Words are lower-cased runs of letters. Rows for which ``learn`` holds and whose
    lang is not null are learned from: tokens of every word and of every character
    n-gram of up to 4 letters, by language, over all of them. A word is known if
    ``least_docs`` learned documents have it; it counts by its log frequency in
    each language (``added`` is added to every count). Of any other word the
    longest n-grams that are known count, by the mean of their log frequencies:
    first those of 4 letters, and if none is known of 3, 2, 1. A text's languages
    are weighed by the sum over its words; of equal ones the least name wins.

    The model is never broadcast or sampled and grows with the corpus: blocks of
    documents (up to ``block_chars`` of text of one map task) send their distinct
    keys, with what they learned, to parts dealt by key, and get the counts of known
    ones back. A frequent word is one key a block. There are as many parts as documents
    (``docs_a_part`` each at four languages) and languages ask for. Collected are
    only totals, by language and n. Keys are 64 bits of a hash.

    Null texts and texts without letters are ``und`` with score 0, and so are all if
    nothing could be learned. Rows without id are not learned from and not held
    out. Repeated rows are rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    size = docs.agg(F.count("*").alias("n"), F.approx_count_distinct("lang").alias("langs")).first()
    parts = max(1, -(-size["n"] * (4 + size["langs"]) // (8 * docs_a_part)))
    chosen = F.coalesce(F.expr(learn), F.lit(False))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(chosen, F.col("lang").cast("string")).alias("lang"))
    units = stored(_units(given, parts, block_chars), "units", "zstd")
    answers = stored(_answers(units, least_docs), "answers", "zstd")
    sums = answers.filter("kind is not null").groupBy("kind", "lang").agg(F.sum("total").alias("n"), F.sum("values").alias("v")).collect()
    totals = {(r["kind"], r["lang"]): r["n"] for r in sums}
    values = {k: max((r["v"] for r in sums if r["kind"] == k), default=0) for k in range(LONGEST + 1)}
    langs = sorted({x for _, x in totals})
    schema = "doc_id long, lang_pred string, score double"

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros((len(langs), 0))]
        for r in known.to_pylist():
            mine = _unpacked_keys(r["keys"])
            wide = np.zeros((len(langs), len(mine)))
            wide[[langs.index(x) for x in r["langs"]]] = _unpacked(r["counts"], np.int64).reshape(len(r["langs"]), len(mine))
            keys.append(mine)
            counts.append(wide)
        every = np.concatenate(keys)
        by = np.argsort(every)
        model = Model(langs, totals, values, every[by], np.concatenate(counts, axis=1)[:, by], added)
        out = []
        for row in block.to_pylist():
            words = zstandard.decompress(row["words"]).decode("utf-8", "surrogatepass").split()
            sizes, steps, times = (_unpacked(row[c], np.uint32).astype(np.int64) for c in ("sizes", "index", "times"))
            some, ids = _unpacked(row["ids"], np.int64).reshape(2, -1).tolist()
            owner, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(steps)
            starts = np.cumsum(sizes) - sizes
            index = ends - np.repeat((ends - steps)[np.minimum(starts, max(len(steps) - 1, 0))] if len(steps) else starts, sizes)
            weighed = model.scores(words)
            sums = np.stack([np.bincount(owner, w[index] * times, len(sizes)) for w in weighed]) if langs else np.zeros((1, len(sizes)))
            best = sums.argmax(0)
            share = 1 / np.exp(sums - sums.max(0)).sum(0)
            for k, size in enumerate(sizes.tolist()):
                judged = size > 0 and bool(langs)
                out.append({"doc_id": ids[k] if some[k] else None,
                            "lang_pred": langs[best[k]] if judged else "und", "score": float(share[k]) if judged else 0.0})
        return pa.Table.from_pylist(out, _arrow(schema))

    held = units.filter("part = -1").select("block", "words", "ids", "sizes", "index", "times")
    back = answers.filter("block is not null").select("block", "langs", "keys", "counts")
    scored = held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
    held_out = F.coalesce(~F.expr(learn), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
