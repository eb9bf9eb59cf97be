import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import exact, linededup, substrings
from slotwise.llm.cuckoo import CuckooFilter
from slotwise.llm.suffixes import Suffixes

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups(edge_docs, edge_rows):
    groups = defaultdict(list)
    for doc_id, text in edge_rows:
        groups[(text or "").translate(LOW)].append(doc_id)
    want = []
    for doc_id, text in edge_rows:
        low = (text or "").translate(LOW)
        keep = max((x for x in groups[low] if x is not None), default=None)
        want.append((doc_id, keep, len(groups[low]), doc_id == keep, sha(low)))
    assert rows_of(exact.exact_dedup(edge_docs)) == sorted(want, key=repr)


def test_copies_go_and_columns_stay(edge_docs, edge_rows, no_docs):
    left = exact.drop_copies(edge_docs)
    assert left.columns == edge_docs.columns
    assert len({r.text for r in left.collect()}) >= len({(t or "").translate(LOW) for _, t in edge_rows}) - 1
    assert exact.exact_dedup(no_docs).count() == 0


def line_brute(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            if doc_id is not None and len(key(x)) >= min_chars:
                held[key(x)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc_id is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return sorted(out, key=repr)


def test_repeated_lines(edge_docs, edge_rows, no_docs):
    assert rows_of(linededup.line_digests(edge_docs)) == line_brute(edge_rows)
    cleaned = linededup.dedup_lines(edge_docs)
    assert set(cleaned.columns) == {*edge_docs.columns, "n_lines", "n_dropped"}
    assert cleaned.filter("label <> 7").count() == 0
    assert linededup.line_digests(no_docs).count() == 0


def test_line_index_is_reversible(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text")
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    index = linededup.LineIndex(spark, min_docs=5)
    index.insert(first)
    before, drops = rows_of(index.counts), rows_of(index.drops().select("doc_id", F.sort_array("keys")))
    index.insert(second)
    whole = linededup.LineIndex(spark, min_docs=5)
    whole.insert(docs)
    assert rows_of(index.counts) == rows_of(whole.counts) != before
    assert rows_of(index.drops().select("doc_id", F.sort_array("keys"))) == rows_of(whole.drops().select("doc_id", F.sort_array("keys")))
    index.insert(second)  # again: nothing new
    assert rows_of(index.counts) == rows_of(whole.counts)
    index.delete(second)
    assert rows_of(index.counts) == before
    assert rows_of(index.drops().select("doc_id", F.sort_array("keys"))) == drops


def test_line_index_grows_and_shrinks(spark):
    """One document to 100,000 and back: shards follow, filters miss nothing, little is written for little."""
    line = lambda n: F.rpad(F.concat(F.lit("line "), n.cast("string")), 50, "=")
    own, some = F.col("id") * 7, F.col("id") % 3000
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", line(own + 1_000_000), line(some), F.lit("=" * 60)).alias("text"))
    index = linededup.LineIndex(spark, shard_rows=10_000)
    index.insert(docs.filter("doc_id = 0"))
    assert index.shards == 8 and index.counts.count() == 3
    one = rows_of(index.counts)
    index.insert(docs)
    assert index.size == index.refs.count() == 300_000 and index.shards == 32
    assert index.counts.count() == 103_001 and index.filters.count() == 32
    lost = index.drops(group_rows=5_000).select("doc_id", F.size("keys").alias("n"))
    # Each of the 3,001 shared lines stays in one document.
    assert lost.agg(F.sum("n")).first()[0] == 200_000 - 3_001 and lost.count() == 99_999
    before, held = index.written, rows_of(index.counts)
    more = docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 200_000)
    index.insert(more)
    assert index.counts.filter("n >= 20 AND n < 100000 AND largest >= 200000").count() == 20
    index.delete(more)
    assert index.written - before < 20 * 3 * 6 and rows_of(index.counts) == held
    index.delete(docs.filter("doc_id > 0"))
    assert index.shards == 8 and rows_of(index.counts) == one and index.drops().count() == 0
    index.delete(docs)
    assert index.refs.count() == index.counts.count() == index.size == 0
    index.insert(docs.filter("doc_id < 5"))
    assert {r.doc_id for r in index.drops().collect()} == {0, 1, 2, 3}


def test_cuckoo_filter_forgets_only_what_is_removed():
    turn = np.random.default_rng(1)
    keys = turn.integers(-2**63, 2**63, 20_000)
    held = CuckooFilter.for_keys(keys[:15_000])
    assert held.has(keys[:15_000]).all()
    assert held.has(keys[15_000:]).mean() < 0.002
    held.remove(keys[:5_000])
    held = CuckooFilter.load(held.dump())
    assert held.has(keys[5_000:15_000]).all()
    assert held.has(keys[:5_000]).mean() < 0.002
    assert not CuckooFilter.for_keys(keys[:0]).has(keys).any()


def suffix_brute(rows, length):
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(b), int(gone.sum()), spans, sha(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeated_byte_strings(edge_docs, edge_rows, hot):
    got = substrings.remove_repeats(edge_docs, shard_bytes=20_000, hot_contexts=hot).drop("kept")
    assert rows_of(got) == suffix_brute(edge_rows, 200)


def test_no_repeats_in_nothing(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc\x00\xff"])
def test_suffixes(letters):
    turn = np.random.default_rng(len(letters))
    for _ in range(40):
        texts = [bytes(turn.choice(list(letters), turn.integers(0, 50)).astype(np.uint8)) for _ in range(turn.integers(0, 6))]
        texts += texts[:1]
        found = Suffixes(texts)
        every = [(t[i:], k) for k, t in enumerate(texts) for i in range(len(t))]
        want = sorted(range(len(every)), key=lambda j: ([c + 1 for c in every[j][0]] + [0, every[j][1]]))
        assert found.order.tolist() == want
        common = found.common()
        for a, b in zip(want, want[1:]):
            n = 0
            while n < min(len(every[a][0]), len(every[b][0])) and every[a][0][n] == every[b][0][n]:
                n += 1
            assert common[b] == n
