import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from slotwise.llm import merkle

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    """(top, per leaf the siblings to the left and right, level by level)."""
    proofs, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, under = [], []
        for a in range(0, len(digests), 8):
            run = digests[a:a + 8]
            for k in range(len(run)):
                for leaf in below[a + k]:
                    proofs[leaf].append((run[:k], run[k + 1:]))
            up.append(sha("".join(run)))
            under.append(sum(below[a:a + 8], []))
        digests, below = up, under
    return digests[0], proofs


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (*_, leaf, row), proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = text.translate(LOW)
            now = leaf_of(row, text)
            for left, right in proof + top:
                now = sha("".join(left) + now + "".join(right))
            siblings = "".join("".join(a) + "".join(b) for a, b in proof + top)
            out.append((row[0], leaf, trees[g][0], root, sha(siblings), now, now == root))
    return sorted(out, key=repr)


def odd_rows():
    rows = [(i, f"s{i % 3}", "en", 5, f"Text {i}") for i in range(700)]
    rows += [(i, None, None, None, None if i % 2 else "") for i in range(1000, 1009)]
    rows += [(2000, "a", "de", 1, "Ä" * 30_000), (2000, "a", "de", 1, "other"), (2001, "a", "", 1, "empty name"), (None, "a", "de", 1, "No id"),
             (None, "a", "de", 1, "No id"), (3000, "a", "fr", 1, "Alone")]
    rows += [(4000 + i, "x", f"l{i}", i, "One of Many") for i in range(70)]
    return rows + [(7, "s1", "en", 5, "Text 7")] * 20


@pytest.mark.parametrize("options", [{}, {"block_levels": 1, "limit": 3}])
def test_manifest_is_that_of_a_plain_tree(spark, options):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumns(
        {c: F.lit("x") for c in ("tree", "place", "nodes", "digest", "leaf", "proof", "path", "member", "block", "slice", "tie")})
    assert sorted((tuple(r) for r in merkle.tamper_check(docs, **options).collect()), key=repr) == brute(rows)


def test_single_rows_and_empty_tables(spark):
    one = [(5, "s", None, 1, "ABC")]
    assert [tuple(r) for r in merkle.tamper_check(spark.createDataFrame(one, FIELDS)).collect()] == brute(one)
    assert merkle.tamper_check(spark.createDataFrame([], FIELDS)).count() == 0


def test_queue_gives_messages_in_order_beyond_its_limit():
    queue, want = merkle.LabelQueue(limit=5), [(i * 7919 % 1000, i) for i in range(1000)]
    for message in want[:600]:
        queue.push(message)
    assert len(queue.heap) <= 6 and queue.runs
    got = [queue.pop() for _ in range(100)]
    for message in want[600:]:
        queue.push(message)
    rest = [queue.pop() for _ in range(900)]
    assert got == sorted(want[:600])[:100] and rest == sorted(set(want) - set(got)) and queue.least() is None


def test_a_proof_needs_its_own_leaf(spark):
    rows = merkle.manifest(spark.createDataFrame(odd_rows(), FIELDS))
    right = merkle.fold(F.col("leaf"), F.col("proof"), F.col("path"))
    wrong = merkle.fold(F.sha2("leaf", 256), F.col("proof"), F.col("path"))
    assert rows.filter(right != F.col("root")).count() == 0
    assert rows.filter(wrong == F.col("root")).count() == 0
