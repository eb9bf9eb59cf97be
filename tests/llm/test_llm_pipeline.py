"""The corpus pipeline against brute force, stage by stage and as a whole."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm_jaccard import shingles
from test_llm_text import LOW, words

import corpus_pipeline
from slotwise.llm import quality
from slotwise.llm.common import stored
from slotwise.llm.tokens import BytePairs

LABELS = [(1003, 1), (1003, 0), (None, 1), (1100, None), (1101, 1), (1102, 1), (1103, 0), (1205, 0), (3001, 0)]


@pytest.fixture(scope="module")
def folder(spark, edge_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    probe = dict(edge_rows)[1006].split()
    spark.createDataFrame(edge_rows * 2, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(probe[20:40])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rejected(rows):
    stats = np.array([np.array(quality.measure(t), "<f4") for _, t in rows]).astype(float)
    x = quality.basis(stats)
    import zlib
    own = defaultdict(list)
    for i, q in LABELS:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            own[i].append(q)
    label = [min(own[i]) if i in own else None for i, _ in rows]
    p = x[[q == 1 for q in label]]
    known = [q for q in label if q is not None]
    w = quality.fit({k: (float(len(m)), m.sum(0), m.T @ m) for k, m in (("u", x), ("p", p))}, float(np.mean(known)))
    score = np.clip((x @ w + 1) / 2, 0, 1)
    return [r for r, s in zip(rows, score) if s < 0.3 and r[0] is not None]


def cleaned(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    stay = lambda i, x: i is None or len(held[key(x)]) < 5 or max(held[key(x)]) == i
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if stay(i, x))) for i, t in rows)


def components(rows):
    """Distinct rows by component; texts without words are alone."""
    rows = list(dict.fromkeys(rows))
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    out = defaultdict(list)
    for r, g in zip(rows, group):
        out[g].append(r)
    return list(out.values())


def test_every_stage_and_the_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    quality_stage, line_stage, near_stage, clean_stage, pack_stage = (f for _, f in corpus_pipeline.STAGES)

    def after(stage):
        nonlocal docs, rows
        before, docs = rows, stored(stage(spark, docs, folder), "stage")
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        return before, Counter(rows)

    before, got = after(quality_stage)
    bad = set(rejected(before))
    assert bad and got == Counter(r for r in before if r not in bad)

    before, got = after(line_stage)
    assert got == cleaned(before)

    before, got = after(near_stage)
    assert set(got.values()) == {1} and got.keys() <= set(before)
    for group in components(before):
        stay = [r for r in group if r in got]
        assert len(stay) == 1, group
        assert stay[0][0] == min((i for i, _ in group if i is not None), default=None)

    before, got = after(clean_stage)
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text)
    windows = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}
    hit = lambda t: any(tuple(w[k:k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))
    assert got == Counter(r for r in before if not hit(r[1])) and got != Counter(before)

    from tokenizers import Tokenizer
    own = Tokenizer.from_file(BytePairs().path)
    want = Counter()
    for i, text in rows:
        want[i] += len(own.encode(text or "", add_special_tokens=False).ids) + 1
    for pieces in (pack_stage(spark, docs, folder), corpus_pipeline.run(spark, folder)):
        total = Counter()
        for p in pieces.select("doc_id", "length").collect():
            total[p.doc_id] += p.length
        assert total == want


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
