import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from slotwise.llm import decontaminate, jaccard
from slotwise.llm.common import stored
from slotwise.llm.components import components
from slotwise.session import sized

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Per row (doc_id, size, smallest doc_id reachable)."""
    sets = [shingles(t) for _, t in rows]
    where, group = defaultdict(list), list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x]).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                group[top(i)] = top(j)
        for x in s:
            where[x].append(i)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[top(i)].append(doc_id)
    return sorted(((d, len(s), min(ids[top(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("frequent", [64, 3])
def test_components_are_those_of_all_pairs(edge_docs, edge_rows, frequent):
    got = [tuple(r)[:3] for r in jaccard.near_duplicates(edge_docs, frequent=frequent, parts=7).collect()]
    assert sorted(got, key=repr) == brute(edge_rows)


def test_one_row_of_each_component_stays(edge_docs, edge_rows):
    left = jaccard.one_of_each(edge_docs)
    assert left.columns == edge_docs.columns
    judged = brute(edge_rows)
    empty = sum(n == 0 for _, n, _ in judged)
    full = Counter(r.doc_id for r in left.select("doc_id", "text").collect() if shingles(r.text))
    assert set(full) == {c for _, n, c in judged if n}
    assert left.count() - sum(full.values()) == empty


def test_components_under_no_id_or_one_id_stay(spark):
    """Unrelated texts without id, two texts under one id, and rows repeated in id and text."""
    pick = random.Random(8)
    text = lambda n=60: " ".join("".join(pick.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    alone = [text() for _ in range(4)]
    one, other, pair, again = text(), text(), text(), text()
    rows = [(None, t) for t in alone] + [(None, alone[0] + " more")] + [(7, one), (7, other)]
    rows += [(None, pair), (9, pair), (8, pair + " more")] + [(10, again)] * 5 + [(None, text(3))] * 3
    rows += [(20, ""), (21, ""), (None, None), (None, " "), (22, None), (22, None)]
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), parts=5)
    got = Counter(tuple(r) for r in left.collect())
    first = got.keys() & {(None, alone[0]), (None, alone[0] + " more")}
    assert len(first) == 1
    want = [(None, t) for t in alone[1:]] + [*first, (7, one), (7, other), (8, pair + " more"), (10, again), rows[-7]]
    want += [(20, ""), (21, ""), (None, None), (None, " "), (22, None)]
    assert got == Counter(want)


def test_nothing_of_nothing(no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0
    assert jaccard.one_of_each(no_docs).count() == 0


def test_the_first_needed_values_meet():
    """Sets at the very bound of 0.8 share one of the first values they take, in any order of the values."""
    turn = np.random.default_rng(3)
    for n in [*range(1, 60), 81, 100, 243, 300, 729, 900]:
        for _ in range(20):
            a = np.unique(turn.integers(0, 2**64, n, dtype=np.uint64))
            d = len(a) // 4
            cut = turn.integers(0, d + 1) if d else 0
            b = np.unique(np.concatenate([turn.permutation(a)[cut:], turn.integers(0, 2**64, d - cut, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            x, y = ({band: (v.tolist(), few) for band, v, _, few in jaccard.block_values(s)} for s in (a, b))
            salt = int(turn.integers(1, 2**60))
            order = lambda v: (v * 0x9E3779B97F4A7C15 ^ salt) % 2**64
            first = lambda v, s: set(v[0] if v[1] else sorted(v[0], key=order)[:jaccard.needed(len(s))])
            assert any(first(x[k], a) & first(y[k], b) for k in x.keys() & y.keys()), (len(a), len(b), both)


def test_sketches_differ_in_no_more_bits_than_sets():
    turn = np.random.default_rng(4)
    for n in (1, 5, 63, 64, 65, 300, 2000):
        a = np.unique(turn.integers(0, 2**64, n, dtype=np.uint64))
        for m in (0, 1, n // 5, n):
            b = np.unique(np.concatenate([a[m:], turn.integers(0, 2**63, m + 1, dtype=np.uint64)]))
            assert jaccard.differing_bits(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
        assert jaccard.differing_bits(jaccard.sketch(a), jaccard.sketch(a)) == 0


def test_labels_are_the_least_nodes(spark):
    pick = random.Random(2)
    links = [(pick.randrange(400), pick.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    group = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= (group[a], group[b]) != (low, low)
            group[a] = group[b] = low
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {k: v for k, v in group.items() if k in got}
    assert {k for k, v in group.items() if v != k} <= set(got)


def test_small_tables_are_few_files(spark, monkeypatch):
    few, many = (stored(spark.range(0, 100, 1, 40), "files", most=n) for n in (100, 10**9))
    assert len(few.inputFiles()) == 1 and len(many.inputFiles()) == 40 and few.count() == many.count() == 100
    written = []

    def spy(df, what, *args, **more):
        written.append(stored(df, what, *args, **more))
        return written[-1]

    monkeypatch.setattr("slotwise.llm.components.stored", spy)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        labels = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"))
        assert {r.label for r in labels.collect()} == {0} and labels.count() == 201
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(written[0].inputFiles()) > 1 and all(len(t.inputFiles()) == 1 for t in written[1:])


def test_tables_of_few_texts_are_few_files(spark, edge_rows, monkeypatch):
    """Of the join and of its neighbours in the pipeline, whatever the number of shuffle partitions."""
    written = defaultdict(list)

    def spy(df, what, *args, **more):
        written[what].append(stored(df, what, *args, **more))
        return written[what][-1]

    monkeypatch.setattr("slotwise.llm.jaccard.stored", spy)
    monkeypatch.setattr("slotwise.llm.linededup.stored", spy)
    monkeypatch.setattr("slotwise.llm.linededup.sized", lambda df: written["spread"].append(df) or sized(df))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    docs = stored(spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(5), "few-texts")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = [tuple(r)[:3] for r in jaccard.near_duplicates(docs, few=0).collect()]
        lines = stored(corpus_pipeline.line_stage(spark, docs, ""), "lines")
        left = stored(corpus_pipeline.near_duplicate_stage(spark, docs, ""), "left")
        items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "one two")], "item_id long, text string")
        windows, _ = decontaminate.test_windows(items, 10)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(got, key=repr) == brute(edge_rows)
    files = {what: max(len(t.inputFiles()) for t in written[what]) for what in (
        "met", "met-rows", "near-texts", "links", "differences", "line-counts")} | {
        "lines": len(lines.inputFiles()), "left": len(left.inputFiles()),
        "windows": windows.rdd.getNumPartitions(), "spread": written["spread"][0].rdd.getNumPartitions()}
    assert set(files.values()) == {1}, files
    assert lines.count() == len(edge_rows) and windows.count() == 4


def test_pairs_are_distinct_before_known_ones_go(spark, edge_docs, monkeypatch):
    """Spark puts an anti join before the aggregate, over every row of a pair; the two left are those of hubs."""
    plans = []

    def spy(df, what, *args, **more):
        if what == "again":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, what, *args, **more)

    monkeypatch.setattr("slotwise.llm.jaccard.stored", spy)
    jaccard.near_duplicates(edge_docs, few=3)
    assert [p.count("LeftAnti") for p in plans] == [2]


def test_sets_of_many_texts_take_little_at_a_time():
    """A worker keeps the memory it took once, beside that of the other workers of its executor."""
    texts = [(f"word{i} again " * 150).encode() for i in range(2000)]
    tracemalloc.start()
    try:
        held = sum(len(s) for part in jaccard._text_parts(texts) for s in jaccard.shingle_sets(part))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held == 2 * len(texts) and peak < 24e6


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(links, rounds=2)


def _around(rows):
    """Hub, its nodes and which of them fail against it: the rows that differences are sought in."""
    hub, nodes = rows
    both = [len(np.intersect1d(hub, x)) for x in nodes]
    return [100 * k < 80 * (len(hub) + len(x) - k) for k, x in zip(both, nodes)]


def _met(spark, families):
    """Pairs (family, node, node) that meet by their differences, all nodes in components of their own."""
    rows = []
    for f, (hub, nodes) in enumerate(families):
        for i, (x, failed) in enumerate(zip(nodes, _around((hub, nodes)))):
            name = f * 100_000 + i
            for role, rest, keys, common, size in jaccard._needed_differences(-7 - f, hub, x, failed, 80):
                rows += [(int(k), role, name, name, len(x), common, int(r), size) for k, r in zip(keys.view(np.int64), rest)]
    apart = spark.createDataFrame(rows, "key long, role int, node long, lnode long, size int, common int, rest int, hub int")
    return {(r.u, r.v) for r in jaccard._could_link(apart, 80).distinct().collect()}


def _links(families):
    """Pairs that link and of which one failed against the hub."""
    out = set()
    for f, (hub, nodes) in enumerate(families):
        failed = _around((hub, nodes))
        for i, x in enumerate(nodes):
            for j in range(i):
                k = len(np.intersect1d(x, nodes[j]))
                if (failed[i] or failed[j]) and 100 * k >= 80 * (len(x) + len(nodes[j]) - k):
                    out.add((f * 100_000 + j, f * 100_000 + i))
    return out


def test_nodes_that_failed_meet_all_they_link_to(spark):
    """Over hubs of any size: nodes that lack and add shingles, some from a common pool, and those inside the hub."""
    turn = np.random.default_rng(6)
    families = []
    for n in [*range(1, 40), 60, 90, 137, 200, 333] * 2:
        hub = np.unique(turn.integers(0, 2**64, n, dtype=np.uint64))
        pool = np.unique(turn.integers(0, 2**64, max(2, n // 2), dtype=np.uint64))
        nodes = []
        for _ in range(14):
            lost = turn.permutation(hub)[:turn.integers(1, n + 1)] if turn.random() < 0.3 else hub[np.sort(turn.permutation(n)[turn.integers(0, n // 3 + 1):])]
            new = pool[:turn.integers(0, len(pool) + 1)] if turn.random() < 0.7 else turn.permutation(pool)[:2]
            x = np.unique(np.concatenate([lost, new]))
            nodes.append(x)
            nodes.append(x[turn.integers(0, len(x) // 5 + 1):])
        families.append((hub, [x for x in nodes if len(x)]))
    want = _links(families)
    assert len(want) > 500
    assert want <= _met(spark, families)


def test_strays_of_a_large_family_do_not_meet_in_pairs(spark):
    """5,000 texts around one, a fifth of them too far from it: pairs stay far below the square."""
    turn = np.random.default_rng(9)
    hub = np.unique(turn.integers(0, 2**64, 150, dtype=np.uint64))
    nodes = []
    for i in range(5000):
        d = 12 if i % 5 else 24
        nodes.append(np.unique(np.concatenate([turn.permutation(hub)[d:], turn.integers(0, 2**64, d - i % 3, dtype=np.uint64)])))
    failed = _around((hub, nodes))
    assert sum(failed) == 1000
    assert len(_met(spark, [(hub, nodes)])) < 5000


def test_differences_give_the_same_components(edge_docs, edge_rows):
    got = [tuple(r)[:3] for r in jaccard.near_duplicates(edge_docs, frequent=3, few=0, parts=7).collect()]
    assert sorted(got, key=repr) == brute(edge_rows)


def _met_counted(spark, families):
    """As ``_met``, with differences in the order of their counts; also the rows before pairs are made distinct."""
    often = np.zeros(1 << jaccard._CELL_BITS, np.int64)
    for f, (hub, nodes) in enumerate(families):
        for x in nodes:
            for cells in jaccard._difference_cells(-7 - f, hub, x, 80):
                often += np.bincount(cells, minlength=len(often))
    rows = []
    for f, (hub, nodes) in enumerate(families):
        for i, (x, failed) in enumerate(zip(nodes, _around((hub, nodes)))):
            name = f * 100_000 + i
            for role, rest, keys, common, size in jaccard._needed_differences(-7 - f, hub, x, failed, 80, often):
                rows += [(int(k), role, name, name, len(x), common, int(r), size) for k, r in zip(keys.view(np.int64), rest)]
    apart = spark.createDataFrame(rows, "key long, role int, node long, lnode long, size int, common int, rest int, hub int")
    met = [(r.u, r.v) for r in jaccard._could_link(apart, 80).collect()]
    return set(met), len(met)


def test_rare_differences_first_meet_all_links(spark):
    turn = np.random.default_rng(11)
    families = []
    for n in [*range(1, 40, 3), 60, 90, 137, 200]:
        hub = np.unique(turn.integers(0, 2**64, n, dtype=np.uint64))
        pool = np.unique(turn.integers(0, 2**64, max(2, n // 2), dtype=np.uint64))
        nodes = []
        for _ in range(14):
            kept = hub[np.sort(turn.permutation(n)[turn.integers(0, n // 3 + 1):])]
            x = np.unique(np.concatenate([kept, pool[:turn.integers(0, len(pool) + 1)], turn.permutation(pool)[:2]]))
            nodes += [x, x[turn.integers(0, len(x) // 5 + 1):]]
        families.append((hub, [x for x in nodes if len(x)]))
    want = _links(families)
    assert len(want) > 300
    assert want <= _met_counted(spark, families)[0]


def test_a_passage_beside_the_hub_brings_no_pairs(spark):
    """400 texts share half of a hub and a passage that the hub lacks, and are too far from each other; two more link."""
    turn = np.random.default_rng(12)
    hub = np.unique(turn.integers(0, 2**64, 340, dtype=np.uint64))
    passage = np.unique(turn.integers(0, 2**64, 90, dtype=np.uint64))
    nodes = [np.unique(np.concatenate([hub[:170], passage, turn.integers(0, 2**64, 130, dtype=np.uint64)])) for _ in range(400)]
    nodes += [np.delete(nodes[0], [5, 300]), np.delete(nodes[1], [7, 200])]
    assert all(_around((hub, nodes)))
    want = _links([(hub, nodes)])
    pairs, rows = _met_counted(spark, [(hub, nodes)])
    assert want == {(0, 400), (1, 401)} and want <= pairs
    assert rows < 2000
