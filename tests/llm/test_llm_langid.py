import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from slotwise.llm import langid

COLUMNS = "doc_id long, text string, lang string"


def grams(word, n):
    marked = f"_{word}_"
    return [g for g in (marked[i:i + n] for i in range(len(marked) - n + 1)) if n > 1 or g != "_"]


def brute(rows, least_docs=2, added=0.5):
    """Counts and scores word by word, on texts."""
    counts, docs = defaultdict(Counter), Counter()
    words_of = {k: langid.words_of(text or "") for k, (_, text, _) in enumerate(rows)}
    for k, (doc_id, text, lang) in enumerate(rows):
        if lang is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2:
            continue
        docs.update(set(words_of[k]))
        for word in words_of[k]:
            counts[0, word][lang] += 1
            for n in range(1, 5):
                for g in grams(word, n):
                    counts[n, g][lang] += 1
    counts = {k: c for k, c in counts.items() if k[0] or docs[k[1]] >= least_docs}
    langs = sorted({x for _, _, x in rows if x} if counts else ())
    langs = sorted({x for c in counts.values() for x in c})
    total, kinds = defaultdict(Counter), Counter(k for k, _ in counts)
    for (kind, _), c in counts.items():
        total[kind].update(c)
    log = lambda kind, key, x: math.log((counts[kind, key][x] + added) / (total[kind][x] + added * kinds[kind]))
    out = []
    for k, (doc_id, _, _) in enumerate(rows):
        sums = dict.fromkeys(langs, 0.0)
        for word in words_of[k]:
            for n in (0, 4, 3, 2, 1):
                found = [w for w in ([word] if n == 0 else grams(word, n)) if (n, w) in counts]
                if found:
                    for x in langs:
                        sums[x] += sum(log(n, w, x) for w in found) / len(found)
                    break
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
        if not words_of[k] or not langs:
            out.append((doc_id, held, "und", 0.0))
            continue
        best = max(langs, key=lambda x: (round(sums[x], 9), [-ord(c) for c in x]))
        out.append((doc_id, held, best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)))
    return out


def odd_rows():
    pick = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ré", "ço", "mi", "du"], "cc": ["шо", "ка", "ли", "mi"]}
    word = lambda x: "".join(pick.choice(parts[x]) for _ in range(pick.randint(1, 3)))
    rows = []
    for i in range(300):
        lang = pick.choice(list(parts))
        text = " ".join(word(lang) for _ in range(pick.choice([1, 2, 5, 30])))
        rows.append((i, pick.choice([text, text.upper(), f"{text}1{text}, {text}!"]), lang if i % 10 else None))
    rows += [(400, None, "aa"), (401, "", "aa"), (402, "12 34 ½ ²_", "bb"), (403, "zzz", None), (404, "語語", None), (None, "ka lo", "aa"), (None, None, None)]
    return rows + [(405, "ka " * 30_000, "aa"), (406, "qx" * 30_000, None)] + [(7, rows[7][1], rows[7][2])] * 3


def close(got, want):
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert tuple(g)[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6, (g, w)


def test_scores_are_those_of_plain_counts(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4).withColumns(
        {c: F.lit("x") for c in ("block", "part", "keys", "langs", "counts", "docs", "words", "kind", "score", "held_out")})
    close(langid.predict_language(docs).collect(), brute(rows))
    close(langid.predict_language(docs, block_chars=2000, docs_a_part=10).collect(), brute(rows))  # many blocks and parts


def test_nothing_to_learn(spark):
    rows = [(i, "some words", None) for i in range(8)]
    assert {tuple(r)[2:] for r in langid.predict_language(spark.createDataFrame(rows, COLUMNS)).collect()} == {("und", 0.0)}
    assert langid.predict_language(spark.createDataFrame([], COLUMNS)).count() == 0


def test_held_out_documents_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()
