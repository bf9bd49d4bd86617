"""The pipeline against a plain version of its stages."""

import collections
import random
import re

import corpus_pipeline
from corvid.llm import quality

from .test_operators import brute_targets, similar_groups, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    boiler = "all rights reserved by the owners of this site"
    rows = []
    for k in range(80):
        text = "\n".join(words(rng, 30) for _ in range(3)) + ("\n" + boiler if k % 3 == 0 else "")
        rows.append([k, text, "en", "ab"[k % 2], 0])
    rows[40][1] = rows[10][1]  # a copy
    rows[41][1] = rows[11][1].split("\n")[0]  # a passage of one line stays
    w = rows[12][1].replace("\n", " ").split()
    rows[12][1] = " ".join(w)
    rows[42][1] = " ".join([*w[:-1], "changed"])  # a near copy in one line
    rows[43][1], rows[44][1], rows[45][1] = None, "too short", "same five words here now " * 9
    return [tuple(r) for r in rows]


def by_hand(rows):
    """Ids and texts that the first three stages keep."""
    held = collections.defaultdict(lambda: collections.defaultdict(set))
    texts = collections.defaultdict(set)
    for _, t, _, s, _ in rows:
        texts[s].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held[s][x].add(t)
    kept = []
    for i, t, _, s, _ in rows:
        w = WORD.findall(t or "")
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(wins)
        rep = len({j for k, x in enumerate(wins) if n[x] > 1 for j in range(k, k + 5)})
        if len(w) < 10 or 100 * rep > 20 * len(w):
            continue
        common = {x for x, d in held[s].items() if len(d) >= quality.MIN_TEXTS and len(d) > quality.MAX_SHARE * len(texts[s])}
        rest = [x for x in t.split("\n") if x not in common]
        left = sum(len(WORD.findall(x)) for x in rest)
        if len(rest) < len(t.split("\n")) and (left < 10 or left < quality.MIN_LEFT * len(w)):
            continue
        kept.append((i, "\n".join(rest), s))
    seen, lines = set(), []
    for i, t, s in kept:
        x = t.split("\n")
        gone = set()
        for k in range(len(x) - 1):
            if (x[k], x[k + 1]) in seen:
                gone |= {k, k + 1}
            seen.add((x[k], x[k + 1]))
        rest = "\n".join(y for k, y in enumerate(x) if k not in gone)
        if not gone or WORD.search(rest):
            lines.append((i, rest, s))
    return [lines[k] for k in sorted(set(similar_groups([t for _, t, _ in lines])))]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = by_hand(rows)
    sizes = collections.Counter()
    for _, t, s in kept:
        sizes[s] += len(WORD.findall(t))
    target = brute_targets(dict(sizes))
    by_id = {i: (t, s) for i, t, s in kept}
    assert {r.doc_id for r in out} <= set(by_id) and not {40, 43, 44, 45} & {r.doc_id for r in out}
    taken = collections.Counter()
    import hashlib

    for r in out:
        text, source = by_id[r.doc_id]
        taken[source] += len(WORD.findall(text))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert max(collections.Counter(r.doc_id for r in out).values()) <= 2
    assert all(abs(taken[s] - target[s]) <= max(len(WORD.findall(t)) for _, t, _ in kept) for s in sizes)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns; and an empty table."""
    rng = random.Random(22)
    long = "\n".join(words(rng, 40) for _ in range(3000))
    same = words(rng, 40)
    rows = [(1, words(rng, 30), "en", "a", 7), (1, same, None, None, 7), (2, same, "en", "b", None), (2, same, "en", "b", None), (None, words(rng, 25), "en", "a", 7), (None, None, None, None, None), (3, None, "en", "a", 7), (4, "", "en", "a", 7), (5, long, "en", "c", 7)]
    for name, clash in (("plain", []), ("clash", ["_row", "_key", "node", "key", "ids", "n_tokens", "_text", "shard"])):
        docs = spark.createDataFrame(rows, SCHEMA)
        for c in clash:
            docs = docs.withColumn(c, docs.n_chars)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} == {1, 5, None} and all(r.n_tokens > 0 for r in out)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
