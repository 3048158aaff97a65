"""Operators that SQL cannot state, end to end: tiling against all pairs of places, toxicity against held-out labels, counts of the language model."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quietgrid.llm import decontam, lm_hmm, toxicity

SF = "/root/testdata/sf0.01"


def tiles(item: list[str], doc: list[str], least: int) -> tuple[int, int]:
    """Tokens of the item under greedy tiles and their number, by comparing every pair of places."""
    free_i, free_d, covered, n_tiles = [True] * len(item), [True] * len(doc), 0, 0
    while True:
        best, at = 0, (0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < least:
            return covered, n_tiles
        for k in range(best):
            free_i[at[0] + k] = free_d[at[1] + k] = False
        covered, n_tiles = covered + best, n_tiles + 1


def test_benchmark_matches_equal_greedy_tiling(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 3)))
    items = [[word() for _ in range(rng.randint(8, 24))] for _ in range(6)] + [["one", "two"], ["only"]]
    docs = []
    for _ in range(40):
        own = [word() for _ in range(rng.randint(0, 30))]
        item = rng.choice(items[:6])
        cut = rng.randint(1, len(item) - 1)
        part = rng.choice([item, item[cut:] + item[:cut], item[: len(item) // 2], item[:cut] + [word()] + item[cut:]])
        docs.append(own[:10] + part + own[10:])
    docs += [["one", "two"], ["one", "two", "three"], ["only"], []]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(d).upper() if i % 2 else " ".join(d)) for i, d in enumerate(docs)] + [(None, None), (0, texts_of(docs[0]))]
    asked = [(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None), (98, ""), (0, " ".join(items[0]))]
    got = decontam.benchmark_matches(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "item_id long, text string"))
    found = Counter((r.doc_id, r.item_id, r.item_tokens, r.covered_tokens) for r in got.collect())
    split = lambda t: [x for x in re.split("[^0-9a-z\x80-\U0010ffff]+", decontam.lowered(t).decode()) if x]
    want: Counter = Counter()
    for d, text in texts:
        for i, item in asked:
            a, b = split(item), split(text)
            if not a:
                continue
            covered = tiles(a, b, 5)[0] if len(a) >= 5 else len(a) * (a == b)
            if covered >= 0.7 * len(a):
                want[d, i, len(a), covered] += 1
    assert found == want and len(want) > 20


def texts_of(words: list[str]) -> str:
    return " ".join(words)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held_out = toxicity.remainder("doc_id", 3) == 1
    model = toxicity.train_toxicity(docs, labels, ~held_out)
    rows = toxicity.score_toxicity(docs, model, 0.7).join(labels.where(held_out).select("doc_id", "toxic"), "doc_id").collect()
    hits = [(r.score, r.predicted, r.toxic) for r in rows]
    caught = [p for _, p, t in hits if t]
    assert len(caught) > 10 and np.mean(caught) >= 0.7  # recall
    assert np.mean([t for _, p, t in hits if p]) >= 0.9  # precision
    pairs = [(a > b) + 0.5 * (a == b) for a, _, t in hits if t for b, _, u in hits if not u]
    assert np.mean(pairs) >= 0.85  # the area under the curve
    assert all((p == 1) == (s >= 0.7) and 0 <= s <= 1 for s, p, _ in hits)


def test_scores_of_a_small_corpus(spark):
    """Counts and base scores word by word; the model's scores are finite, and equal for null and empty texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)] + ["", None, "Unseen Words here", "W1 w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    train = F.col("doc_id") % 4 != 0
    rows = {r.doc_id: r for r in lm_hmm.score_texts(docs, train).collect()}
    token = lambda t: [x.lower() for x in (t or "").split()] + [None]
    counts = Counter(w for i, t in enumerate(texts) if i % 4 for w in token(t))
    total, vocabulary = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in token(t))
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(token(t)), sum(counts[w] > 0 for w in token(t)), total, i % 4 == 0)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r.score) and r.score < 0
    assert rows[80].score == rows[81].score  # null and empty
