"""The corpus pipeline over the smallest tables, and its stages' contracts."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    found = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", found)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages(spark, pipeline):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n, name
        n = docs.count()
    assert {r.doc_id for r in pipeline.mix(spark, docs, DATA).collect()} == {r.doc_id for r in docs.collect()}
    assert pipeline.run(spark, DATA).count() == n


def greedy(item: list[str], doc: list[str], least: int) -> int:
    """Tokens of the item under greedy tiles, by comparing every pair of places."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
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
            return covered
        for k in range(best):
            free_i[at[0] + k] = free_d[at[1] + k] = False
        covered += best


def near_copies_gone(rows: list) -> list:
    sets = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in ((r.text or "").encode().lower().split() for r in rows)]
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                top[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None and sets[i]:
            least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return [r for i, r in enumerate(rows) if r.doc_id is None or not sets[i] or r.doc_id == least[find(i)]]


def test_stages_against_brute_force(spark, pipeline, tmp_path):
    from pyspark.sql import functions as F

    from quietgrid.llm import decontam, queries, toxicity

    base = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 2500")
    own = base.collect()
    item = " ".join(f"word{i}" for i in range(30))
    extra = [(1, "a passage of its own " + item, "en", None, 3), (1, own[0].text, "en", "s", 3), (None, own[1].text, None, None, None), (None, None, None, None, None), (7001, "", "en", "s", 0), (7002, "\t \n", "en", "s", 3), (7003, " ".join(item.split()[15:] + item.split()[:15]), "en", "s", 3), (7004, own[2].text, "en", "s", 3), (7004, own[3].text + " tail", "en", "s", 3)]
    extra += [(7100 + i, f"Shared Line\nits own text number {i} and more", "en", "s", 3) for i in range(10)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "word1 word2")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    schema, sf = docs.schema, str(tmp_path)
    table = lambda rows: spark.createDataFrame(rows, schema)
    same = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))

    rows = docs.collect()
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    kept = pipeline.drop_toxic(spark, docs, sf).collect()
    assert same(kept, [r for r in rows if model.scores([(r.text or "").encode()])[0] < 0.7]) and len(kept) < len(rows)

    rows, count = kept, {}
    for r in rows:
        for key in {x.strip(" \t\n\r\x0b\x0c").lower() for x in (r.text or "").split("\n")} - {""}:
            count[key] = count.get(key, 0) + 1
    want = []
    for r in rows:
        text = None if r.text is None else "\n".join(x for x in r.text.split("\n") if count.get(x.strip(" \t\n\r\x0b\x0c").lower(), 0) < 10)
        want.append((r.doc_id, text))
    kept = pipeline.drop_frequent_lines(spark, table(rows), sf).collect()
    assert same([(r.doc_id, r.text) for r in kept], want) and not any("Shared Line" in (r.text or "") for r in kept)

    rows = kept
    kept = pipeline.drop_near_copies(spark, table(rows), sf).collect()
    assert same(kept, near_copies_gone(rows)) and len(kept) < len(rows)

    rows = kept
    tokens = lambda t: [x for x in __import__("re").split("[^0-9a-z\x80-\U0010ffff]+", decontam.lowered(t).decode()) if x]
    items = [tokens(item)]
    kept = pipeline.drop_leaked(spark, table(rows), sf).collect()
    clean = [r for r in rows if not any(greedy(i, tokens(r.text), 5) >= 0.7 * len(i) for i in items if set(i) & set(tokens(r.text))) and tokens(r.text) != ["word1", "word2"]]
    assert same(kept, clean) and len(kept) == len(rows) - 2

    import duckdb

    table(kept).write.parquet(str(tmp_path / "mixed.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/mixed.parquet/*.parquet')")
    found = db.sql(queries.OP3_SQL)
    mixed = pipeline.mix(spark, table(kept), sf)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(mixed.columns) == names and same([tuple(plain(r[n]) for n in names) for r in mixed.collect()], [tuple(plain(r[i]) for i in at) for r in found.fetchall()])
    assert pipeline.run(spark, sf).count() == len(kept)


def test_empty_tables(spark, pipeline, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
