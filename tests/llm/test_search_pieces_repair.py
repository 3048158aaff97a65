"""Ranked search, pieces and conversation repair against SQL, the tokenizer's library and brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quietgrid.llm import conversations, lexical, pieces, queries

DOCS = "doc_id long, text string, item_id long, rank int, score long, id string, ids int"


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def in_sql(sql: str, **tables) -> Counter:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_", df.toPandas().astype({c: "Int64" for c, t in df.dtypes if t == "bigint"}))
        con.sql(f"CREATE TABLE {name} AS SELECT {', '.join(f'{c}::{"BIGINT" if t == "bigint" else "VARCHAR"} AS {c}' for c, t in df.dtypes)} FROM {name}_")
    return Counter(con.sql(sql).fetchall())


# --- ranked search


def search_tables(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "The", "of", "Ünder", "x1", "é", *(f"w{i}" for i in range(60))])
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [texts[3]] * 15 + ["", None, " .,; ", "the " * 3000 + "w1", "w1-w2_w3\x7fw4\x00w5", "日本 w7"]
    rows = [(i if i % 9 else None, t, 1, 2, 3, "x", 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]
    items = [(1, "w1 w2 W3"), (2, None), (3, ""), (1, "w1 w2 W3"), (None, "the the Ünder of"), (4, texts[3]), (5, "absent"), (6, "x1 " * 50), (7, "日本")]
    return spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_search_equals_sql(spark):
    docs, items = search_tables(spark)
    want = in_sql(queries.OP11_SQL, documents=docs.select("doc_id", "text"), benchmark=items)
    for most in (4096, 2):  # one block, and several
        got = lexical.search(docs, items, k=10, block_items=most)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert counted(got.collect()) == want
    assert any(r[3] > 0 for r in want) and 5 not in {r[0] for r in want}


def test_search_of_nothing(spark):
    docs, items = search_tables(spark)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text = ''"), items).count() == 0


def test_search_confirms_words(spark):
    """A word that only shares a term's hash and length is no hit."""
    index = lexical.build_index([1], [b"alpha beta"])
    w = lexical.words([b"alpha gamma beta"], lexical.BREAKS)
    assert index.find(w)[0].tolist() == [0, 2]
    forged = lexical.Index(**{**index.__dict__, "text": index.text[::-1].copy()})
    assert forged.find(w)[0].tolist() == []


# --- pieces

TEXTS = ["", None, " ", "a", "▁x", "\x00a", "日本𠮷 x", "  a", " a  b   ", "<s> x </s>", "<0x41> é", "ﬁ ①Ａ  ", "\t a\n\nb", "�", "ｶﾞ ㍿", "ab" * 50 + " " * 40 + "z", "no space " * 3000, "x" * 3000]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    data = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece, data, sentencepiece.SentencePieceProcessor(model_proto=data)


def same_as_library(model: pieces.Model, own, text: str) -> None:
    ids, starts, ends = model.encode(text.encode())
    assert ids.tolist() == own.encode(text, add_bos=True, add_eos=True)
    assert model.decode(ids.tolist()) == own.decode(ids.tolist())
    spans = [(p.id, p.begin, p.end) for p in own.encode(text, return_type="proto").pieces]
    assert list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))[1:-1] == spans


def test_pieces_equal_the_library(library):
    _, data, own = library
    model, rng = pieces.Model(data), random.Random(1)
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice("ab é日𠮷\t\n ▁ﬁ①́Ａ.") for _ in range(rng.randint(0, 40))) for _ in range(300)]:
        same_as_library(model, own, text)


def test_character_map(library):
    """The same pieces under a compiled character map of two hundred kilobytes, with and without squeezed spaces."""
    sentencepiece, data, _ = library
    from sentencepiece import sentencepiece_model_pb2 as proto

    merged, rules = proto.ModelProto(), proto.ModelProto()
    merged.ParseFromString(data)
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    merged.normalizer_spec.CopyFrom(rules.normalizer_spec)
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab é日\t\n ﬁ①́Ａ㍿　.") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for dummy, squeeze in itertools.product((True, False), repeat=2):
        merged.normalizer_spec.add_dummy_prefix, merged.normalizer_spec.remove_extra_whitespaces = dummy, squeeze
        new = merged.SerializeToString()
        model, own = pieces.Model(new), sentencepiece.SentencePieceProcessor(model_proto=new)
        for text in texts:
            same_as_library(model, own, text)


def test_other_models_are_refused(library):
    from sentencepiece import sentencepiece_model_pb2 as proto

    other = proto.ModelProto()
    other.ParseFromString(library[1])
    other.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="byte-pair"):
        pieces.Model(other.SerializeToString())


def test_pieces_on_a_table(spark, library):
    _, data, own = library
    rows = [(i, t, 1, 2, 3, "x", 4) for i, t in enumerate(TEXTS)] + [(None, "a", 1, 2, 3, "x", 4)] * 2
    docs = spark.createDataFrame(rows, DOCS).drop("ids").repartition(3)
    for r in pieces.decode(pieces.encode(docs, data), data).collect():
        text = r.text or ""
        assert r.ids == own.encode(text, add_bos=True, add_eos=True) and r.decoded == own.decode(r.ids)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
    got = counted(pieces.encoding_report(docs, data).collect())
    want: Counter = Counter()
    for r in rows:
        ids = own.encode(r[1] or "", add_bos=True, add_eos=True)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[r[0], len(ids), len((r[1] or "").encode()), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert pieces.encoding_report(docs.limit(0), data).count() == 0


# --- conversations


def cheapest(kinds: list[str]) -> tuple[int, str]:
    """Cost and least audit by trying every edit."""
    best = {(): {"": (0, "")}}
    best = {"": (0, "")}
    legal = lambda said: not said or __import__("re").fullmatch("s?(ua)*u?", said)
    key = lambda said: (said[:1] == "s", said[-1:])
    for kind in kinds:
        grown: dict = {}
        for said, (cost, audit) in best.items():
            for n in range(3):
                for ins in itertools.product("ua", repeat=n):
                    front = said + "".join(ins)
                    more = 3 if kind[1] == "t" else 0
                    ways = [(front, 4, "D")]
                    if kind[1] != "x":
                        ways += [(front + r, 3 + more, "R") for r in "ua"] + ([(front + kind[0], more, "K")] if kind[0] in "sua" else [])
                    for out, price, edit in ways:
                        if legal(out):
                            new = (cost + 3 * n + price, audit + "I" * n + edit, out)
                            at = key(out)
                            grown[at] = min(grown.get(at, new), new)
        best = {out: (cost, audit) for cost, audit, out in grown.values()}
    ends = []
    for said, (cost, audit) in best.items():
        for n in range(3):
            for ins in itertools.product("ua", repeat=n):
                if not said + "".join(ins) or __import__("re").fullmatch("s?(ua)+", said + "".join(ins)):
                    ends.append((cost + 3 * n, audit + "I" * n))
    return min(ends)


def audit_of(kinds: list[str]) -> tuple[int, str]:
    states = conversations.crossings([conversations.row_element(k) for k in kinds], 0, conversations.END)
    edits = conversations.repaired([k[0].replace("-", "?") for k in kinds], ["t"] * len(kinds), states, kinds, 0, True)
    cost = sum(conversations.row_edits(k)[p][q][0] for k, p, q in zip(kinds, [0, *states], states, strict=False)) + conversations.END[states[-1]]
    return cost, "".join(e for e, _, _ in edits)


def test_repairs_are_the_cheapest_and_least():
    rng = random.Random(4)
    all_kinds = [a + b for a in "sua-" for b in "xt."]
    for _ in range(400):
        kinds = [rng.choice(all_kinds) for _ in range(rng.randint(1, 9))]
        assert audit_of(kinds) == cheapest(kinds), kinds


def test_elements_join_alike():
    """Runs of rows as elements give the states that rows give."""
    rng = random.Random(6)
    for _ in range(100):
        rows = [conversations.row_element(rng.choice("sua-") + rng.choice("xt.")) for _ in range(rng.randint(2, 30))]
        whole = conversations.crossings(rows, 0, conversations.END)
        step = rng.randint(1, 5)
        runs = [conversations.joined(rows[i : i + step]) for i in range(0, len(rows), step)]
        assert conversations.crossings(runs, 0, conversations.END) == [*whole[step - 1 :: step], *([whole[-1]] if len(rows) % step else [])]


def talk(spark, rng):
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c % 11 else None, t if rng.random() < 0.9 else None, role, rng.choice([f"Text {rng.randint(0, 30)}.", "cut off", "", " \t", None, "Same."])))
    rows += [(77, t, ("user", "assistant")[t % 2], f"Long {t % 23}{'.' if t % 7 else ''}") for t in range(400)]
    rows += [(78, 1, "user", "Equal.")] * 60 + [(78, 2, "assistant", "Reply.")]
    rows += [(79, 5, "user", "  ")] * 12
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_repair_equals_sql(spark):
    table = talk(spark, random.Random(8))
    want = in_sql(queries.OP13_SQL, conversations=table)
    odd = conversations.damaged(table).selectExpr("*", "1 AS conv", "2 AS part", "3 AS run", "4 AS key", "5 AS node", "6 AS again").repartition(3)
    for rows, fan in ((1000, 64), (7, 2), (3, 64)):  # conversations in one slice, and in many, over several rounds
        got = conversations.repair_report(odd, copies_col="copies", slice_rows=rows, fan=fan)
        assert counted(got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()) == want, rows
    assert {r[0] for r in want} == {r.conv_id for r in table.collect()}


def test_repaired_rows_alternate(spark):
    table = talk(spark, random.Random(9))
    rows = conversations.repair_conversations(table, slice_rows=5, fan=3).orderBy("conv_id", "part", "slice", "place").collect()
    for _, own in itertools.groupby(rows, key=lambda r: r.conv_id):
        own = list(own)
        said = "".join(r.role[:1] for r in own if r.edit != "D")
        assert not said or __import__("re").fullmatch("s?(ua)+", said)
        assert all(r.text == "" for r in own if r.edit == "I")


def test_repair_of_nothing(spark):
    table = talk(spark, random.Random(9))
    assert conversations.repair_report(table.limit(0)).count() == 0
    gone = conversations.repair_report(table.withColumn("n", F.lit(0)), copies_col="n")
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.cost == 0 and r.audit == "" and r.repaired_sha256 == nothing for r in gone.collect()) and gone.count() == table.select("conv_id").distinct().count()
