"""The text operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quietgrid.llm import decontam, html_blocks, line_dedup, lm_hmm, mixing, repetition, simhash, suffix_dedup, text, toxicity, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, found int, key int"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(40)]
    shared = " ".join(word() for _ in range(70))
    for i in range(0, 12):
        texts[i] = f"{texts[i]} {shared} {texts[i][::-1]}"
    texts += [texts[20], texts[21] + " x", "ab " * 300, "Line A \nline a\n LINE A\t\nother", "\n".join(["Menu", "menu ", texts[5]]), "émile Ünder * ß\x0b\x1cw"]
    texts += [f"Same Line\n{texts[i]}" for i in range(12)] + ["", None, "  ", "z", "word " * 4000]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "a", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], "en", "s1", 5, "a", 1, 2), (None, None, None, None, None, None, None, None)]


ROWS = corpus()
BYTES = [(r[0], (r[1] or "").encode()) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows) -> Counter:
    return Counter(map(tuple, rows))


def test_word_kernel_agrees_with_split():
    texts = [b for _, b in BYTES]
    for a, b in text.chunks(texts, 2000):
        w = text.words(texts[a:b])
        for r, t in enumerate(texts[a:b]):
            own = [bytes(w.data[s:e]) for s, e in zip(w.starts[w.firsts[r] : w.firsts[r + 1]], w.ends[w.firsts[r] : w.firsts[r + 1]], strict=True)]
            assert own == t.lower().split()


def test_line_dedup(docs, none):
    n = Counter()
    for _, t in BYTES:
        n.update({x.strip().lower() for x in t.split(b"\n")} - {b""})
    want = []
    for i, t in BYTES:
        lines = t.split(b"\n")
        kept = [x for x in lines if n[x.strip().lower()] < 10 or not x.strip()]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    assert counted(line_dedup.line_dedup_report(docs, 10).collect()) == counted(want)
    assert counted(line_dedup.line_dedup_report(docs, 10, shard_keys=20, probes=15).collect()) == counted(want)
    odd = docs.withColumns({"_found": F.lit(1), "row_key": F.lit(2), "row": F.lit(3), "_key": F.lit(4)})
    assert line_dedup.drop_frequent_lines(odd, 10).columns == odd.columns and line_dedup.drop_frequent_lines(odd, 10).count() == len(ROWS)
    kept = line_dedup.drop_frequent_lines(docs, 10)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) and not kept.where("text like '%Same Line%'").count()
    assert line_dedup.line_dedup_report(none).count() == 0


def test_simhash(docs, none):
    fps = []
    for i, t in BYTES:
        w = t.lower().split()
        n = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)] if w else []
        fps.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    of = {}
    for i, f in fps:
        if i is not None:
            of[f] = min(i, of.get(f, i))
    top = {i: i for i in of.values()}
    changed = True
    while changed:
        changed = False
        for f, i in of.items():
            for g, j in of.items():
                if (f ^ g).bit_count() <= 2 and top[i] != top[j]:
                    top[i] = top[j] = min(top[i], top[j])
                    changed = True
    want = [(i, f"{f:016x}", top[of[f]] if f in of else None) for i, f in fps]
    assert counted(simhash.simhash_components(docs).collect()) == counted(want)
    assert simhash.simhash_components(none).count() == 0


def test_near_copies_leave_one(spark):
    rng = random.Random(5)
    base = [[str(rng.randint(0, 9999)) for _ in range(400)] for _ in range(6)]
    rows = []
    for g, words in enumerate(base):
        for k in range(4):
            w = list(words)
            for e in range(k):
                w[50 + 90 * e] = f"new{g}{k}{e}"
            rows.append((10 * g + k, " ".join(w), 1))
    df = spark.createDataFrame([*rows, (900, "", 1), (901, None, 1)], "doc_id long, text string, keeper int")
    kept = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 50, 900, 901] and kept.columns == df.columns


def test_near_copies_are_those_of_similarity_08(spark):
    rng = random.Random(11)
    rows, apart = [], []

    def pair(base: str, other: str) -> float:
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base.split(), other.split()))
        rows.extend([(len(rows), base), (len(rows) + 1, other)])
        similar = len(a & b) / len(a | b)
        if similar < 0.8:
            apart.append(len(rows) - 1)
        return similar

    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    seen = []
    for edits in [9] * 60 + [10] * 60 + [15] * 40 + [20] * 40:  # an edit takes five shingles of 400 or so
        w = fresh(404)
        v = list(w)
        for e in range(edits):
            v[10 + 19 * e] = f"x{e}"
        seen.append(pair(" ".join(w), " ".join(v)))
    assert sum(0.6 <= x <= 0.75 for x in seen) > 50 and sum(0.75 < x < 0.8 for x in seen) > 30 and min(seen) > 0.55
    for cut in (75, 79, 85, 90):  # at 0.8 to 0.85: one passage new at the end
        for _ in range(30):
            w = fresh(404)
            new = 400 - round(400 * 2 * (x := cut / 100 + 0.012) / (1 + x))
            seen.append(pair(" ".join(w), " ".join(w[: 404 - new] + fresh(new))))
    assert sum(0.8 <= x <= 0.87 for x in seen) > 50
    w = fresh(300)
    assert pair(" ".join(w), " ".join(w + w[40:240])) > 0.9  # a passage stands twice
    short = "one two three four five six seven eight"
    assert pair(short + " nine", short) == 0.8
    rows += [(len(rows), "\t\n"), (len(rows) + 1, "\n\t"), (len(rows) + 2, None)]
    blank = [len(rows) - 3, len(rows) - 2, len(rows) - 1]
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=64).collect())
    assert got == sorted([*range(0, blank[0], 2), *apart, *blank])


def test_near_copies_with_repeated_ids_and_odd_columns(spark, none):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(words[::-1]), " ".join(words[:58] + ["x", "y"])
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (7, b, 0), (None, a, 0), (None, None, 0), (8, "\n\t", 0), (8, "\n\t", 0), (9, "one", 0), (10, "ONE", 0), (11, c, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keeper int")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (0, a), (0, None), (8, "\n\t"), (8, "\n\t"), (9, "one")], key=str)
    named = spark.createDataFrame([(str(i), t, 0) for i, t, _ in rows if i], "name string, body string, text_key int")
    assert simhash.drop_near_duplicates(named, id_col="name", text_col="body").count() == 5
    assert simhash.simhash_components(named, id_col="name", text_col="body").count() == 9
    assert simhash.drop_near_duplicates(none).count() == 0


def test_many_copies_in_small_tiles(spark):
    fps = [(i, (i % 7 << 32 | i).to_bytes(8, "little"), 0) for i in range(64)]
    nodes = spark.createDataFrame(fps, "node long, fp binary, size long")
    links = simhash.fingerprint_links(nodes, 2, tile=4).collect()
    value = {n: int.from_bytes(f, "little") for n, f, _ in fps}
    assert all((value[r.a] ^ value[r.b]).bit_count() <= 2 for r in links)
    top = {n: n for n in value}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in links:
        a, b = find(r.a), find(r.b)
        top[max(a, b)] = min(a, b)
    assert all(find(a) == find(b) for a in value for b in value if (value[a] ^ value[b]).bit_count() <= 2)


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs, block=4, shard_docs=10).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert counted((r.doc_id, r.source, r["size"]) for r in rows) == counted((r[0], r[3], size(r[1])) for r in ROWS)
    total = Counter()
    for r in ROWS:
        total[r[3]] += size(r[1])
    names = [*sorted(x for x in total if x is not None), None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left = sum(total.values()) - sum(target[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
            fixed.add(s)
    taken = Counter()
    for r in rows:
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 80 for s in names)
    assert counted(mixing.mix_sources(docs.repartition(5), block=4, shard_docs=10).collect()) == counted(rows)
    assert mixing.mix_sources(none).count() == 0


def test_decontamination(spark, docs, none):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.lower().split()
    cases = [(0, item), (1, "x " + item.upper().replace(" ", ", ") + " y"), (2, " ".join(w[10:] + ["and"] + w[:10])), (3, " ".join(w[:9])), (4, "nothing here"), (5, None), (6, " ".join(w[::-1])), (7, ("pad " * 3000) + item)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (8, "too short"), (7, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_tiles for r in decontam.benchmark_matches(df, bench).collect()}
    assert got == {(0, 9): 1, (1, 9): 1, (2, 9): 2, (7, 9): 1}
    small = spark.createDataFrame([(3, "Yes\u2014no!"), (4, item.replace("gamma", "\u201cgamma\u201d")), (5, "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u770b\u7535\u5f71")], "n smallint, body string")
    texts = spark.createDataFrame([("a", "yes. no"), ("b", "yes and no"), ("c", "x " + item), ("d", "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u770b\u7535\u5f71\u3002"), ("e", "")], "name string, t string")
    pairs = decontam.benchmark_matches(texts, small, id_col="name", text_col="t", item_col="n", item_text="body")
    assert sorted((r.name, r.n, r.coverage) for r in pairs.collect()) == [("a", 3, 1.0), ("c", 4, 1.0), ("d", 5, 1.0)]
    assert sorted(r.name for r in decontam.drop_contaminated(texts, small, text_col="t", item_col="n", item_text="body").collect()) == ["b", "e"]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, bench).collect()) == [3, 4, 5, 6]
    assert decontam.benchmark_matches(docs, bench).count() == 0 and decontam.benchmark_matches(none, bench).count() == 0
    assert decontam.benchmark_matches(df, bench.where("false")).count() == 0


def test_tiles_are_greedy_and_disjoint():
    rng = random.Random(1)
    for _ in range(40):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 40))], dtype=np.uint64) for _ in range(2))
        free_a, free_b, want = [True] * len(a), [True] * len(b), 0
        while True:
            best = 0
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n > best:
                        best, at = n, (i, j)
            if best < 3:
                break
            for k in range(best):
                free_a[at[0] + k] = free_b[at[1] + k] = False
            want += best
        assert sum(n for _, _, n in decontam.tile(a, b, 3)) == want


@pytest.mark.parametrize("shard_units", [4096, 2])
def test_suffix_dedup(docs, shard_units, monkeypatch):
    n = Counter()
    for _, t in BYTES:
        n.update(t[k : k + 200] for k in range(len(t) - 199))
    want = []
    for i, t in BYTES:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - 199):
            if n[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        gone = gone[: len(t)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", ("doc_id", "text", shard_units))
    assert counted(suffix_dedup.suffix_dedup_report(docs).collect()) == counted(want)


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for t in (b"", b"a", b"aaaa" * 30, b"abab" * 40, bytes(rng.choice(b"ab") for _ in range(300))):
        data = np.frombuffer(t, dtype=np.uint8)
        order = suffix_dedup.suffix_array(data)
        assert [t[i:] for i in order] == sorted(t[i:] for i in range(len(t)))
        got = suffix_dedup.common_prefixes(data, order, np.array([0]), np.array([len(t)]), 50)
        for a, b in zip(order[:-1], order[1:], strict=True):
            k = 0
            while k < 50 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert got[b] == k


def test_suffix_dedup_of_nothing(none):
    assert suffix_dedup.suffix_dedup_report(none).count() == 0


def test_repetition_counts(docs, none):
    want = []
    for r in ROWS:
        x = r[1] or ""
        w = re.findall("[^\x20\x09-\x0d]+", x)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            dup += bool(re.search("[^\x20\x09-\x0d]", line)) and line in seen
            seen.add(line)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)))
    out = repetition.repetition_rules(docs)
    assert counted(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == counted(want)
    assert out.where("base_failed and kept").count() == 0 and repetition.repetition_rules(none).count() == 0


def test_hmm_scores(docs, none):
    held = toxicity.remainder("doc_id", 10) != 0
    got = lm_hmm.score_texts(docs, held).collect()
    tokens = [(i, [*t.lower().split(), None]) for i, t in BYTES]
    c = Counter()
    for i, w in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    base = lambda w: sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
    want = sorted((i if i is not None else -1, len(w), sum(c[x] > 0 for x in w), round(base(w), 5)) for i, w in tokens)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) for r in got)
    assert lm_hmm.score_texts(none, held).count() == 0


@pytest.mark.parametrize("piece", [256, 2, 1])
def test_forward_recursion_and_counts_against_enumeration(piece, monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(lm_hmm, "STATES", 3)
    k, s = lm_hmm.STATES, 4
    emit = np.zeros((lm_hmm.SYMBOLS + 1, k))
    emit[:s] = rng.random((s, k))
    model = lm_hmm.Hmm(np.full(k, 1 / k), rng.dirichlet(np.ones(k), k), emit / emit.sum(axis=0))
    seqs = [np.array([0, 3, 1]), np.array([2]), np.array([1, 1]), np.array([1, 0, 2, 3, 3])]
    syms, firsts = np.concatenate(seqs), np.array([0, 3, 4, 6, 11])
    monkeypatch.setattr(lm_hmm, "PIECE", piece)
    into, want_move, logs = lm_hmm.Counts.zero(k), np.zeros((k, k)), []
    for seq in seqs:
        paths = np.stack(np.meshgrid(*[np.arange(k)] * len(seq), indexing="ij"), -1).reshape(-1, len(seq))
        p = model.start[paths[:, 0]] * model.emit[seq[0], paths[:, 0]]
        for t in range(1, len(seq)):
            p = p * model.move[paths[:, t - 1], paths[:, t]] * model.emit[seq[t], paths[:, t]]
        logs.append(math.log(p.sum()))
        for t in range(1, len(seq)):
            np.add.at(want_move, (paths[:, t - 1], paths[:, t]), p / p.sum())
    lm_hmm.expect(model, syms, firsts, into)
    assert np.allclose(lm_hmm.likelihood(model, syms, firsts), logs) and np.allclose(into.move, want_move) and np.isclose(into.emit.sum(), 11) and np.isclose(into.start.sum(), 4)


def test_html_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now for less</div>
    <article><h1>A&amp;B</h1><p><b>One  two<br>three</b></p><p>Sthe.</p><div class="comments"><p>I say no to all of this and more</p></div><p>Last &lt;b&gt; &nbsp; end</article><footer>&copy; x</footer>"""
    rows = {r.page_id: r for r in html_blocks.extract_main_text(spark.createDataFrame([(1, "u", page, 3), (2, "v", None, 3), (3, "w", "", 3), (4, None, "<p>" + "word " * 50000, 3)], "page_id long, url string, html string, text int").select("page_id", "url", "html")).collect()}
    assert rows[1].text == "A&B\n\nOne two three\n\nSthe.\n\nLast <b> end" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == rows[3].text == "" and rows[4].n_chars == 249999


class ArticleText(HTMLParser):
    """An extractor of its own for pages whose story is one <article> without frame inside: the text of its blocks."""

    BLOCKS = set("p h1 h2 h3 li div article section td".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.found, self.now = 0, [], ""

    def cut(self):
        if self.now.split() and self.inside:
            self.found.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag == "br":
            self.now += " "
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or tag == "footer":
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.now += data


def test_html_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = []
    for r in pages.collect():
        parser = ArticleText()
        parser.feed(r.html or "")
        parser.close()
        text = "\n\n".join(parser.found)
        want.append((r.page_id, r.url, text, len(text)))
    assert counted(html_blocks.extract_main_text(pages).collect()) == counted(want) and all(x[3] for x in want)


def test_html_wrappers_keep_the_story(spark):
    story = "<article><h1>Title</h1><p>The first lines of the story.</p><p>Of.</p><div class='share-price'><p>The share rose by two.</p></div></article>"
    want = "Title\n\nThe first lines of the story.\n\nOf.\n\nThe share rose by two."
    wraps = ["<form id=aspnetForm>%s</form>", "<div class='site header-fixed'>%s</div>", "<div class='menu-open layout'>%s</div>", "<div class='sidebar'>%s</div>", "<div class='cookie-notice'><p>We use small files.</p></div>%s<div class='comments'><article><p>I think not, and at length, as readers do here.</p></article></div>", "<div><aside><article><p>Read this too</p></article></aside>%s<section id=comments><p>Well said by the paper</p></section></div>"]
    rows = [(i, "u", f"<html><body>{w % story}</body></html>", "x", 1) for i, w in enumerate(wraps)]
    plain = "<form id=f><div><p>Without any mark this page still tells a story of some length in a line.</p><p>It goes on for another line or so.</p></div></form>"
    rows += [(90, "u", plain, "x", 1), (90, "u", plain, "x", 1)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string, n_chars int")
    out = html_blocks.extract_main_text(df)
    assert [r.text for r in out.where("page_id < 90").orderBy("page_id").collect()] == [want] * len(wraps)
    assert [r.text.count("\n\n") for r in out.where("page_id = 90").collect()] == [1, 1]
    assert html_blocks.extract_main_text(df.where("false")).count() == 0


def test_html_scan_is_linear():
    for page in ("<a " * 100_000, "<!" * 100_000, "<a b=\"'>" * 50_000, "<script>" + "</script " * 50_000, "<a x='" * 100_000, "<div>" * 5_000 + "</p>" * 50_000):
        began = time.time()
        html_blocks.main_text(page)
        assert time.time() - began < 5


def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        w = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[3], w[20], w[30] = "zorkling" + rng.choice("xyz"), "grubhead", rng.choice(["zorklings", "zorklingo"])
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_and_scores_text_alone(spark, docs, none):
    df = labelled(spark)
    train = toxicity.remainder("doc_id", 3) != 1
    model = toxicity.train_toxicity(df.drop("toxic"), df.select("doc_id", F.lit(1).alias("quality"), "toxic"), train)
    scored = toxicity.score_toxicity(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(~train)
    assert scored.where("predicted <> toxic").count() == 0
    assert toxicity.score_toxicity(docs, model).count() == len(ROWS) and toxicity.score_toxicity(none, model).count() == 0
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 480
    untrained = toxicity.train_toxicity(none, df.where("false").select("doc_id", "toxic"), F.lit(True))
    plain, negated, reported = untrained.scores([b"you are an idiot and a moron, idiot", b"you are not an idiot", b"he said you idiot"])
    assert plain > 0.7 > max(negated, reported) and untrained.scores([b""])[0] < 0.1


def test_composed_grammar_ends():
    def end(*symbols: int) -> str | None:
        state = 0
        for s in symbols:
            state = toxicity.TABLE[state, s]
        k = toxicity.ENDS[state]
        return toxicity.PATTERNS[k] if k >= 0 else None

    o, i, th, ta, n, r = range(6)
    assert end(o) is None and end(th) is None and end(i) == "insult" and end(ta, o, i) == "insult_at" and end(th, ta) == "threat_at"
    assert end(n, o, i) == "negated" and end(n, o, o, o, i) == "insult" and end(ta, r, i) == "reported"


def test_weak_quality(spark, docs, none):
    rng = random.Random(9)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)) + "." for _ in range(300)]
    bad = [" ".join(f"{w}{rng.choice(['***', '$$$', '%%%'])}" for w in g.split()) for g in good[:25]] + [" ".join([g.split()[0]] * 60) for g in good[25:45]] + [g.upper().replace(" ", "!! ") for g in good[45:60]]
    df = spark.createDataFrame([(i, t, int(i < 300)) for i, t in enumerate(good + bad)], "doc_id long, text string, good int")
    model = weak_quality.train_quality(df)
    out = weak_quality.score_quality(df, model).join(df.select("doc_id", "good"), "doc_id")
    assert out.where("kept <> (good = 1)").count() <= 3
    assert weak_quality.score_quality(docs, model).count() == len(ROWS) and weak_quality.score_quality(none, weak_quality.train_quality(none)).count() == 0


def test_many_equal_rows(spark):
    """Ten thousand rows of a null id and one text: work and lists stay in proportion."""
    lines = [f"line number {i} of a text that is repeated as a whole" for i in range(12)]
    rows = spark.range(10_000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("\n".join(lines)).alias("text"))
    size = len("\n".join(lines))
    nothing = hashlib.sha256(b"").hexdigest()
    got = line_dedup.line_dedup_report(rows, 10, shard_keys=4, probes=1000).groupBy("n_lines", "n_dropped", "kept_sha256").count().collect()
    assert counted(got) == {(12, 12, nothing, 10_000): 1}
    got = suffix_dedup.suffix_dedup_report(rows).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    assert counted(got) == {(size, size, 1, nothing, 10_000): 1}
    lists = suffix_dedup.repeated_ranges(rows).select(F.size("ranges").alias("n")).collect()
    assert len(lists) == 1 and lists[0].n < size


def test_line_keys_that_share_half_a_hash(spark):
    counts = spark.createDataFrame([(5, 1, 3), (5, 2, 20), (6, 1, 30), (5, 3, 11)], "h1 long, h2 long, n long")
    shard = line_dedup.build_shards(counts, 1).toPandas().iloc[0]
    asked = np.array([[5, 1], [5, 2], [5, 3], [5, 4], [6, 1], [7, 1]])
    assert line_dedup._is_frequent(shard, asked, 10).tolist() == [False, True, True, False, True, False]


def test_quality_with_clashing_columns(spark):
    """Other columns are not read, whatever their names."""
    rows = [(i, ROWS[i % len(ROWS)][1]) for i in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = plain.selectExpr("*", "1 AS _id", "2 AS id", "3 AS pattern", "4 AS n", "5 AS f", "6 AS v", "7 AS score", "8 AS kept")
    model, other = weak_quality.train_quality(plain), weak_quality.train_quality(odd)
    assert np.allclose(model.weights, other.weights) and model.posterior == other.posterior
    assert counted(weak_quality.score_quality(odd, other).collect()) == counted(weak_quality.score_quality(plain, model).collect())


def test_quality_posterior_agrees_with_votes(spark):
    """More votes for good never lower the posterior, and the scorer follows the posterior on its own training texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = weak_quality.train_quality(docs)
    own = {tuple(p // 3**k % 3 for k in range(len(weak_quality.LABELLERS))): v for p, v in model.posterior.items()}
    rows = weak_quality.score_quality(docs, model).collect()
    weak, score = np.array([r.weak_label for r in rows]), np.array([r.score for r in rows])
    assert set(np.round(weak, 12)) <= set(np.round(list(own.values()), 12)) | {0.5}
    assert ((weak >= 0.5) == (score >= 0.5)).mean() > 0.9 and all(r.kept == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    hits = [(r.score >= 0.5) == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean(hits) > 0.85  # labels.quality, which the model never sees


def test_small_and_unmarked_pages():
    text = html_blocks.main_text
    assert text("<body><h1>Hi</h1><p>Yes.</p></body>") == "Hi\n\nYes."
    plain = "<body><div><a href=/>Home</a></div><div>A story of the long bridge over the wide river and of those who keep it.</div><div>Yes.</div><div>Many came to see it on the day it was opened again.</div><div>Copyright 2020</div></body>"
    assert text(plain) == "A story of the long bridge over the wide river and of those who keep it.\n\nYes.\n\nMany came to see it on the day it was opened again."
    assert text('<article><h1>T</h1><p>It goes on and on.</p><section id="discussion"><p>I do not agree with this.</p></section></article>') == "T\n\nIt goes on and on."
    assert text('<article><h1>T</h1><p>It goes on and on.</p><div class="widget"><p>A part in a box.</p></div></article>') == "T\n\nIt goes on and on.\n\nA part in a box."
    assert text('<article><p>It goes on.</p><div class="newsletter-widget"><p>Our letter, each week.</p></div></article>') == "It goes on."
    assert text("<nav><a href=/>Home</a></nav><footer>Copyright 2020</footer>") == "" == text(None) == text("")
