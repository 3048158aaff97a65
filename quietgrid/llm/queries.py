"""The registered queries of the text operators: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontam, html_blocks, lexical, line_dedup, lm_hmm, mixing, pieces, repetition, simhash, suffix_dedup, toxicity, weak_quality


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_hmm.score_texts(_read(spark, sf_dir, "documents"), toxicity.remainder("doc_id", 10) != 0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_main_text(_read(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return weak_quality.score_quality(docs, weak_quality.train_quality(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = toxicity.remainder("doc_id", 3) == 1
    model = toxicity.train_toxicity(docs, _read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model, 0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup_report(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"), radius=2)


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_read(spark, sf_dir, "documents"), min_docs=10)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoding_report(_read(spark, sf_dir, "documents"), pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(_read(spark, sf_dir, "conversations")), copies_col="copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm_scoring, op2_html_extraction, op3_mixing, op4_weak_quality, op5_toxicity, op6_decontamination, op7_suffix_dedup, op8_simhash, op9_repetition, op10_line_dedup, op11_lexical_search, op12_sentencepiece, op13_conversation_repair)}


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {WS}), {AZ}) AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r, k.doc_id
"""


OP3_SQL = r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk, sum(source_size) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, 1 + rnk % 3 AS w, 3 * source_size / (1 + rnk % 3)::DOUBLE AS ratio FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lvl
       FROM s2 WINDOW b AS (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT lvl FROM s3 WHERE ratio > lvl ORDER BY ratio, rnk LIMIT 1) AS l FROM s3),
s AS (SELECT source, rnk, source_size, total, ceil(n / 5000.0)::BIGINT AS shards,
             coalesce(least(l * w, 3.0::DOUBLE * source_size), 0)::DOUBLE AS target FROM s4),
p AS (SELECT z.*, s.rnk, s.source_size, s.total, s.target, ('0x' || substr(z.draw, 1, 8))::BIGINT % s.shards AS shard
      FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
c0 AS (SELECT rnk, shard, sum(size)::BIGINT AS cell, any_value(source_size) AS source_size, any_value(target) AS target, any_value(total) AS total FROM p GROUP BY ALL),
c AS (SELECT *, target * cell / source_size AS share, floor(target * cell / source_size / 16 + 0.5)::BIGINT AS seats FROM c0 WHERE cell > 0),
k AS (SELECT (floor(max(total) / 16.0) - sum(seats))::BIGINT AS lack, count(*) AS nc FROM c),
t0 AS (SELECT c.*, k.lack, unnest(range(0, ceil(share / total * (abs(lack) + nc))::BIGINT + 2)) AS i FROM c, k WHERE lack <> 0),
t AS (SELECT *, CASE WHEN lack > 0 THEN share / (2 * (seats + i) + 1) ELSE -share / (2 * (seats - i) - 1) END AS q FROM t0 WHERE lack > 0 OR seats > i),
m AS (SELECT rnk, shard, sum(sign(lack))::BIGINT AS more FROM (SELECT *, row_number() OVER (ORDER BY q DESC, rnk, shard, i) AS place FROM t) WHERE place <= abs(lack) GROUP BY ALL),
q AS (SELECT c.rnk, c.shard, seats + coalesce(more, 0) AS quota, ceil(cell / 16.0)::BIGINT AS blocks FROM c LEFT JOIN m USING (rnk, shard)),
u AS (SELECT p.*, sum(size) OVER (PARTITION BY rnk, shard ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM p)
SELECT doc_id, source, size, source_size, target,
       coalesce(least(quota // blocks * size + greatest(0, least(upto, quota % blocks * 16) - (upto - size)), 3 * size), 0)::BIGINT AS taken
FROM u LEFT JOIN q USING (rnk, shard)
"""


OP9_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, n, unnest(range(len(ws) - n + 1)) AS i, ws FROM w, (VALUES (2), (5), (10)) v(n) WHERE len(ws) >= n),
h AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, array_to_string(ws[i + 1 : i + n], ' ')) AS c FROM g),
m AS (SELECT DISTINCT r, n, i + k AS i FROM (SELECT r, n, i, unnest(range(n)) AS k FROM h WHERE c > 1)),
s AS (SELECT r, n, count(*) AS words, sum(length(word)) AS chars FROM m JOIN p USING (r, i) GROUP BY r, n),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM w)),
x AS (SELECT r, count(*) FILTER (nth > 1 AND len(lw) > 0) AS n_dup_lines, sum(CASE WHEN nth > 1 THEN strlen(array_to_string(lw, '')) ELSE 0 END) AS dup_bytes FROM l GROUP BY r),
b AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines,
 dup_bytes / greatest(1, strlen(array_to_string(ws, '')))::DOUBLE AS dup_line_share,
 coalesce((SELECT words FROM s WHERE s.r = w.r AND n = 5), 0)::BIGINT AS n_repeat_words,
 coalesce((SELECT chars FROM s WHERE s.r = w.r AND n = 2), 0) / greatest(1, length(array_to_string(ws, '')))::DOUBLE AS dup_2gram_share,
 coalesce((SELECT chars FROM s WHERE s.r = w.r AND n = 5), 0) / greatest(1, length(array_to_string(ws, '')))::DOUBLE AS dup_5gram_share,
 coalesce((SELECT chars FROM s WHERE s.r = w.r AND n = 10), 0) / greatest(1, length(array_to_string(ws, '')))::DOUBLE AS dup_10gram_share FROM w JOIN x USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_share, dup_2gram_share, dup_5gram_share, dup_10gram_share, base_failed,
 NOT base_failed AND dup_line_share <= 0.30 AND n_symbols <= 0.10::DOUBLE * word_chars AND dup_2gram_share <= 0.95 AND dup_5gram_share <= 0.20 AND dup_10gram_share <= 0.15 AS kept FROM f
"""


TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {TERM}) AS ts FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {TERM}) AS ts FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
t AS (SELECT q, term, count(*)::BIGINT AS often FROM (SELECT q, unnest(ts) AS term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT q, r, doc_id, sum(often * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM t JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN q USING (q) WHERE rank <= 10
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, as an expression."""
    turn = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {turn}))"


OP13_SQL = f"""
WITH RECURSIVE
o AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations),
g AS (SELECT c, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
             CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
h AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS r, rtrim(text, {WS}) AS short FROM g),
e AS (SELECT *, CASE WHEN short = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN right(short, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS flaw,
             lag(r) OVER (PARTITION BY c ORDER BY i) || r AS pair FROM h),
z AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (flaw = 'b') AS blank, count(*) FILTER (flaw = 'd') AS duplicate,
             count(*) FILTER (flaw = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY c),
ways AS (SELECT p, k, CASE WHEN k = 0 THEN p WHEN (k = 1) = (p = 'U') THEN 'A' WHEN k = 2 AND p <> 'U' THEN 'A' ELSE 'U' END AS q, repeat('I', k) AS ins,
                CASE WHEN k = 0 THEN '' WHEN p = 'U' THEN chr(10) || 'assistant:' || (CASE k WHEN 2 THEN chr(10) || 'user:' ELSE '' END)
                     ELSE chr(10) || 'user:' || (CASE k WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END) END AS said
         FROM (VALUES ('E'), ('S'), ('U'), ('A')) a(p), (VALUES (0), (1), (2)) b(k)),
steps AS (SELECT p, k, ins, said, q, op FROM ways, (VALUES ('D'), ('R'), ('K')) v(op)),
dp AS (SELECT c, 0::BIGINT AS i, 'E' AS st, 0::BIGINT AS cost, '' AS audit, '' AS body FROM z
       UNION ALL
       SELECT c, i, st, b.cost, b.audit, b.body FROM (
         SELECT c, i, st, min(struct_pack(cost := cost, audit := audit, body := body)) AS b FROM (
           SELECT dp.c, e.i, CASE op WHEN 'D' THEN q WHEN 'R' THEN CASE q WHEN 'U' THEN 'A' ELSE 'U' END ELSE upper(e.r) END AS st,
                  dp.cost + 3 * k + CASE op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN op <> 'D' AND flaw = 't' THEN 3 ELSE 0 END AS cost,
                  dp.audit || ins || op AS audit,
                  dp.body || said || CASE op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || CASE q WHEN 'U' THEN 'assistant:' ELSE 'user:' END || e.text ELSE chr(10) || e.role || ':' || e.text END AS body
           FROM dp JOIN e ON e.c = dp.c AND e.i = dp.i + 1 JOIN steps ON steps.p = dp.st
           WHERE op = 'D' OR (flaw NOT IN ('b', 'd') AND (op = 'R' OR (e.r = 's' AND q = 'E') OR (e.r = 'u' AND q IN ('E', 'S', 'A')) OR (e.r = 'a' AND q = 'U'))))
         GROUP BY c, i, st)),
fin AS (SELECT dp.c, min(struct_pack(cost := cost + 3 * k, audit := audit || ins, body := body || said)) AS b
        FROM dp JOIN z ON z.c = dp.c AND z.n = dp.i JOIN ways ON p = st AND (q = 'A' OR (q = 'E' AND k = 0)) GROUP BY dp.c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(fin.b.cost, 0)::BIGINT AS cost, coalesce(fin.b.audit, '') AS audit, sha256(coalesce(substr(fin.b.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM o) LEFT JOIN z USING (c) LEFT JOIN fin USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op9_repetition": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op13_conversation_repair": OP13_SQL}
