"""Truth is labels; predictions come from the length of documents, and order lines stand for classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics
from .registry import Tables, query

c = F.col
R6 = ("precision", "recall", "f1", "fbeta", "accuracy")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


JOINED = "WITH j AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS guess FROM documents d JOIN labels l USING (doc_id))\n"


def joined(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id").withColumn("guess", (c("n_chars") > 1500).cast("int"))


def binary_sql(t: str, p: str, by: str = "", beta: float = 2.0) -> str:
    n = f"SELECT {by}{', ' if by else ''}count(*) FILTER ({t} > 0 AND {p} > 0) AS tp, count(*) FILTER ({t} <= 0 AND {p} > 0) AS fp, count(*) FILTER ({t} <= 0 AND {p} <= 0) AS tn, count(*) FILTER ({t} > 0 AND {p} <= 0) AS fn"
    b = beta * beta
    return n, f"tp, fp, tn, fn, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce({1 + b} * tp / nullif({1 + b} * tp + fp + {b} * fn, 0)::DOUBLE, 0), 6) AS fbeta, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy"


_N, _M = binary_sql("quality", "guess", "lang")


@query("A17_binary_metrics", JOINED + f", n AS ({_N} FROM j GROUP BY lang) SELECT lang, {_M} FROM n")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.binary_metrics(joined(t), c("quality"), c("guess"), ["lang"]), *R6)


_N1, _M1 = binary_sql("toxic", "guess")


@query("A18_generic_binary", JOINED + f", n AS ({_N1} FROM j) SELECT {_M1} FROM n")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.generic_binary_metrics(joined(t), ("y_true", "toxic"), ("y_pred", "guess")), *R6)


CLASSES = "WITH j AS (SELECT l_returnflag AS t, CASE WHEN l_tax > 0.05 THEN 'A' WHEN l_discount > 0.03 THEN l_returnflag ELSE 'X' END AS p FROM lineitem), k AS (SELECT t AS label FROM j UNION SELECT p FROM j), n AS (SELECT label, (SELECT count(*) FROM j WHERE t = label AND p = label) AS tp, (SELECT count(*) FROM j WHERE t = label) AS tt, (SELECT count(*) FROM j WHERE p = label) AS pp FROM k), m AS (SELECT label, tp, pp - tp AS fp, tt - tp AS fn, tt AS support, coalesce(2 * tp / nullif(tt + pp, 0)::DOUBLE, 0) AS f1 FROM n)\n"


def classed(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_returnflag").alias("t"), F.when(c("l_tax") > 0.05, "A").when(c("l_discount") > 0.03, c("l_returnflag")).otherwise("X").alias("p"))


@query("A19_class_metrics", CLASSES + "SELECT label, tp, fp, fn, support, round(f1, 6) AS f1 FROM m")
def _(t: Tables) -> DataFrame:
    return metrics.class_metrics(classed(t), "t", "p").select("label", "tp", "fp", "fn", "support", F.round("f1", 6).alias("f1"))


@query("A19_multiclass_metrics", CLASSES + "SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6)::DOUBLE AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM m")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.multiclass_metrics(classed(t), "t", "p"), "accuracy", "macro_f1", "weighted_f1")


@query("A26_confusion_matrix", "SELECT l_returnflag AS t, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(t.lineitem.withColumnRenamed("l_returnflag", "t"), "t", "l_linestatus", ["F", "O"])


MULTI = JOINED + ", v AS (SELECT doc_id, [quality, toxic, CASE WHEN lang = 'en' THEN 1 ELSE 0 END] AS t, [guess, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END, CASE WHEN lang <> 'de' THEN 1 ELSE 0 END] AS p FROM j)\n"


def multi(t: Tables) -> DataFrame:
    return joined(t).select("doc_id", F.array("quality", "toxic", (c("lang") == "en").cast("int")).alias("t"), F.array("guess", (c("n_chars") % 7 == 0).cast("int"), (c("lang") != "de").cast("int")).alias("p"))


@query("A20_multilabel_metrics", MULTI + """, x AS (SELECT unnest(t) AS a, unnest(p) AS b, unnest(range(3)) AS k FROM v), n AS (SELECT k, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = b) AS ok, count(*) AS al FROM x GROUP BY k)
SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6)::DOUBLE AS micro_f1, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)), 6) AS macro_f1, round(sum(ok) / sum(al), 6)::DOUBLE AS hamming_accuracy, (SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0 END), 6)::DOUBLE FROM v) AS exact_match FROM n""")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.multilabel_metrics(multi(t), c("t"), c("p")), "micro_f1", "macro_f1", "hamming_accuracy", "exact_match")


SCORED = JOINED + ", v AS (SELECT [quality, toxic] AS t, [(n_chars % 100) / 100.0::DOUBLE, (n_chars % 37) / 37.0::DOUBLE] AS s FROM j), g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS threshold), p AS (SELECT threshold, t, list_transform(s, lambda x: CASE WHEN x >= threshold THEN 1 ELSE 0 END) AS p FROM v, g), m AS (SELECT threshold, avg(coalesce(2 * (t[1] * p[1] + t[2] * p[2]) / nullif(t[1] + t[2] + p[1] + p[2], 0)::DOUBLE, 0)) AS samples_f1, avg((abs(t[1] - p[1]) + abs(t[2] - p[2])) / 2.0::DOUBLE) AS hamming_loss, avg(CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0 END) AS subset_accuracy, avg((t[1] + t[2])::DOUBLE) AS cardinality FROM p GROUP BY threshold)\n"
_S = "round(samples_f1, 6) AS samples_f1, round(hamming_loss, 6) AS hamming_loss, round(subset_accuracy, 6) AS subset_accuracy, round(cardinality, 6) AS cardinality FROM m"
S4 = ("samples_f1", "hamming_loss", "subset_accuracy", "cardinality")


def scored(t: Tables) -> DataFrame:
    return joined(t).select(F.array("quality", "toxic").alias("t"), F.array(c("n_chars") % 100 / F.lit(100.0), c("n_chars") % 37 / F.lit(37.0)).alias("s"))


@query("A21_scored_multilabel", SCORED + f"SELECT {_S} WHERE threshold = 0.4")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.scored_multilabel(scored(t), c("t"), c("s"), F.lit(0.4)), *S4)


@query("A24_tune_threshold", SCORED + f"SELECT threshold, {_S} ORDER BY round(m.samples_f1, 9) DESC, threshold LIMIT 1")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.tune_threshold(scored(t), c("t"), c("s"), [0.2, 0.4, 0.6, 0.8]), *S4)


@query("A27_rollup_windows", "SELECT l_orderkey, max(l_discount) AS max_p, round(avg(l_discount), 6) AS mean_p, count(*) AS windows, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS truth, CASE WHEN max(l_discount) >= 0.08 THEN 1 ELSE 0 END AS pred FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey")
def _(t: Tables) -> DataFrame:
    truth = F.when(c("l_returnflag") == "A", "unlabeled").when(c("l_returnflag") == "R", "fall").otherwise("nonfall")
    return rounded(metrics.rollup_windows(t.lineitem.withColumn("truth_label", truth), "l_orderkey", "l_discount", "truth_label", 0.08), "mean_p")


@query("A28_average_runs", "WITH m AS (SELECT l_orderkey, l_returnflag, avg(l_discount) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag AS pred, round(p, 6) AS p FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY round(p, 9) DESC, l_returnflag) = 1")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.average_runs(t.lineitem, "l_orderkey", "l_returnflag", "l_discount"), "p")


@query("A30_label_map", "SELECT label, row_number() OVER (ORDER BY label) - 1 AS index FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)")
def _(t: Tables) -> DataFrame:
    return metrics.label_map(t.orders, "o_orderpriority").withColumn("index", c("index").cast("long"))


@query("K04_top_classes", "SELECT l_orderkey, rank, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    return metrics.top_classes(t.lineitem, "l_orderkey", "l_partkey", "l_extendedprice", 3).withColumn("rank", c("rank").cast("long"))


@query("W15_ranking_metrics", JOINED + """, s AS (SELECT lang, n_chars AS sc, sum(toxic) AS t, count(*) AS n FROM j GROUP BY ALL), k AS (SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY lang ORDER BY sc DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, round(sum(t * ct / cn::DOUBLE) / sum(t), 6)::DOUBLE AS average_precision, round(sum((n - t) * (ct - t / 2.0::DOUBLE)) / (sum(t) * (sum(n) - sum(t))), 6)::DOUBLE AS roc_auc FROM k GROUP BY lang HAVING sum(t) > 0 AND sum(n) > sum(t)""")
def _(t: Tables) -> DataFrame:
    return rounded(metrics.ranking_metrics(joined(t), ["lang"], "toxic", "n_chars"), "average_precision", "roc_auc")


@query("A22_frame_evaluation", JOINED + """SELECT count(*) AS matched, count(DISTINCT source) AS samples, round(avg(abs(n_chars % 5 - quality * 2)), 6) AS count_mae, round(avg(CASE WHEN n_chars % 5 = quality * 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match,
 round(avg(CASE WHEN toxic = 0 THEN guess END), 6) AS fpr, round(avg(CASE WHEN toxic = 1 THEN guess END), 6) AS recall FROM j""")
def _(t: Tables) -> DataFrame:
    out = metrics.frame_evaluation(joined(t), "source", c("quality") * 2, c("n_chars") % 5, c("toxic"), c("guess"))
    return rounded(out, "count_mae", "exact_match", "fpr", "recall")


@query("A23_background_fpr", "SELECT round(avg(CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fpr, count(*) AS n FROM (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE frame < 25")
def _(t: Tables) -> DataFrame:
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rounded(metrics.background_fpr(t.events.withColumn("frame", frame), "frame", c("value") > 60, 25), "fpr")


@query("A29_dataset_summary", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS quality_rate, count(*) FILTER (quality IS NULL) AS unlabeled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    return rounded(metrics.dataset_summary(d, ["source"], "lang", "quality").withColumnsRenamed({"classes": "langs", "positive_rate": "quality_rate"}), "quality_rate")


@query("U03_labels_missing_from_train", "SELECT DISTINCT p_type || p_size || p_brand AS label FROM part WHERE p_partkey % 5 = 0 EXCEPT SELECT p_type || p_size || p_brand FROM part WHERE p_partkey % 5 > 0")
def _(t: Tables) -> DataFrame:
    split = F.when(c("p_partkey") % 5 > 0, "train").otherwise("test")
    return metrics.labels_missing_from_train(t.part.select(F.concat("p_type", "p_size", "p_brand").alias("label"), split.alias("split")), "label", "split")
