"""Scores of predictions against truth, by any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 on an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_columns(tp: Column, fp: Column, tn: Column, fn: Column, beta: float = 2.0) -> dict[str, Column]:
    b = beta * beta
    return {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "support": tp + fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fbeta": ratio((1 + b) * tp, (1 + b) * tp + fp + b * fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}


def binary_metrics(df: DataFrame, true: Column, pred: Column, by: list[str] | None = None, beta: float = 2.0) -> DataFrame:
    """Counts, precision, recall, F1, F-beta, accuracy; positive is above 0."""
    t, p = true > 0, pred > 0
    n = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    return n.select(*(by or []), *[v.alias(k) for k, v in binary_columns(*map(F.col, ("tp", "fp", "tn", "fn")), beta).items()])


def generic_binary_metrics(df: DataFrame, truths: tuple[str, ...], preds: tuple[str, ...]) -> DataFrame:
    """Binary metrics of the first truth and the first prediction column that the frame has."""
    pick = lambda names: F.col(next(n for n in names if n in df.columns)).try_cast("double")
    return binary_metrics(df, F.coalesce(pick(truths), F.lit(0.0)), F.coalesce(pick(preds), F.lit(0.0)))


def class_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) over the union of labels."""
    long = df.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    n = long.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")
    return n.select("label", "tp", fp.alias("fp"), fn.alias("fn"), F.col("t").alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def multiclass_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_f1)."""
    return class_metrics(df, true, pred).agg(F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    return df.groupBy(true).pivot(pred, labels).count().fillna(0)


def label_counts(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """(label, metrics) of multi-hot arrays."""
    long = df.select(F.posexplode(F.arrays_zip(true.alias("t"), pred.alias("p"))).alias("label", "v")).select("label", "v.t", "v.p")
    return binary_metrics(long, F.col("t"), F.col("p"), ["label"], 1.0)


def multilabel_metrics(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """(micro_f1, macro_f1, exact_match, hamming_accuracy) of multi-hot arrays."""
    labels = label_counts(df, true, pred).agg(ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("tp") + F.col("tn")), F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("hamming_accuracy"))
    return labels.crossJoin(df.agg(F.avg((true == pred).cast("double")).alias("exact_match")))  # two single rows


def scored_multilabel(df: DataFrame, true: Column, scores: Column, threshold: Column, by: list[str] | None = None) -> DataFrame:
    """(samples_f1, hamming_loss, subset_accuracy, cardinality) of scores cut at a threshold."""
    df = df.withColumn("_t", true).withColumn("_p", F.transform(scores, lambda s: (s >= threshold).cast("int")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, x: acc + x)
    both = total(F.zip_with("_t", "_p", lambda a, b: a * b))
    off = total(F.zip_with("_t", "_p", lambda a, b: (a != b).cast("int")))
    return df.groupBy(*(by or [])).agg(F.avg(ratio(2 * both, total(F.col("_t")) + total(F.col("_p")))).alias("samples_f1"), F.avg(off / F.size("_t")).alias("hamming_loss"), F.avg((off == 0).cast("double")).alias("subset_accuracy"), F.avg(total(F.col("_t"))).alias("cardinality"))


def tune_threshold(df: DataFrame, true: Column, scores: Column, grid: list[float], metric: str = "samples_f1") -> DataFrame:
    """The first best threshold of a grid and its metrics."""
    each = df.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))  # a fixed grid
    found = scored_multilabel(each, true, scores, F.col("threshold"), ["threshold"])
    return found.orderBy(F.desc(F.round(metric, 9)), "threshold").limit(1)


def rollup_windows(df: DataFrame, sample: str, probability: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """(sample, max_p, mean_p, windows, pred, truth) of each video; unlabelled ones are left out."""
    out = df.where(F.col(truth) != "unlabeled").groupBy(sample).agg(F.max(probability).alias("max_p"), F.avg(probability).alias("mean_p"), F.count("*").alias("windows"), F.max((F.col(truth) == "fall").cast("int")).alias("truth"))
    return out.withColumn("pred", (F.col("max_p") >= threshold).cast("int"))


def average_runs(df: DataFrame, sample: str, label: str, p: str) -> DataFrame:
    """(sample, pred, p): the class of the highest mean probability over runs, ties to the smaller class."""
    mean = df.groupBy(sample, label).agg(F.avg(p).alias("_m"))
    best = F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(F.round("_m", 9)), label))
    return mean.withColumn("_r", best).where("_r = 1").select(sample, F.col(label).alias("pred"), F.col("_m").alias("p"))


def label_map(df: DataFrame, label: str) -> DataFrame:
    """(label, index): sorted distinct labels from 0; no label is ``unknown``."""
    return df.select(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("unknown")).alias("label")).distinct().withColumn("index", F.row_number().over(Window.orderBy("label")) - 1)  # one row a class


def frame_evaluation(df: DataFrame, sample: str, true_count: Column, pred_count: Column, present: Column, guess: Column) -> DataFrame:
    """(matched, samples, count_mae, exact_match, fpr, recall) of matched frames: errors of the counts, and guesses of presence on frames without and with anybody."""
    off = F.abs(pred_count - true_count)
    rate = lambda k: F.avg(F.when(present == k, guess.cast("int")))
    return df.agg(F.count("*").alias("matched"), F.countDistinct(sample).alias("samples"), F.avg(off).alias("count_mae"), F.avg((off == 0).cast("double")).alias("exact_match"), rate(0).alias("fpr"), rate(1).alias("recall"))


def background_fpr(df: DataFrame, frame: str, pred: Column, n: int) -> DataFrame:
    """(fpr, n): the share of the first n frames of each sample, where nobody is, that are predicted positive."""
    return df.where(F.col(frame) < n).agg(F.avg(pred.cast("double")).alias("fpr"), F.count("*").alias("n"))


def dataset_summary(df: DataFrame, by: list[str], cls: str, label: str) -> DataFrame:
    """(by, n, classes, positive_rate, unlabeled): rows, distinct classes, the share of label 1, rows without a label."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(cls).alias("classes"), F.avg(F.coalesce((F.col(label) == 1).cast("double"), F.lit(0.0))).alias("positive_rate"), F.count_if(F.col(label).isNull()).alias("unlabeled"))


def labels_missing_from_train(df: DataFrame, label: str, split: str, train: str = "train") -> DataFrame:
    """(label): labels of other splits that the training split lacks."""
    return df.where(F.col(split) != train).select(label).subtract(df.where(F.col(split) == train).select(label))


def top_classes(df: DataFrame, sample: str, label: str, p: str, k: int = 3) -> DataFrame:
    """(sample, rank, label, p) of the k likeliest classes."""
    r = F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(p), label))
    return df.withColumn("rank", r).where(F.col("rank") <= k).select(sample, "rank", label, p)


def ranking_metrics(df: DataFrame, by: list[str], truth: str, score: str) -> DataFrame:
    """(by, average_precision, roc_auc) where both classes are present; equal scores are one step."""
    steps = df.groupBy(*by, score).agg(F.sum(truth).alias("t"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"ct": F.sum("t").over(w), "cn": F.sum("n").over(w)})
    ap, wins = F.sum(F.col("t") * F.col("ct") / F.col("cn")), F.sum((F.col("n") - F.col("t")) * (F.col("ct") - F.col("t") / 2))
    out = steps.groupBy(*by).agg(F.sum("t").alias("pos"), (F.sum("n") - F.sum("t")).alias("neg"), ap.alias("ap"), wins.alias("wins")).where("pos > 0 and neg > 0")
    return out.select(*by, (F.col("ap") / F.col("pos")).alias("average_precision"), (F.col("wins") / (F.col("pos") * F.col("neg"))).alias("roc_auc"))
