"""Multi-hot sound labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_label

# The label letters in order.
LETTERS = ("c", "m", "f", "v", "p", "b", "o")


def label_vector(text: Column) -> Column:
    """A text such as ``cv`` as zeros and ones; nan, none, null, a dash and blank are all zeros."""
    s = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    s = F.when(s.isin("nan", "none", "null", "-"), "").otherwise(s)
    return F.array(*[s.contains(x).cast("int") for x in LETTERS])


def pred_vector(labels: Column, synonyms: dict[str, tuple[str, ...]], level: Column | None = None) -> Column:
    """Labels as zeros and ones by letters of short labels or by synonyms; general speech marks c, m and f; with no label a level above -35 marks b."""
    names = F.filter(F.transform(labels, norm_label), lambda x: x != "")
    short = F.array_join(F.filter(names, lambda x: F.length(x) <= 7), "")
    own = [short.contains(x) | F.arrays_overlap(names, F.array(*map(F.lit, synonyms[x]))) for x in LETTERS]
    speaker = own[0] | own[1] | own[2]
    general = ~speaker & F.exists(names, lambda x: x.contains("speech") | x.contains("voice"))
    vec = [F.when(general, 1).otherwise(o.cast("int")) if x in "cmf" else o.cast("int") for x, o in zip(LETTERS, own, strict=True)]
    if level is not None:
        none = ~F.array_contains(F.array(*vec), 1)
        vec[5] = F.when(none & (level > -35), 1).otherwise(vec[5])
    return F.array(*vec)
