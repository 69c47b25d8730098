"""Ordered rules from a table of any size (X7, X8, X9): the first rule whose pattern a text holds or begins with.

``functions.classify_first`` is a chain of conditions: right for a handful of rules, but linear in the rules for every row and
too long to be compiled beyond some hundreds. Here rules meet texts by equi-joins:

* prefix rules: a text's prefixes of the rules' distinct lengths are the keys;
* substring rules: every rule is filed under one q-gram of its pattern, the one that fewest texts hold; a text's
  distinct q-grams are the keys, and ``contains`` decides. Patterns shorter than a q-gram are filed under themselves,
  and texts also probe with their substrings of those lengths.

Each distinct text is classified once and the labels are joined back, so the work grows with distinct texts and their
lengths, not with rows times rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3
MODES = ("contains", "contains_ci", "prefix")


def _substrings(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    parts = [of(n) for n in lengths]
    return F.array_distinct(F.concat(*parts)) if parts else none


def _file_under(rules: DataFrame, texts_by_gram: DataFrame) -> DataFrame:
    """(gram, pattern, rule, label): each pattern under its rarest q-gram among the texts."""
    grams = rules.select("rule", "pattern", "label", F.explode(_substrings(F.col("pattern"), [Q])).alias("gram"))
    counted = grams.join(texts_by_gram, "gram", "left")
    pick = F.min_by(F.col("gram"), F.struct(F.coalesce("texts", F.lit(0)), F.col("gram")))
    return counted.groupBy("rule", "pattern", "label").agg(pick.alias("gram")).select("gram", "pattern", "rule", "label")


def first_rule(texts: DataFrame, column: str, rules: DataFrame, mode: str = "contains") -> DataFrame:
    """(column, rule, label) of the distinct texts that match a rule: the one with the smallest ``rule`` number.

    ``rules`` has rule (an integer, its order), pattern, label. An empty pattern matches every text; null texts and null
    patterns match nothing; a rule number that occurs twice keeps the smaller pattern's label.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    fold = F.lower if mode == "contains_ci" else (lambda c: c)
    rules = rules.filter(F.col("pattern").isNotNull()).select("rule", fold(F.col("pattern")).alias("pattern"), "label")
    texts = texts.filter(F.col(column).isNotNull()).select(F.col(column).alias("raw")).distinct().withColumn("text", fold(F.col("raw")))
    lengths = sorted(r[0] for r in rules.select(F.length("pattern")).distinct().collect())  # one row per length of pattern
    if mode == "prefix":
        prefixes = F.array(*[F.when(F.length("text") >= n, F.substring("text", 1, n)) for n in lengths]).cast("array<string>")
        probes = texts.select("raw", F.explode(prefixes).alias("pattern")).filter(F.col("pattern").isNotNull())
        hits = probes.join(rules, "pattern")
    else:
        short = [n for n in lengths if n < Q]
        keys = _substrings(F.col("text"), [n for n in short if n] + ([Q] if lengths and lengths[-1] >= Q else []))
        if 0 in short:
            keys = F.concat(keys, F.array(F.lit("")))
        probes = texts.select("raw", "text", F.explode(keys).alias("gram"))
        long = rules.filter(F.length("pattern") >= Q)
        per_gram = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
        filed = _file_under(long, per_gram).unionByName(
            rules.filter(F.length("pattern") < Q).select(F.col("pattern").alias("gram"), "pattern", "rule", "label"))
        hits = probes.join(filed, "gram").filter(F.col("text").contains(F.col("pattern")))
    best = hits.groupBy("raw").agg(F.min(F.struct("rule", "pattern", "label")).alias("b"))
    return best.select(F.col("raw").alias(column), F.col("b.rule").alias("rule"), F.col("b.label").alias("label"))


def classify_table(df: DataFrame, column: str, rules: DataFrame, mode: str = "contains", default=None, out: str = "label") -> DataFrame:
    """``df`` with the first matching rule's label in ``out``; rows without a match, null texts among them, get ``default``."""
    labels = first_rule(df, column, rules, mode).select(F.col(column).alias("_text"), F.col("label").alias("_label"))
    joined = df.join(labels, F.col(column) == F.col("_text"), "left")
    return joined.withColumn(out, F.coalesce("_label", F.lit(default).cast("string"))).drop("_text", "_label")
