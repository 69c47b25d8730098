"""Quality rules by distribution divergence, all in native column expressions.

A document is compared with a reference of its own language, gathered from the whole table: a histogram of
character classes and one of the language's commonest words (the rest is one more bin). The measure is the
Jensen-Shannon distance, the square root of the base-2 divergence, in [0, 1]. Short texts have noisy
histograms, so each distance counts only from a minimum length on, and a language needs a minimum of words
to be a reference.

Rows: null text counts as empty, null language is a language of its own; an empty table gives an empty
result; repeated rows are judged alike. Input columns are kept only by :func:`keep_documents`; the measures
sit in one struct column there, so columns of the input can't clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmart.llm.common import SPACE_RE, SPACES, stored, whole_text

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
SYMBOLS = "#*$%&|<>"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
PUNCT = ".,;:!?'\"()-"
CLASSES = ("lower", "space", "upper", "digit", "symbol", "punct", "other")

COMMON_WORDS = 16          # bins of the word histogram besides the rest
MIN_CHARS_JS = 200         # shorter texts have no character verdict
MIN_WORDS_JS = 60          # fewer words have no word verdict
MIN_REFERENCE_WORDS = 2000  # smaller languages have no reference: the base rules decide alone
MAX_CHAR_JS = 0.33
MAX_WORD_JS = 0.42
BROADCAST_LANGUAGES = 2000  # references beyond this many languages are joined by shuffle


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RE), "")


def _without_lower(text: Column) -> Column:
    return F.regexp_replace(text, "[a-z]++", "")  # the one pass over all characters; the rest see what is left


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def base_columns(text: Column) -> list[list[tuple[str, Column]]]:
    """Layers of (name, expression): each layer reads the ones before it."""
    c = F.col
    window = lambda i: F.xxhash64(*[F.get(c("_words"), i + F.lit(k)) for k in range(WINDOW)])
    near = lambda s, i: F.coalesce(F.get(s, i)["h"], F.lit(None).cast("bigint"))
    return [
        [("_text", text)],
        [("_words", _words(c("_text"))), ("_r1", _without_lower(c("_text"))),
         ("_lines", F.filter(F.split(c("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
         ("_chars", F.length("_text").cast("long"))],
        [("n_words", F.size("_words").cast("long")),
         ("_r2", _removed(c("_r1"), SPACES)),
         ("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
         ("_win", F.when(F.size("_words") >= WINDOW,
                         F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window)))],
        [("_r3", _removed(c("_r2"), UPPER)),
         ("_twice", F.when(F.size("_win") > F.size(F.array_distinct("_win")),
                           F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))],
        [("_r4", _removed(c("_r3"), DIGITS)),
         ("_at", F.when(c("_twice").isNotNull(), F.sort_array(F.transform(
             F.filter("_twice", lambda x, i: x["h"].eqNullSafe(near(c("_twice"), i + 1))
                      | ((i > 0) & x["h"].eqNullSafe(near(c("_twice"), F.greatest(i - 1, F.lit(0)))))),
             lambda x: x["i"]))))],
        [("_r5", _removed(c("_r4"), SYMBOLS)),
         ("n_repeat_words", F.coalesce(F.aggregate(
             F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c("_at"), i + 1) - p, F.lit(WINDOW)))),
             F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))],
        [("_r6", _removed(c("_r5"), PUNCT))],
        [("word_chars", (F.length("_r2") + F.length("_text") - F.length("_r1")).cast("long")),
         ("n_symbols", (F.length("_r4") - F.length("_r5")).cast("long")),
         ("_classes", F.array(*[x.cast("long") for x in (
             F.length("_text") - F.length("_r1"), F.length("_r1") - F.length("_r2"), F.length("_r2") - F.length("_r3"),
             F.length("_r3") - F.length("_r4"), F.length("_r4") - F.length("_r5"), F.length("_r5") - F.length("_r6"),
             F.length("_r6"))]))],
    ]


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PCT)


def _class_counts(text: Column) -> list[list[tuple[str, Column]]]:
    c = F.col
    chain = [("_r1", _without_lower(text)), ("_r2", _removed(c("_r1"), SPACES)), ("_r3", _removed(c("_r2"), UPPER)),
             ("_r4", _removed(c("_r3"), DIGITS)), ("_r5", _removed(c("_r4"), SYMBOLS)), ("_r6", _removed(c("_r5"), PUNCT))]
    return [[x] for x in chain]


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: shares of the character classes, the commonest words, their shares and the rest's.

    Both come from all rows. Words are summed in each task before the shuffle on (language, word); the
    commonest are cut per task as well, so a hot language never meets in one task.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), whole_text(text).alias("t"))
    counted = rows
    for layer in _class_counts(F.col("t")):
        counted = counted.withColumns(dict(layer))
    names = ["t", "_r1", "_r2", "_r3", "_r4", "_r5", "_r6"]
    lengths = [F.length(a) - F.length(b) for a, b in zip(names, names[1:])] + [F.length("_r6")]
    chars = counted.groupBy("lang").agg(*[F.sum(x.cast("long")).alias(f"c{i}") for i, x in enumerate(lengths)])
    chars = chars.select("lang", F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"))
    words = (rows.select("lang", F.explode(_words(F.col("t"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")))
    # the commonest per language: first within 64 salts of it, then among those (Spark cuts both per task, too)
    salted = words.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(64)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    first = salted.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "w"))).where(
        F.col("k") <= COMMON_WORDS)
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(
        F.col("k") <= COMMON_WORDS)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top"))
    all_chars = F.aggregate("ref_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    all_top = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return (chars.join(totals, "lang").join(top, "lang").where(F.col("total") >= MIN_REFERENCE_WORDS)
            .withColumns({"all_chars": all_chars, "rest": F.col("total") - all_top})
            .select("lang", F.transform("ref_classes", lambda x: x.cast("double") / F.col("all_chars")).alias("ref_chars"),
                    F.transform("top", lambda x: x["w"]).alias("ref_top"),
                    F.transform(F.concat(F.transform("top", lambda x: x["n"]), F.array("rest")),
                                lambda x: x.cast("double") / F.col("total")).alias("ref_words")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, of one length."""
    def term(a, b):
        part = lambda x: F.when(x > 0, x * F.log2(x / ((a + b) / 2))).otherwise(0.0)
        return (part(a) + part(b)) / 2

    div = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(div, F.lit(0.0)))


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """``docs`` with one struct column ``quality``: the base counts, both distances and the verdicts."""
    if refs is None:
        refs = stored(references(docs, text, lang), "quality-references")
    if refs.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)  # at most 2000 rows of 16 words: far below a megabyte
    refs = refs.select(F.col("lang").alias("_ref_lang"), "ref_chars", "ref_words", "ref_top")
    kept = F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("_row")
    out = docs.select(kept, F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit("")).alias("_lang"),
                      F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("_text"))
    for layer in base_columns(F.col("_text"))[1:]:
        out = out.withColumns(dict(layer))
    out = out.drop("_r1", "_r2", "_r3", "_r4", "_r5", "_r6", "_lines", "_win", "_twice", "_at")
    out = out.join(refs, out["_lang"] == refs["_ref_lang"], "left")
    c = F.col
    # one lambda for all common words: sixteen separate expressions would make a method too long to be compiled
    out = out.withColumn("_counts", F.when(c("n_words") >= MIN_WORDS_JS, F.transform(
        "ref_top", lambda w: c("n_words") - F.size(F.array_remove(c("_words"), w)))))
    # shares first, each in a column of its own: a lambda evaluates what it refers to again for every element
    out = out.withColumns({
        "_rest": c("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda s, x: s + x),
        "_p_chars": F.when(c("_chars") >= MIN_CHARS_JS, F.transform("_classes", lambda x: x.cast("double") / c("_chars")))})
    out = out.withColumn("_p_words", F.transform(F.concat("_counts", F.array("_rest")),
                                                 lambda x: x.cast("double") / c("n_words")))
    out = out.withColumns({"char_js": js_distance(c("_p_chars"), c("ref_chars")),
                           "word_js": js_distance(c("_p_words"), c("ref_words"))})
    out = out.withColumn("base_failed", base_failed(c("n_words"), c("n_repeat_words")))
    out = out.withColumn("kept", ~c("base_failed") & (F.coalesce(c("char_js"), F.lit(0.0)) <= MAX_CHAR_JS)
                         & (F.coalesce(c("word_js"), F.lit(0.0)) <= MAX_WORD_JS))
    quality = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "char_js", "word_js").alias("quality")
    return out.select("_row", quality)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: key, the base counts, the distances and the verdicts."""
    return measure(docs, text, lang).select(F.col("_row")[key].alias(key), "quality.*")


def keep_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents with a good verdict, with their own columns.

    The judged rows are stored before the verdict filters them: pushed below the measures, the filter would
    compute all of them again for each column it refers to.
    """
    judged = stored(measure(docs, text, lang).select("_row", F.col("quality.kept").alias("kept")), "judged")
    return judged.where("kept").select("_row.*")
