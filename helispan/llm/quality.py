"""Quality rules: repetition counts and divergence from language references, in SQL functions only.

A document's histogram of character classes and its histogram of common words are compared with
those of its language by Jensen-Shannon distance (base 2, 0 to 1). The references are the mean
histograms of the language's documents that pass the base rules and are long enough; a language needs
so many of them to be judged by, so that no document is compared with little more than itself.
Short documents are too noisy to judge, so a minimum length guards both tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helispan.llm.text import SPACE, words
from helispan.session import materialize

#: Common words by language.
COMMON = {
    "en": "the of and to a in is it that for on with was as are be this by from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}
VOCABULARY = list(dict.fromkeys(w for ws in COMMON.values() for w in ws))
#: Common words are written as one character each, after this one, to be counted.
FIRST_CODE = 34
#: Patterns of the character classes, in the order in which they are taken out of the text.
CLASSES = {"lower": r"\p{Ll}+", "space": SPACE, "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+", "stop": r"[.,;:!?'\"()-]+"}
WINDOW = 8
MIN_BASE_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Guards of the method and its two thresholds.
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.42
#: Documents that a language's reference is made of, at least; without, its documents pass the two tests.
MIN_REFERENCE = 20
#: References up to so many languages are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _shifted(hashes: str, by: int) -> Column:
    """Hashes of runs twice as long, from those of runs of ``by`` words; the last ``by`` are void."""
    later = F.slice(hashes, by + 1, F.greatest(F.size(hashes) - by, F.lit(0)))
    return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))


def _with_repeated_words(d: DataFrame) -> DataFrame:
    """Adds ``_repeated``: the words covered by windows found more than once, from the window hashes ``_w``."""
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    tagged = F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("_g", F.when(some, tagged).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")))
    later = F.slice("_g", 2, F.size("_g"))
    pairs = F.zip_with("_g", later, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(pairs))))
    each = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return d.withColumn("_repeated", F.aggregate(each, F.lit(0), lambda s, x: s + x))


def _histograms(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds n_words, word hashes ``_h``, class counts ``_c`` and common-word counts ``_v`` to ``keep``."""
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", F.transform(words("_t"), lambda w: F.xxhash64(w)).alias("_h"))
    rest, left, counts = "_t", [], []
    for name, pattern in CLASSES.items():
        d = d.withColumn(f"_r_{name}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.length(rest) - F.length(f"_r_{name}"))
        rest = f"_r_{name}"
        left.append(rest)
    n = F.size("_h")
    keys = [F.xxhash64(F.lit(w)) for w in VOCABULARY]
    codes = F.transform(F.filter("_h", lambda x: x.isin(*keys)), lambda x: F.char(F.array_position(F.array(*keys), x) + F.lit(FIRST_CODE)))
    d = d.withColumn("_s", F.array_join(codes, ""))
    marks = F.array(*[F.lit(chr(FIRST_CODE + 1 + i)) for i in range(len(VOCABULARY))])
    common = F.transform(marks, lambda m: (F.length("_s") - F.length(F.replace(F.col("_s"), m, F.lit("")))).cast("double"))
    d = d.select(
        *keep, "_t", "_h",
        n.cast("long").alias("n_words"), F.length("_t").alias("_n"),
        F.array(*[c.cast("double") for c in counts], F.length(rest).cast("double")).alias("_c"),
        F.concat(common, F.array((n - F.length("_s")).cast("double"))).alias("_v"),
    )
    return d


def _share(counts: str, total: str) -> Column:
    return F.transform(counts, lambda x: F.when(F.col(total) > 0, x / F.col(total)).otherwise(F.lit(0.0)))


def quality_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts of each text and its two histograms, beside the columns ``keep``."""
    d = _histograms(docs, keep)
    runs = 1
    while runs < WINDOW:
        d = d.withColumn("_w" if runs * 2 == WINDOW else f"_h{runs * 2}", _shifted("_h" if runs == 1 else f"_h{runs}", runs))
        runs *= 2
    windows = F.slice("_w", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0)))
    d = d.withColumn("_w", windows)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_l", lines)
    cut = list(CLASSES)
    return _with_repeated_words(d).select(
        *keep, "n_words",
        (F.length("_t") - F.element_at("_c", cut.index("space") + 1)).cast("long").alias("word_chars"),
        F.element_at("_c", cut.index("symbol") + 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_repeated").cast("long").alias("n_repeat_words"),
        _share("_c", "_n").alias("_c"), _share("_v", "n_words").alias("_v"),
    )


def _failed() -> Column:
    """The base rules."""
    return (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def language_references(features: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, p, q``: mean histograms of each language (null is one) with documents enough that pass the base rules."""
    sizes = {"_c": len(CLASSES) + 1, "_v": len(VOCABULARY) + 1}
    means = [F.avg(F.element_at(c, i + 1)).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    fit = features.where((F.col("n_words") >= MIN_WORDS) & ~_failed())
    rows = fit.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), *means).where(F.col("n") >= MIN_REFERENCE)
    return rows.select("lang", *[F.array(*[F.round(f"{c}{i}", 9) for i in range(n)]).alias(name) for (c, n), name in zip(sizes.items(), "pq", strict=True)])


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms whose bins sum to 1; null without the second."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    each = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when(q.isNotNull(), F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def _verdict(features: DataFrame, lang: str) -> DataFrame:
    """Adds class_distance, word_distance (null for short texts and without a reference), base_failed and kept."""
    found = materialize(language_references(features, lang), "references").select(F.col("lang").alias("_lang"), F.col("p").alias("_p"), F.col("q").alias("_q"))
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    long_enough = F.col("n_words") >= MIN_WORDS
    d = features.join(found, features[lang].eqNullSafe(found["_lang"]), "left")
    d = d.withColumn("class_distance", F.when(long_enough, _distance(F.col("_c"), F.col("_p"))))
    d = d.withColumn("word_distance", F.when(long_enough, _distance(F.col("_v"), F.col("_q"))))
    odd = F.coalesce((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False))
    return d.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & ~odd).drop("_p", "_q", "_c", "_v", "_lang")


def assess(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: its counts, its two distances, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules; a null ``lang``, or none at all, is a
    language of its own; repeated rows give repeated results; an empty table gives none. The features
    are written once, so that the texts are read once.
    """
    if lang not in docs.columns:
        docs = docs.withColumn(lang, F.lit(None).cast("string"))
    features = materialize(quality_features(docs, list(dict.fromkeys((doc_id, lang)))), "quality")
    return _verdict(features, lang).drop(lang)


def filter_documents(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """The documents that ``assess`` keeps, with all their columns.

    They are written once beside their features, which cost far more than a copy of the texts, so that
    the references and the verdicts need no second look at the words.
    """
    columns = docs.columns
    own = [f"_k{i}" for i in range(len(columns))]
    d = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(columns, own, strict=True)], F.col("text").alias("text"))
    d = d.withColumn("_language", F.col(own[columns.index(lang)]).cast("string") if lang in columns else F.lit(None).cast("string"))
    features = materialize(quality_features(d, [*own, "_language"]), "quality")
    kept = _verdict(features, "_language").where("kept")
    return kept.select(*[F.col(a).alias(c) for a, c in zip(own, columns, strict=True)])
