"""Quality rules: how far a document's character classes and common words lie from its
language, as Jensen-Shannon distances, beside plain counts of its words and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import SPACE, fixed, native_words, small_side, text_key, whole_row

# fixed values: the most common function words of each language with a reference
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "en": "the of and to in a is that for it on was be with as by this are from at or an".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le les et des en un du que est pour qui dans par sur au avec ne pas une".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
CLASSES = ("upper", "digit", "mark", "symbol", "space", "rest")

MIN_WORDS = 50  # fewer words say too little: such a document fails
MAX_REPEATED = 50  # per cent of the words that may stand in repeated windows
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.50
PLACES = (1 << 31) - 1  # lower bits of a hash that give way to the place of its window


def _left(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _met(placed: Column) -> Column:
    """Places whose upper hash bits a neighbour of the sorted ``placed`` has too: those of
    all repeated windows, and a few more that the texts of the windows tell apart."""
    last = F.size(placed) - 1
    same = lambda k, x: F.get(placed, k).bitwiseXOR(x).bitwiseAND(F.lit(~PLACES)) == 0
    met = F.filter(placed, lambda x, k: ((k > 0) & same(k - 1, x)) | ((k < last) & same(k + 1, x)))
    return F.transform(met, lambda x: x.bitwiseAND(F.lit(PLACES)).cast("int"))


def _repeated(windows: Column) -> Column:
    """Words covered by windows of three that occur twice or more.

    ``windows`` are sorted pairs (window, place): equal ones are neighbours."""
    last = F.size(windows) - 1
    other = lambda k: F.get(windows, k)["w"]
    again = F.filter(windows, lambda x, k: ((k > 0) & (other(k - 1) == x["w"])) | ((k < last) & (other(k + 1) == x["w"])))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of the rules and the two histograms.

    A null text counts as one without words.  Columns of the same names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("_words", native_words(F.col(text)))
    n = F.size("_words")
    window = lambda f: lambda i: f(*[F.get("_words", i + k) for k in range(3)])
    hashes = F.transform(F.sequence(F.lit(0), n - 3), window(F.xxhash64))
    counted = counted.withColumn("_windows", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window, which their hashes tell; in others places are sorted by hash
    placed = F.sort_array(F.transform("_windows", lambda h, i: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(i.cast("long"))))
    counted = counted.withColumn(
        "_windows",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed).otherwise(F.array().cast("array<bigint>")),
    ).withColumn("_windows", _met(F.col("_windows")))
    texts = window(lambda *w: F.concat_ws(" ", *w))
    counted = counted.withColumn(
        "_windows", F.sort_array(F.transform("_windows", lambda i: F.struct(texts(i).alias("w"), i.alias("i"))))
    ).withColumn("_places", _repeated(F.col("_windows")))
    covered = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counted = counted.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long"),
            "_lines": lines,
            "_tokens": F.array_remove(F.split(F.lower(t), "[^\\p{L}]+"), ""),
            # one pass over the text leaves the few characters of the next three classes
            "_few": F.regexp_replace(t, "[^\\p{Lu}\\p{Nd}.,;:!?'\"()-]+", ""),
        }
    )
    few = F.col("_few")
    counted = counted.withColumns(
        {
            "_upper": _left(few, "[^\\p{Lu}]+"),
            "_digit": _left(few, "[^\\p{Nd}]+"),
            "_mark": _left(few, "[^.,;:!?'\"()-]+"),
        }
    )
    size = F.length(t).cast("long")
    classes = [
        F.col("_upper"), F.col("_digit"), F.col("_mark"), F.col("n_symbols"), size - F.col("word_chars"),
        F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_mark") - F.col("n_symbols"),
    ]
    # with every common word added once and all sorted, each word is a run of its own
    counted = counted.withColumn(
        "_runs", F.sort_array(F.concat(F.filter("_tokens", lambda w: w.isin(WORDS)), F.array(*[F.lit(w) for w in WORDS])))
    )
    first = lambda i: (i == 0) | (F.get("_runs", i) != F.get("_runs", i - 1))
    counted = counted.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_runs") - 1), first))
    runs = F.transform("_starts", lambda x, k: (F.coalesce(F.get("_starts", k + 1), F.size("_runs")) - x - 1).cast("long"))
    others = (F.size("_tokens") + len(WORDS) - F.size("_runs")).cast("long")
    return counted.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "class_counts": F.array(*classes),
            "word_counts": F.concat(runs, F.array(others)),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        }
    ).drop(*[c for c in counted.columns if c.startswith("_") and c not in docs.columns])


def language_references(measured: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """The mean histograms of every language in ``COMMON``, over all rows of that language.

    What is collected is one number per language and bin.  A language without rows has
    no reference."""
    own = measured.where(F.col(lang).isin(list(COMMON)))
    size = len(CLASSES)
    bins = own.select(
        F.col(lang).alias("lang"), F.posexplode(F.concat("class_counts", "word_counts")).alias("bin", "n")
    )
    found: dict[str, list[float]] = {}
    for r in bins.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["lang"], [0.0] * (size + len(WORDS) + 1))[r["bin"]] = float(r["n"])
    share = lambda x: [v / max(sum(x), 1.0) for v in x]
    return {k: (share(v[:size]), share(v[size:])) for k, v in sorted(found.items())}


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of a histogram and a
    reference: 0 for equal, 1 for disjoint ones and for an empty histogram."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    other = F.array(*[F.lit(float(q)) for q in reference])
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(c, q):
        p = c / total
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    sum_ = F.aggregate(F.zip_with(counts, other, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(sum_, F.lit(0.0)))).otherwise(1.0)


def judged(measured: DataFrame, references: dict, lang: str = "lang") -> DataFrame:
    """Adds ``class_distance``, ``word_distance`` and ``kept``.

    A document of a language with a reference is held against that one, any other (null
    too) against the nearest for its characters, and its words are not judged.  Without
    references nothing is.  Short texts fail by the base rule, before any distance."""
    if not references:
        none = F.lit(None).cast("double")
        return measured.withColumns({"class_distance": none, "word_distance": none, "kept": ~F.col("base_failed")})
    known = F.col(lang).isin(list(references))

    def distance(column: str, which: int, rest: Column) -> Column:
        own = reduce(
            lambda c, k: c.when(F.col(lang) == k, js_distance(F.col(column), references[k][which])),
            list(references), F.when(F.lit(False), 0.0),
        )
        return F.when(known, own).otherwise(rest)

    nearest = [js_distance(F.col("class_counts"), r[0]) for r in references.values()]
    nearest = F.least(*nearest) if len(nearest) > 1 else nearest[0]
    out = measured.withColumns(
        {
            "class_distance": distance("class_counts", 0, nearest),
            "word_distance": distance("word_counts", 1, F.lit(0.0)),
        }
    )
    return out.withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("class_distance") <= MAX_CLASS_DISTANCE) & (F.col("word_distance") <= MAX_WORD_DISTANCE),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang) that the rules keep.

    Texts are measured once; the small table of measures is written, and the verdicts on a
    text and its language come back as those to leave out.  Null and short texts go, a null
    language is judged like one without references.  Columns keep their names and values; any
    names are allowed."""
    keyed = docs.select("text", "lang", *text_key())
    measured = fixed(measures(keyed).drop("text"))
    bad = judged(measured, language_references(measured)).where(~F.col("kept"))
    bad = small_side(fixed(bad.select("_ka", "_kb", F.col("lang").alias("_bl")).distinct()))
    named = docs.select(whole_row(docs), F.col("lang").alias("_kl"), *text_key())
    same = [named["_ka"] == bad["_ka"], named["_kb"] == bad["_kb"], F.col("_kl").eqNullSafe(F.col("_bl"))]
    return named.join(bad, same, "left_anti").select("row.*")


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    measured = fixed(measures(docs).drop("text"))
    return judged(measured, language_references(measured)).select(
        "doc_id", *RESULT
    )
