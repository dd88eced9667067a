"""Quality rules, native: distribution divergence of character classes and common words from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import salted_left_join, write_table

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
#: Letters of words that may count as common, how many are taken of each language, and for how many languages' words a row
#: has a list of counts. The driver holds WORDS words and no more; beyond them, words are counted in a table, with equal results.
LONGEST, PER_LANGUAGE, LANGUAGES = 6, 24, 10
WORDS = PER_LANGUAGE * LANGUAGES
#: Rows of a table of words that are broadcast at most; larger ones are joined by shuffle.
BROADCAST = 50_000
LETTERS = r"[^\p{L}]+"
#: Character classes: upper case, digits, punctuation, beyond ASCII, white space, symbols, the rest.
N_CLASSES = 7
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, kind: str) -> Column:
    """Characters of a class, as what is left when runs of all others go."""
    return F.char_length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def _jsd(p: Column, p_sum: Column, q: Column, q_sum: Column) -> Column:
    """Jensen-Shannon distance in bits (square root of the divergence) of two lists of counts with their sums; null if one is."""

    def term(x: Column, y: Column) -> Column:
        a, b = x / F.greatest(p_sum, F.lit(1e-12)), y / F.greatest(q_sum, F.lit(1e-12))
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0)

    both = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(both, F.lit(0.0))))


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def vocabulary(docs: DataFrame) -> DataFrame:
    """A row (w) per common word: the most frequent short words, without case, of every language; counted over all texts.

    Ties go by the word; a word that a language has once isn't common there. Null lang is a language of its own here.
    """
    words = docs.select(_lang(docs).alias("lang"), F.explode(F.split(F.lower(F.col("text").cast("string")), LETTERS)).alias("w"))
    each = words.where(F.char_length("w").between(1, LONGEST)).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    each = write_table(each.where("n > 1"), "words")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    return each.withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).select("w").distinct()


def _listed(words: DataFrame, most: int) -> list[str] | None:
    """The words, sorted; None where there are more than `most`."""
    found = [r["w"] for r in words.limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def common_words(docs: DataFrame) -> list[str] | None:
    """The words of vocabulary(docs), sorted; None where there are too many for a list in each row."""
    return _listed(vocabulary(docs), WORDS)


def counts(docs: DataFrame, common: list[str] | None) -> DataFrame:
    """Per row: doc_id, lang, the base counts, a count of each class and of each common word. Whole texts, no shuffle.

    common None: no word is counted as common; the further column short has all short words (w, n) instead.
    """
    short, common, lang = ["short"] if common is None else [], common or [], _lang(docs)
    rows = docs.select("doc_id", lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    at = lambda i: F.get("words", i)
    n = F.size("words")
    rows = rows.withColumn("windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.sort_array("windows"))
    rows = rows.withColumn("twice", F.exists(F.sequence(F.lit(1), F.greatest(F.size("sorted"), F.lit(1))), lambda i: F.get("sorted", i).eqNullSafe(F.get("sorted", i - 1)) & F.get("sorted", i).isNotNull()))
    # places of windows found twice or more: sort (hash, place), keep those with an equal neighbour
    rows = rows.withColumn("placed", F.when(F.col("twice"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    h = lambda i: F.get("placed", i)["h"]
    rows = rows.withColumn("hits", F.when(F.col("twice"), F.sort_array(F.transform(F.filter("placed", lambda z, j: z["h"].eqNullSafe(h(j + 1)) | ((j > 0) & z["h"].eqNullSafe(h(F.greatest(j - 1, F.lit(0)))))), lambda z: z["i"]))))
    covered = F.aggregate(F.transform("hits", lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get("hits", F.greatest(k - 1, F.lit(0)))))), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("n_repeat_words", F.when(F.col("twice"), covered).otherwise(F.lit(0).cast("long")))
    # numbers of the common words in the text, and every number once more: sorted, counts are gaps between last places
    k = len(common)
    listed = F.filter(F.split(F.lower("text"), LETTERS), lambda w: w.isin(common)) if common else F.array().cast("array<string>")
    numbers = F.transform(listed, lambda w: F.array_position(F.array(*map(F.lit, common)).cast("array<string>"), w).cast("int"))
    rows = rows.withColumn("numbers", F.sort_array(F.concat(numbers, F.sequence(F.lit(1), F.lit(k + 1)))))
    ends = F.transform("numbers", lambda v, i: F.when(~v.eqNullSafe(F.get("numbers", i + 1)), i))
    # likewise the short words themselves: the last place of each
    if short:
        rows = rows.withColumn("named", F.sort_array(F.filter(F.split(F.lower("text"), LETTERS), lambda w: F.char_length(w).between(1, LONGEST))))
        last = F.transform("named", lambda v, i: F.when(~v.eqNullSafe(F.get("named", i + 1)), i))
        rows = rows.withColumn("last", F.filter(last, lambda x: x.isNotNull()))
        rows = rows.withColumn("short", F.transform("last", lambda e, i: F.struct(F.get("named", e).alias("w"), (e - F.coalesce(F.get("last", i - 1), F.lit(-1))).cast("double").alias("n"))))
    # what is left without the most frequent classes is short, and the others are counted in it
    rows = rows.withColumn("rest", F.regexp_replace("text", f"[a-z{SPACE}]+", ""))
    classes = {"upper": "A-Z", "digit": "0-9", "punct": ".,;:!?\"'()-"}
    rows = rows.withColumn("chars", F.char_length("text").cast("long")).withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
    rows = rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), "word_chars", _count(F.col("rest"), SYMBOLS[1:-1]).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "chars",
        *(_count(F.col("rest"), v).alias(f"c_{k}") for k, v in classes.items()),
        F.char_length(F.regexp_replace("rest", r"[\x00-\x7F]+", "")).cast("long").alias("c_beyond"),
        F.filter(ends, lambda x: x.isNotNull()).alias("ends"), *short,
    )
    gaps = F.transform("ends", lambda e, i: (e - F.coalesce(F.get("ends", i - 1), F.lit(-1)) - 1).cast("double"))
    rows = rows.withColumn("common", F.slice(gaps, 1, k) if k else F.array().cast("array<double>")).withColumn("c_space", F.col("chars") - F.col("word_chars"))
    known = [F.col(f"c_{k}").cast("double") for k in (*classes, "beyond", "space")] + [F.col("n_symbols").cast("double")]
    rows = rows.withColumn("classes", F.array(*known, F.greatest(F.col("chars") - sum(known, F.lit(0.0)), F.lit(0.0))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "lang", *BASE, "chars", "classes", total("classes").alias("classes_sum"), "common", total("common").alias("common_sum"), *short)


def references(measured: DataFrame, n_common: int, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """A row per language (by=(): one for all rows): the mean over its documents of 50 words or more of each count for a word."""
    size = {"classes": N_CLASSES, "common": n_common}
    long = measured.where("n_words >= 50")
    per = [F.round(F.avg(F.get(c, F.lit(i)) / F.col("n_words")), 9).alias(f"{c}{i}") for c, n in size.items() for i in range(n)]
    each = long.where(F.col("lang").isNotNull()).groupBy(*by).agg(*per) if by else long.agg(*per)
    each = each.select(*by, *(F.array(*(F.col(f"{c}{i}") for i in range(n))).cast("array<double>").alias(f"r_{c}") for c, n in size.items()))
    return each.select("*", *(F.aggregate(f"r_{c}", F.lit(0.0), lambda s, x: s + x).alias(f"r_{c}_sum") for c in size))


def _distances(measured: DataFrame, core: DataFrame, n_common: int, most: int = 1000) -> DataFrame:
    """measured, with char_distance and word_distance to the nearer of its language's reference and that of all rows.

    References of over `most` languages are joined by shuffle, fewer are broadcast; that of all rows is one row.
    """
    each, every = write_table(references(core, n_common), "references"), write_table(references(core, n_common, ()), "reference")
    every = every.select(*(F.col(c).alias(f"all_{c}") for c in every.columns))
    joined = measured.join(F.broadcast(each), "lang", "left") if each.count() <= most else salted_left_join(measured, each, ["lang"], F.struct("doc_id", "chars", "word_chars"))
    joined = joined.join(F.broadcast(every), F.lit(True), "left")
    dist = lambda c, r: _jsd(F.col(c), F.col(f"{c}_sum"), F.col(f"{r}_{c}"), F.col(f"{r}_{c}_sum"))
    near = [F.least(dist(c, "r"), dist(c, "all_r")).alias(d) for c, d in (("classes", "char_distance"), ("common", "word_distance"))]
    return joined.select(*measured.columns, *near)


def _lookup(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Left join with a table of a row per key; one of over `most` rows goes by shuffle, rows of hot keys spread by rid."""
    return left.join(F.broadcast(right), keys, "left") if right.count() <= most else salted_left_join(left, right, keys, F.col("rid"), shuffled=True)


def _by_table(docs: DataFrame, words: DataFrame, core_chars: float, most: int = BROADCAST) -> DataFrame:
    """The columns of the last _distances of quality() for any number of common words: a row per word of a text, not a list per row.

    A text holds few of the words, so its terms of the divergence are summed over those it holds; the rest of a reference
    is one more term, as every word that only the reference has adds its share alone.
    """
    words = write_table(words, "vocabulary")
    measured = write_table(counts(docs, None).withColumn("rid", F.monotonically_increasing_id()), "quality")
    plain = measured.drop("short")
    first = _distances(measured, plain, 0)
    core = F.col("char_distance") <= core_chars
    out = _distances(plain, first.where(core).select(plain.columns), 0).drop("common_sum", "word_distance")
    first = first.select("rid", "lang", "short", F.when(core & (F.col("n_words") >= 50), F.col("n_words")).alias("long"))
    held = _lookup(first.select("rid", "lang", "long", F.inline("short")), words.withColumn("known", F.lit(True)), ["w"], most)
    held = write_table(held.where("known").drop("known"), "held")
    n = write_table(first.where("long is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "docs")
    shares = write_table(held.where("long is not null").groupBy("lang", "w").agg(F.sum(F.col("n") / F.col("long")).alias("share")), "shares")
    # means over the long texts of a language, and over all
    mean = lambda alias: F.round(F.col("share") / F.col("docs"), 9).alias(alias)
    each = write_table(_lookup(shares.where("lang is not null").withColumn("rid", F.xxhash64("w")), n, ["lang"], most).select("lang", "w", mean("q")), "references")
    every = shares.groupBy("w").agg(F.sum("share").alias("share")).join(F.broadcast(n.agg(F.sum("docs").alias("docs"))))
    every = write_table(every.select("w", mean("q_all")), "reference")
    sums = n.where("lang is not null").select("lang").join(each.groupBy("lang").agg(F.round(F.sum("q"), 9).alias("q_sum")), "lang", "left")
    sums = write_table(sums.na.fill(0.0, ["q_sum"]), "sums")
    # without any long text there is no reference, and every distance is 0
    whole = every.agg(F.round(F.coalesce(F.sum("q_all"), F.lit(0.0)), 9).alias("all_sum")).join(F.broadcast(n.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("all_docs"))))
    held = _lookup(_lookup(held, each, ["lang", "w"], most), every, ["w"], most).na.fill(0.0, ["q", "q_all"])
    held = held.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("n", "q", "q_all"))).alias("found"))
    out = _lookup(out.join(held, "rid", "left"), sums, ["lang"], most).join(F.broadcast(whole))
    total = lambda c: F.coalesce(F.aggregate(F.col("found")[c], F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    terms = lambda c, rest: F.concat(F.coalesce(F.col("found")[c], F.array().cast("array<double>")), F.array(F.greatest(rest, F.lit(0.0))))
    out = out.withColumn("common_sum", total("n"))
    far = lambda c, of: F.when(of.isNotNull(), _jsd(terms("n", F.lit(0.0)), F.col("common_sum"), terms(c, of - total(c)), of))
    near = F.least(far("q", F.col("q_sum")), far("q_all", F.col("all_sum")))
    return out.withColumn("word_distance", F.when(F.col("all_docs") > 0, near).otherwise(0.0))


def quality(docs: DataFrame, max_chars: float = 0.15, max_words: float = 0.75, core_chars: float = 0.2, min_chars: int = 200, min_common: int = 20, most: int = WORDS) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, char_distance, word_distance, kept.

    kept: the base rules hold, and neither distance to the nearer of the document's language and the whole corpus
    is above its limit. A distance counts only for texts of min_chars characters, or min_common common words.
    Null and empty texts have no words and fail the base. Null lang: the whole corpus is the reference, as it is where
    lang has a value that no long text has. Repeated rows: one result each. Texts are read whole. Other columns are
    ignored, whatever their names. Empty table: no rows. Common words come from the corpus, from every language in it (vocabulary); up to `most` of them are
    counted in a list per row, more in a table, with equal results. The references are taken from all rows first, then
    from all rows no further than core_chars from those, so that junk doesn't shape them. No UDF, pandas or RDD code.
    """
    words = vocabulary(docs)
    common = _listed(words, most)
    if common is None:
        out = _by_table(docs, words, core_chars)
    else:
        measured, n = write_table(counts(docs, common), "quality"), len(common)
        out = _distances(measured, _distances(measured, measured, n).where(F.col("char_distance") <= core_chars).select(measured.columns), n)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.col("chars") >= min_chars) & (F.col("char_distance") > max_chars) | (F.col("common_sum") >= min_common) & (F.col("word_distance") > max_words)
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")
