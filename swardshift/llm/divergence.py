"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words
are compared with the language's own, summed over the corpus, by the
Jensen-Shannon divergence; short texts are spared. Simple counting rules
come first. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import write_stage

#: Frequent function words of some languages.
COMMON_WORDS: dict[str, list[str]] = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
SPACE = r"\x20\x09-\x0D"
WINDOW = 8

#: A divergence (in bits) above a + b / words is not the language's: short texts stray more by chance. Texts under the least words are not judged.
MOST_CHARS, MOST_WORDS = (0.06, 3.0), (0.035, 4.5)
LEAST_WORDS_CHARS, LEAST_WORDS_WORDS = 20, 60


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for the once evaluated ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str, width: int = WINDOW) -> Column:
    """Words of an array that lie in windows of ``width`` words found twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. Texts without a
    repeated window stop after one pass.
    """
    terms = ", ".join(f"get(h, i + {k})" for k in range(width))
    wins = f"transform(sequence(0, size(h) - {width}), i -> xxhash64({terms}))"
    starts = _bind(
        "sort_array(transform(v, (x, i) -> named_struct('x', x, 'i', i)))", "s",
        "sort_array(transform(filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) OR coalesce(get(s, k + 1).x = e.x, false)), e -> e.i))",
    )
    covered = _bind(starts, "p", f"aggregate(transform(p, (b, k) -> least({width}, coalesce(get(p, k + 1), b + {width}) - b)), 0, (n, x) -> n + x)")
    counted = _bind(wins, "v", f"CASE WHEN size(array_distinct(v)) = size(v) THEN 0 ELSE {covered} END")
    hashed = _bind(f"transform({words}, w -> xxhash64(w))", "h", f"CASE WHEN size(h) < {width} THEN 0 ELSE {counted} END")
    return F.expr(f"CAST({hashed} AS BIGINT)")


def _kept(chars: str) -> Column:
    return F.length(F.regexp_replace("t", f"[^{chars}]+", "")).cast("long")


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", common: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(id, lang, counts, chars, words): a row per document with its counts and its two histograms.

    ``chars`` counts a-z, A-Z, 0-9, ASCII white space, characters beyond ASCII,
    and the rest; ``words`` counts each common word of the language (lower-cased)
    and then all other words. A language without a list has the last bin only.
    """
    common = common or COMMON_WORDS
    lists = F.create_map(*[x for k, v in sorted(common.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    split = own.select(
        "id", "lang", "t", F.regexp_extract_all("t", F.lit(f"[^{SPACE}]+"), F.lit(0)).alias("w"),
        F.expr(f"filter(split(t, '\\n', -1), l -> l RLIKE '[^{SPACE}]')".replace("\\x", "\\\\x")).alias("l"),
    )
    every = sorted({w for v in common.values() for w in v})
    known = F.filter(F.transform("w", F.lower), lambda x: x.isin(every))
    counted = split.select(
        "id", "lang", F.size("w").cast("long").alias("n_words"), F.length("t").cast("long").alias("n"),
        *[_kept(c).alias(k) for k, c in (("lower", "a-z"), ("upper", "A-Z"), ("digit", "0-9"), ("space", SPACE), ("beyond", r"\x{80}-\x{10FFFF}"))],
        _kept("#*$%&|<>").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words("w").alias("n_repeat_words"),
        known.alias("known"), F.coalesce(F.try_element_at(lists, F.col("lang")), F.array().cast("array<string>")).alias("list"),
    )
    hist = F.expr(
        "transform(array(known), k -> transform(list, v -> CAST(size(filter(k, x -> x = v)) AS BIGINT)))[0]"
    )
    return counted.select(
        "id", "lang", "n_words", (F.col("n") - F.col("space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array("lower", "upper", "digit", "space", "beyond", F.expr("n - lower - upper - digit - space - beyond")).alias("chars"),
        hist.alias("words"),
    ).withColumn("words", F.concat("words", F.array(F.expr("n_words - aggregate(words, 0L, (a, x) -> a + x)"))))


def base_failed(least_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def language_references(measured: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """(lang, ref_chars, ref_words): each language's histograms, summed over its documents that pass the base rules.

    A row for each language and one with a null language for the documents that
    have none. The counts of every document go in, whatever the corpus size.
    """
    def sums(name: str) -> Column:
        return F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(bins[name])]).alias(f"ref_{name}")

    return measured.where(~base_failed()).groupBy("lang").agg(sums("chars"), sums("words"))


def _divergence(a: str, b: str) -> str:
    """SQL for the Jensen-Shannon divergence in bits of two count arrays; null if either is all zero."""
    total = lambda x: f"aggregate({x}, 0.0D, (s, v) -> s + v)"
    term = "CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0.0D END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0.0D END"
    pair = f"zip_with(transform({a}, v -> v / {total(a)}), transform(slice({b}, 1, size({a})), v -> v / {total(b)}), (p, q) -> {term})"
    return f"CASE WHEN {total(a)} > 0 AND {total(b)} > 0 THEN aggregate({pair}, 0.0D, (s, v) -> s + v) / (2 * ln(2.0D)) END"


def judge(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", common: Mapping[str, Sequence[str]] | None = None,
    most_chars: tuple[float, float] = MOST_CHARS, most_words: tuple[float, float] = MOST_WORDS,
) -> DataFrame:
    """Each document's counts, divergences and verdict, a row per input row.

    ``kept`` is false if the base rules fail, or if a divergence from the
    document's language (a null language is one of its own) exceeds its limit
    in a text long enough for it. Null and empty texts have no words and fail
    the base rules. A language all of whose documents fail them has no
    reference, and its texts are judged by the base rules alone. Repeated rows
    repeat; extra columns are ignored; an empty table gives no rows. The
    references are one row per language, joined back on it.
    """
    common = common or COMMON_WORDS
    measured = write_stage(measures(docs, id, text, lang, common), "measures")
    bins = {"chars": 6, "words": 1 + max(map(len, common.values()))}
    refs = language_references(measured, bins).withColumnRenamed("lang", "ref_lang")
    joined = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    scored = joined.withColumn("base_failed", base_failed()).withColumn("js_chars", F.expr(_divergence("chars", "ref_chars"))).withColumn(
        "js_words", F.expr(f"CASE WHEN size(words) > 1 THEN {_divergence('words', 'ref_words')} END")
    )
    def beyond(name: str, least: int, most: tuple[float, float]) -> Column:
        return F.coalesce((F.col("n_words") >= least) & (F.col(name) > most[0] + F.try_divide(F.lit(most[1]), "n_words")), F.lit(False))

    strange = beyond("js_chars", LEAST_WORDS_CHARS, most_chars) | beyond("js_words", LEAST_WORDS_WORDS, most_words)
    return scored.select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "js_chars", "js_words", (~F.col("base_failed") & ~strange).alias("kept"),
    )
