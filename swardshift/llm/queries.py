"""Registered queries: each operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted_pii, bpe_count, decontaminate, divergence, license_scan, line_blocks, line_crf, line_neighbours, lsh_forest, packing, prefix_trie, raking, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_DECONTAMINATE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS g FROM
    (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS g FROM
    (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.k, p.size, g.item FROM places p JOIN grams g USING (size, g)),
per_doc AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN per_doc USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontaminate", _DECONTAMINATE_SQL)
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_occurrences(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return decontaminate.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The margins of the mixing query. The documents carry no topic: the form of the text stands in, and the column says so.
def mixing_margins() -> dict:
    return {
        "source": F.col("source"), "lang": F.col("lang"),
        "topic_form": raking.text_form(F.col("text"), raking.count_words(F.col("text"))),
    }


SWEEPS = 10
TEMPER = 0.5
#: Share of all tokens that the mix keeps.
KEEP_SHARE = 0.5


def _rake_sql() -> str:
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    out = [
        f"WITH counted AS (SELECT *, CASE WHEN 10 * len(regexp_replace(coalesce(text, ''), '[^|]+', '', 'g')) >= greatest(n_tokens, 1) THEN 'table' "
        f"WHEN len(regexp_replace(coalesce(text, ''), '[^A-Z]+', '', 'g')) > len(regexp_replace(coalesce(text, ''), '[^a-z]+', '', 'g')) THEN 'shout' "
        f"WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'treatise' END AS topic_form "
        f"FROM (SELECT doc_id, source, lang, text, CAST({words} AS BIGINT) AS n_tokens FROM documents))",
        "cells AS MATERIALIZED (SELECT source, lang, topic_form, sum(n_tokens) AS tokens FROM counted GROUP BY ALL)",
        f"goal AS MATERIALIZED (SELECT {KEEP_SHARE} * sum(tokens) AS wanted FROM cells)",
    ]
    margins = ["source", "lang", "topic_form"]
    for m in margins:
        out.append(f"w_{m} AS (SELECT {m}, sum(tokens) AS tokens, CASE WHEN sum(tokens) > 0 THEN pow(CAST(sum(tokens) AS DOUBLE), {TEMPER}) ELSE 0 END AS t FROM cells GROUP BY {m})")
        out.append(f"f_{m}_0 AS MATERIALIZED (SELECT {m}, tokens, wanted, wanted * t / (SELECT sum(t) FROM w_{m}) AS t FROM w_{m}, goal)")
        for k in range(raking.FILL_STEPS):
            had, rest = (f"(SELECT coalesce(sum({x}), 0) FROM f_{m}_{k} WHERE {c})" for x, c in (("tokens", "t >= tokens"), ("t", "t < tokens")))
            out.append(f"f_{m}_{k + 1} AS MATERIALIZED (SELECT {m}, tokens, wanted, CASE WHEN t >= tokens THEN tokens ELSE t * CASE WHEN {rest} > 0 THEN (wanted - {had}) / {rest} ELSE 1 END END AS t FROM f_{m}_{k})")
    last = raking.FILL_STEPS
    joins = " ".join(f"JOIN f_{m}_{last} t_{m} ON c.{m} IS NOT DISTINCT FROM t_{m}.{m}" for m in margins)
    out.append(f"s0 AS (SELECT c.*, {', '.join(f't_{m}.t AS t_{m}' for m in margins)}, {KEEP_SHARE}::DOUBLE AS p FROM cells c {joins})")
    step = 0
    for _ in range(SWEEPS):
        for m in margins:
            now = f"sum(tokens * p) OVER (PARTITION BY {m})"
            out.append(f"s{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN least(1.0, p * t_{m} / {now}) ELSE p END AS p) FROM s{step})")
            step += 1
    u = "(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0)"
    on = " AND ".join(f"d.{m} IS NOT DISTINCT FROM x.{m}" for m in margins)
    return ",\n".join(out) + f"\nSELECT d.doc_id, d.topic_form, d.n_tokens, round(x.p, 6) + 0.0 AS probability, {u} < x.p AS kept FROM counted d JOIN s{step} x ON {on}"


@query("op2_mix_sources", _rake_sql())
def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = raking.mix_documents(table(spark, sf, "documents"), mixing_margins(), temper=TEMPER, sweeps=SWEEPS, keep_share=KEEP_SHARE)
    return mixed.select("doc_id", "topic_form", "n_tokens", (F.round("probability", 6) + F.lit(0.0)).alias("probability"), "kept")


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf, "documents"))


_NEAR_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS root, doc_id AS node FROM docs UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN least l ON l.node = d.doc_id
"""


@query("op4_lsh_forest", _NEAR_SQL)
def op4_lsh_forest(spark: SparkSession, sf: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf, "documents"), percent=85)


def piece_model() -> str:
    """The vocabulary file of the token count: a public one, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op6_bpe_count")
def op6_bpe_count(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf, "documents"), piece_model())


_LINES_SQL = r"""
WITH lines AS MATERIALIZED (SELECT doc_id, k - 1 AS line, trim(l[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM
    (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
long AS MATERIALIZED (SELECT *, doc_id * 1000000 + line AS pos FROM lines WHERE length(body) >= 24),
firsts AS MATERIALIZED (SELECT body, min(pos) AS pos FROM long GROUP BY body),
cuts AS MATERIALIZED (SELECT body, pos, p, hash(substr(body, 1, p - 1) || substr(body, p + 1)) AS z FROM (SELECT body, pos, unnest(range(1, length(body) + 1)) AS p FROM firsts)),
changed AS (SELECT z, p, min(pos) AS pos FROM cuts GROUP BY ALL),
shorter AS (SELECT z, min(pos) AS pos FROM cuts GROUP BY ALL),
beaten AS (
    SELECT c.body FROM cuts c JOIN changed x ON x.z = c.z AND x.p = c.p AND x.pos < c.pos
    UNION SELECT c.body FROM cuts c JOIN firsts f ON hash(f.body) = c.z AND f.pos < c.pos
    UNION SELECT f.body FROM firsts f JOIN shorter s ON s.z = hash(f.body) AND s.pos < f.pos),
dropped AS (SELECT l.doc_id, l.line FROM long l JOIN firsts f USING (body) LEFT JOIN beaten b USING (body) WHERE l.pos > f.pos OR b.body IS NOT NULL)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_dropped, coalesce(gone, '') AS dropped
FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) d
LEFT JOIN (SELECT doc_id, count(*) AS m, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS gone FROM dropped GROUP BY doc_id) USING (doc_id)
"""


def _all_lines_sql() -> str:
    """Copies among all lines that are not blank; near lines from 24 characters on."""
    out = _LINES_SQL
    for own, other in (
        ("WHERE length(body) >= 24)", "WHERE length(body) >= 1)"), ("AS p FROM firsts)", "AS p FROM firsts WHERE length(body) >= 24)"),
        ("AND f.pos < c.pos", "AND f.pos < c.pos AND length(f.body) >= 24"), ("AND s.pos < f.pos)", "AND s.pos < f.pos AND length(f.body) >= 24)"),
    ):
        assert out.count(own) == 1, own
        out = out.replace(own, other)
    return out


def _gone_lines(spark: SparkSession, sf: str, **options) -> DataFrame:
    docs = table(spark, sf, "documents")
    gone = line_neighbours.repeated_lines(docs, **options).groupBy(F.col("id").alias("gid")).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    own = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return own.join(gone, own.doc_id.eqNullSafe(gone.gid), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("dropped"),
    )


@query("op9_line_neighbours", _all_lines_sql())
def op9_line_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _gone_lines(spark, sf)


@query("op9_all_lines", _all_lines_sql())
def op9_all_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same with its bounds spelt out."""
    return _gone_lines(spark, sf, least_chars=24, copy_chars=1, edits=1)


def _divergence_sql() -> str:
    every = divergence.COMMON_WORDS
    ws = r"[^\x20\x09-\x0D]"
    hist = " ".join(
        f"WHEN '{lang}' THEN [{', '.join(f'len(list_filter(lw, lambda x: x = {chr(39)}{v}{chr(39)}))' for v in words)}]" for lang, words in sorted(every.items())
    )
    kept = lambda c: f"length(regexp_replace(t, '[^{c}]+', '', 'g'))"
    js = lambda a, b: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_sum([CASE WHEN z[1] > 0 THEN z[1] * ln(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END + "
        f"CASE WHEN z[2] > 0 THEN z[2] * ln(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END FOR z IN "
        f"[[{a}[k] / list_sum({a})::DOUBLE, {b}[k] / list_sum({b})::DOUBLE] FOR k IN range(1, len({a}) + 1)]]) / (2 * ln(2.0)) END"
    )
    sums = lambda c, n: f"[{', '.join(f'coalesce(sum({c}[{k}]), 0)' for k in range(1, n + 1))}]"
    n_bins = 1 + max(map(len, every.values()))
    beyond = lambda most: f"{most[0]} + {most[1]} / n_words"
    return rf"""
WITH d AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{ws}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS l
    FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
windows AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS MATERIALIZED (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, length(t) - {kept(r'\x20\x09-\x0D')} AS word_chars, {kept('#*$%&|<>')} AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    [{kept('a-z')}, {kept('A-Z')}, {kept('0-9')}, {kept(r'\x20\x09-\x0D')}, {kept(r'\x{80}-\x{10FFFF}')}] AS c5, length(t) AS n, list_transform(w, lambda x: lower(x)) AS lw
    FROM d LEFT JOIN rep USING (doc_id)),
h AS MATERIALIZED (SELECT * EXCLUDE (lw, c5, n), list_append(c5, n - list_sum(c5)) AS chars, CASE lang {hist} ELSE CAST([] AS BIGINT[]) END AS counts FROM m),
f AS MATERIALIZED (SELECT * EXCLUDE (counts), list_append(counts, n_words - coalesce(list_sum(counts), 0)) AS words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM h),
refs AS (SELECT lang AS ref_lang, {sums('chars', 6)} AS ref_chars, {sums('words', n_bins)} AS ref_words FROM f WHERE NOT base_failed GROUP BY lang),
s AS (SELECT f.*, {js('chars', 'ref_chars')} AS js_chars, CASE WHEN len(words) > 1 THEN {js('words', 'ref_words')} END AS js_words
    FROM f LEFT JOIN refs ON lang IS NOT DISTINCT FROM ref_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(js_chars, 6) + 0.0 AS js_chars, round(js_words, 6) + 0.0 AS js_words,
    NOT base_failed AND NOT (coalesce(n_words >= {divergence.LEAST_WORDS_CHARS} AND js_chars > {beyond(divergence.MOST_CHARS)}, false)
        OR coalesce(n_words >= {divergence.LEAST_WORDS_WORDS} AND js_words > {beyond(divergence.MOST_WORDS)}, false)) AS kept
FROM s
"""


@query("op10_divergence", _divergence_sql())
def op10_divergence(spark: SparkSession, sf: str) -> DataFrame:
    judged = divergence.judge(table(spark, sf, "documents"))
    return judged.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("js_chars", "js_words")})


@query("op7_line_blocks")
def op7_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return line_blocks.extract_pages(table(spark, sf, "pages"))


@query("op8_boosted_pii")
def op8_boosted_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = boosted_pii.find_personal_data(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in boosted_pii.KINDS],
        F.sha2(boosted_pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        boosted_pii.span_text(F.concat("base", "added")).alias("spans"),
    )


@query("op5_line_crf")
def op5_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    field = line_crf.train(docs, table(spark, sf, "labels"))
    scored = line_crf.with_scores(docs.select("doc_id", "text"), field, score="score")
    return scored.select("doc_id", line_crf.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def crc32_sql(bytes_list: str) -> str:
    """DuckDB SQL: the unsigned CRC-32 of a list of byte values."""
    step = "xor(z >> 1, 3988292384 * (z & 1))"
    byte = f"list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda z, i: {step})"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda a, b: {byte}))"


_TRIE_SQL = rf"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    substr(sha256('0:' || length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (SELECT c, list(md5(r) || md5(t) ORDER BY pos) AS l, list(len(regexp_extract_all(t, '[^ 	-
]+')) ORDER BY pos) AS w FROM turns GROUP BY c),
planned AS (SELECT *, {crc32_sql("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 4 AS h FROM seqs),
rebuilt AS (SELECT s.c, list_concat(coalesce(b.l, [])[1:s.h], s.l[s.h + 1:]) AS l, list_concat(coalesce(b.w, [])[1:s.h], s.w[s.h + 1:]) AS w
    FROM planned s LEFT JOIN seqs b ON b.c = s.c - s.c % 20),
members AS MATERIALIZED (SELECT c, d, array_to_string(l[1:d], '') AS k, array_to_string(l[1:d - 1], '') AS pk, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(l) AS ends
    FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (SELECT k, d, min(pk) AS pk, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * min(w) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS sha FROM members GROUP BY k, d),
kids AS (SELECT pk, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
under AS (SELECT m.k, m.d, sum(x.own) AS saved, count(*) FILTER (y.n IS NULL) AS leaves
    FROM nodes x LEFT JOIN kids y ON y.pk = x.k AND y.d = x.d JOIN members m ON m.c = x.conv_id AND m.d <= x.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(y.n, 0) AS n_children, u.leaves AS n_leaves,
    CAST(u.saved AS BIGINT) AS saved_tokens, n.sha AS ends_sha256
FROM nodes n JOIN under u ON u.k = n.k AND u.d = n.d LEFT JOIN kids y ON y.pk = n.k AND y.d = n.d LEFT JOIN nodes p ON n.d > 0 AND p.k = n.pk AND p.d = n.d - 1
"""


@query("op13_prefix_trie", _TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"), prefix_trie.spliced(20, 4))


_RUN_BYTES = "list_transform(range(1, length(hex(encode(x))), 2), lambda i: CAST('0x' || substr(hex(encode(x)), i, 2) AS BIGINT))"
_SPELLING_SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT id, run, count(*) AS n, coalesce(id, 'null') || ':' || run AS x FROM (SELECT CAST(doc_id AS VARCHAR) AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY id, run),
hashed AS (SELECT run, n, {crc32_sql(_RUN_BYTES)} AS h FROM runs),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM
    (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS MATERIALIZED (SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b ON a.z = b.z AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.z = b.word UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.z = b.word),
top AS (SELECT x, count(*) AS n_near, max(n) AS top_n, arg_min(y, (-n, y)) AS top FROM near JOIN words ON word = y GROUP BY x),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
    FROM words LEFT JOIN top ON x = word),
paths AS (SELECT word, word AS here, 0 AS steps FROM formed UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN formed f ON f.word = p.here WHERE f.form IS NOT NULL)
SELECT f.*, r.root FROM formed f JOIN (SELECT word, arg_max(here, steps) AS root FROM paths GROUP BY word) r USING (word)
"""


@query("op12_spelling", _SPELLING_SQL)
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(spelling.vocabulary(table(spark, sf, "documents")))


def byte_vocabulary() -> str:
    """The vocabulary file of the packing: a public one, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_packing")
def op11_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), byte_vocabulary(), capacity=2048, end_id=0)
