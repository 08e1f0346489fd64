"""Personal data by boosted trees over candidate spans.

Generators propose spans of each kind with high recall: the base patterns, and
looser ones around them. Every candidate gets format and context features.
Trees learn from the corpus's own base spans, as they are and rewritten into
the loose formats, against candidates that their format or context disproves;
what is neither is scored, and per-kind thresholds, calibrated on held-out
candidates, select what is redacted beside the base spans. DataFrame and
Spark ML functions only.

A text's spans cost time in proportion to their number: positions are running
sums over blocks, overlaps come from one sort, and context is cut from short
pieces of the text.

The patterns avoid repeated groups: Java's engine recurses once per repetition
there, which a long run of digits would overflow. Separators that a pattern
repeats around are first replaced, one for one, by private characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import write_stage

KINDS = ("email", "ip", "card", "phone")
#: Candidates that training uses at most (chosen by a hash of their place), and boosting rounds.
TRAIN_ROWS = 20_000
ROUNDS, TREE_DEPTH = 12, 4
#: Precision that a kind's threshold must reach on held-out candidates, and how many selected there to tell.
PRECISION, LEAST_HELD = 0.95, 20
GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Code points of context on either side.
CONTEXT = 32

_DOT, _GAP, _OTHER = "\ue001", "\ue002", "\ue003"
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = f"[0-9][0-9{_GAP}]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPELT = (
    r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\[\.\]) ?[A-Za-z0-9-]{2,63}+"
)
_DEFANGED = r"(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}+(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}+(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}+"
_NUMBER = r"(?<![0-9A-Za-z])[(+]?[0-9][0-9().\x20/_\x{2010}-\x{2015}\x{a0}-]{5,38}[0-9](?![0-9A-Za-z])"


#: Entries of an array that a running value goes through in one piece, and code points in a piece of text.
BLOCK, PIECE = 64, 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running results of ``op`` (associative) over an array of longs: within blocks, then over the blocks' ends."""
    start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def within(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(block, start, step)

    def before(acc: Column, w: Column) -> Column:
        return F.struct(op(acc["at"], w["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(x: Column) -> Column:
        return F.flatten(F.transform(x["w"], lambda w, c: F.transform(w["out"], lambda v: op(v, F.get(x["b"], c)))))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda c: within(F.slice(v, c * BLOCK + 1, BLOCK)))
        return _let(cut, lambda w: _let(F.struct(w.alias("w"), F.aggregate(w, start, before, lambda acc: acc["out"]).alias("b")), joined))

    return _let(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast("array<bigint>")))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of (b, e, v), code points, end exclusive."""
    pair = F.struct(F.split(text, pattern, -1).alias("s"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: (F.length(F.get(x["s"], i)) + F.length(m)).cast("long"))
        ends = F.struct(x["m"].alias("m"), _running(lengths, lambda a, b: a + b, 0).alias("ends"))
        return _let(ends, lambda y: F.transform(y["m"], lambda m, i: F.struct((F.get(y["ends"], i) - F.length(m)).alias("b"), F.get(y["ends"], i).alias("e"), m.alias("v"))))

    return _let(pair, placed)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))


def _cut(pieces: Column, b: Column, e: Column) -> Column:
    """Code points b to e (exclusive) of the text that the pieces make up."""
    first = F.floor(b / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((F.greatest(e, b + 1) - 1) / PIECE).cast("int") - first + 1)
    return F.array_join(some, "").substr((b - first * PIECE + 1).cast("int"), F.greatest(e - b, F.lit(0)).cast("int"))


def _touching(spans: Column, others: Column) -> Column:
    """For each span: does one of the others overlap it? One sort, then the furthest end before and the nearest begin after."""
    far = (1 << 62)
    entry = lambda x, i: F.struct(x["b"].alias("b"), x["e"].alias("e"), i.cast("int").alias("i"))
    merged = F.sort_array(F.concat(F.transform(others, lambda x: entry(x, F.lit(-1))), F.transform(spans, entry)))

    def flags(m: Column) -> Column:
        ends = _running(F.transform(m, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(F.lit(0).cast("long"))), F.greatest, 0)
        begins = F.transform(F.reverse(m), lambda x: F.when(x["i"] < 0, x["b"]).otherwise(F.lit(far).cast("long")))
        beside = F.struct(m.alias("m"), ends.alias("ends"), F.reverse(_running(begins, F.least, far)).alias("begins"))

        def hits(y: Column) -> Column:
            own = F.transform(y["m"], lambda x, k: F.struct(x["i"].alias("i"), ((F.get(y["ends"], k) > x["b"]) | (F.get(y["begins"], k) < x["e"])).alias("hit")))
            return F.transform(F.filter(F.sort_array(own), lambda x: x["i"] >= 0), lambda x: x["hit"])

        return _let(beside, hits)

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _let(merged, flags)).otherwise(F.transform(spans, lambda x: F.lit(False)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _empty() -> Column:
    return F.array().cast("array<struct<b:bigint,e:bigint,v:string>>")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind's base rule: leftmost non-overlapping matches, failing ones dropped."""
    t = F.translate(text, _DOT + _GAP, _OTHER * 2)
    dotted = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", _GAP)
    quad = F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")

    def card(x: Column) -> Column:
        d = _digits(x["v"])
        return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))

    digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), _matches(dotted, _EMAIL)).otherwise(_empty()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(t, _IP), lambda x: F.regexp(x["v"], quad))).otherwise(_empty()),
        "card": F.when(digit, F.filter(_matches(joined, _CARD), card)).otherwise(_empty()),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(_matches(t, _PHONE), lambda x: F.length(_digits(x["v"])).between(9, 15))).otherwise(_empty()),
    }


def proposals(text: Column) -> dict[str, Column]:
    """Looser spans of each kind, disproved ones among them, that the trees learn from and judge."""
    numbers = F.when(text.rlike("[0-9]"), _matches(text, _NUMBER)).otherwise(_empty())
    n = lambda x: F.length(_digits(x["v"]))
    dotted = F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, _IP)).otherwise(_empty())
    spelt = F.when(text.rlike(r"[0-9](?:\[\.\]|\(\.\)| \. )[0-9]"), _matches(text, _DEFANGED)).otherwise(_empty())
    return {
        "email": F.when(text.rlike(r"\(at\)|\[at\]|\{at\}| at [A-Za-z0-9-]{1,63}+ ?(?:dot |\(dot|\[dot|\[\.)"), _matches(text, _SPELT)).otherwise(_empty()),
        "ip": F.concat(dotted, spelt),
        "card": F.filter(numbers, lambda x: n(x).between(13, 19)),
        "phone": F.filter(numbers, lambda x: n(x).between(7, 15)),
    }


def _beside_base(spans: Column, own: Column, every: Column) -> Column:
    """Spans that overlap none of their kind's base spans, as (b, e, v, known, taken): taken if a base span of any kind overlaps."""
    def flagged(x: Column) -> Column:
        marks = F.struct(x.alias("x"), _touching(x, own).alias("own"), _touching(x, every).alias("any"))
        listed = lambda y: F.transform(y["x"], lambda z, i: F.struct(
            z["b"].alias("b"), z["e"].alias("e"), z["v"].alias("v"), F.get(y["own"], i).alias("known"), F.get(y["any"], i).alias("taken")))
        return F.filter(_let(marks, listed), lambda z: ~z["known"])
    return _let(spans, flagged)


def _with_context(spans: Column, kind: str, pieces: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["b"].alias("b"), x["e"].alias("e"), _cut(pieces, x["b"], x["e"]).alias("v"),
        _cut(pieces, F.greatest(x["b"] - CONTEXT, F.lit(0).cast("long")), x["b"]).alias("left"),
        _cut(pieces, x["e"], x["e"] + CONTEXT).alias("right"), x["known"].alias("known"), x["taken"].alias("taken"),
    ))


def _plain(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["b"].alias("b"), x["e"].alias("e")))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, base, found): each document's base spans and its candidates with their context."""
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    loose = proposals(F.col("t"))
    whole = F.struct(
        _pieces(F.col("t")).alias("pieces"),
        *[c.alias(f"b_{k}") for k, c in base_spans(F.col("t")).items()], *[c.alias(f"p_{k}") for k, c in loose.items()],
    )

    def candidates(x: Column) -> Column:
        every = F.concat(*[x[f"b_{k}"] for k in KINDS])
        known = lambda k: F.transform(x[f"b_{k}"], lambda y: F.struct(y["b"].alias("b"), y["e"].alias("e"), y["v"].alias("v"), F.lit(True).alias("known"), F.lit(True).alias("taken")))
        found = _let(every, lambda e: F.concat(*[
            F.concat(_with_context(known(k), k, x["pieces"]), _with_context(_beside_base(x[f"p_{k}"], x[f"b_{k}"], e), k, x["pieces"])) for k in KINDS]))
        return F.struct(F.concat(*[_plain(x[f"b_{k}"], k) for k in KINDS]).alias("base"), found.alias("found"))

    scanned = own.select("id", F.monotonically_increasing_id().alias("row"), _let(whole, candidates).alias("x"))
    return scanned.select("id", "row", "x.base", "x.found")


#: Words before or after a number that say it counts, orders or dates something.
_COUNTED = (
    r"(?i)\b(?:order|invoice|item|sku|isbn|issn|serial|version|page|pages|year|years|total|pieces|units|boxes|score|population|votes|ref|ticket|case|"
    r"article|section|chapter|row|column|id|usd|eur|gbp|kg|km|percent)\b|[#$%\x{20ac}\x{a3}]"
)
_DATE = "^(?:19|20)[0-9]{2}[-./\x20]|[-./\x20](?:19|20)[0-9]{2}$|^[0-9]{1,2}[/.][0-9]{1,2}[/.]"
#: Words that stand before "at" in plain sentences.
_PLAIN_WORD = r"(?i)^(?:look|looks|looking|is|are|was|were|be|been|the|a|and|or|it|that|this|here|there|not|only|start|end|stop|arrive|met|meet|one|two) ?(?:at )"


def evidence() -> Column:
    """A candidate's label: 1 for a base span, 0 where format or context disproves it, else missing."""
    v, kind = F.col("v"), F.col("kind")
    d = _digits(v)
    spelt = F.regexp_replace(v, r"\[\.\]|\(\.\)| \. ", ".")
    cue = F.concat("left", F.lit(" "), "right").rlike(_CUES["phone"])
    counted = F.col("left").rlike(f"(?:{_COUNTED})[^\\n]{{0,12}}$") | F.col("right").rlike(f"^.{{0,4}}?(?:{_COUNTED})")
    wrong = (
        F.when(kind == "card", ~F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False)))
        .when(kind == "ip", ~F.regexp(spelt, F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")))
        .when(kind == "email", v.rlike(_PLAIN_WORD) | ~v.rlike("[A-Za-z]{2,24}$"))
        .otherwise(~cue & (counted | v.rlike(_DATE) | ~v.rlike("[^0-9]")))
    )
    return F.when(F.col("known"), 1.0).when(F.col("taken") | wrong, 0.0)


def _loosened() -> Column:
    """A base span's text as people write it around the rules: spelt-out addresses, bracketed dots, numbers without the plus."""
    v, kind = F.col("v"), F.col("kind")
    at = F.regexp_replace(F.regexp_replace(v, "@", " (at) "), r"\.([A-Za-z0-9-]+)$", " (dot) $1")
    return F.when(kind == "email", at).when(kind == "ip", F.regexp_replace(v, r"\.", "[.]")).when(kind == "phone", F.regexp_replace(v, r"^\+", "")).otherwise(v)


_CUES = {
    "email": "(?i)mail|contact|write to|reach", "ip": "(?i)\\bip\\b|host|server|addr|login",
    "card": "(?i)card|visa|master|amex|payment|iban|account", "phone": "(?i)phone|tel|call|fax|mobile|whatsapp|sms",
}


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of candidates, without those that define the base rules (plus sign, at sign, Luhn digit)."""
    v, left, right = F.col("v"), F.col("left"), F.col("right")
    count = lambda pattern: F.coalesce(F.regexp_count(v, F.lit(pattern)), F.lit(0)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    columns = {
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS},
        "length": F.length(v).cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "groups": count("[0-9]+"),
        "spaces": count(r"\x20"), "dots": count("[.]"), "dashes": count("-"), "slashes": count("/"), "brackets": count(r"[()\[\]]"),
        "leading_zero": flag(v.rlike("^[+(]?0")), "date": flag(v.rlike("^(?:19|20)[0-9]{2}[-./]|[-./](?:19|20)[0-9]{2}$")),
        "even_groups": flag(v.rlike("^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$")),
        **{f"cue_{k}": flag((F.col("kind") == k) & F.concat(left, F.lit(" "), right).rlike(p)) for k, p in _CUES.items()},
        "after_word": flag(left.rlike("[A-Za-z0-9]$")), "before_word": flag(right.rlike("^[A-Za-z0-9]")),
        "after_equals": flag(left.rlike("[=\"':#]\\s*$")), "ends_line": flag(right.rlike("^\\s*(\\n|$)")), "starts_line": flag(left.rlike("(^|\\n)\\s*$")),
        "digits_near": (F.coalesce(F.regexp_count(left, F.lit("[0-9]")), F.lit(0)) + F.coalesce(F.regexp_count(right, F.lit("[0-9]")), F.lit(0))).cast("double"),
    }
    return found.withColumns(columns), list(columns)


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Each document's (id, base, added): base spans, and those the trees add, as arrays of (kind, b, e).

    One row per input row. Null and empty texts have none; repeated rows repeat;
    a null id stays null; extra columns are ignored. The trees are fitted on at
    most ``train_rows`` candidates, everything else covers all of them. Where
    the corpus has no candidate of either class, nothing is added. A candidate
    is added if its score reaches its kind's threshold and it overlaps no base
    span of its kind, nor an earlier added one.
    """
    scanned = write_stage(scan(docs, id, text), "spans")
    candidates = scanned.select("row", F.explode("found").alias("x")).select("row", "x.*").withColumn("label", evidence())
    candidates = candidates.withColumn("draw", F.pmod(F.xxhash64("kind", "v", "left", "right"), F.lit(1 << 30)))
    versions = F.when(F.col("known"), F.array("v", _loosened())).otherwise(F.array("v"))
    found, names = features(candidates.withColumn("v", F.explode(F.array_distinct(versions))))
    listed = VectorAssembler(inputCols=names, outputCol="features").transform(found)
    listed = write_stage(listed.select("row", "kind", "b", "e", "label", "draw", "features"), "candidates")
    sizes = {r["label"]: r["n"] for r in listed.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return scanned.select(F.col("id").alias(id), "base", F.expr("slice(base, 1, 0)").alias("added"))
    fraction = min(1.0, train_rows / sum(sizes.values()))
    held = F.pmod(F.col("draw"), F.lit(5)) == 0
    train = listed.where(F.col("label").isNotNull() & ~held & (F.col("draw") < int(fraction * (1 << 30)))).select("features", "label").orderBy("draw").limit(train_rows)
    train = write_stage(train, "train")
    if train.select("label").distinct().count() < 2:
        return scanned.select(F.col("id").alias(id), "base", F.expr("slice(base, 1, 0)").alias("added"))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=TREE_DEPTH, seed=7, maxBins=64, checkpointInterval=-1, cacheNodeIds=False).fit(train)
    scored = model.transform(listed).select("row", "kind", "b", "e", "label", held.alias("held"), F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    scored = write_stage(scored, "scored")
    # How well each step of the grid does on held-out candidates: a row per kind.
    steps = [F.struct(F.lit(g).alias("g"), F.sum(F.when(F.col("p") >= g, F.col("label"))).alias("hit"), F.sum((F.col("p") >= g).cast("long")).alias("n")) for g in GRID]
    table = scored.where("held AND label IS NOT NULL").groupBy("kind").agg(F.array(*steps).alias("steps"))
    good = F.filter("steps", lambda s: (s["n"] >= LEAST_HELD) & (s["hit"] >= PRECISION * s["n"]))
    limits = table.select("kind", F.coalesce(F.get(good, F.lit(0))["g"], F.lit(2.0)).alias("limit"))
    chosen = scored.where("label IS NULL").join(limits, "kind").where("p >= limit")
    per_row = chosen.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "b", "e"))).alias("added"))  # bounded by one text
    joined = scanned.select("id", "row", "base").join(per_row, "row", "left")
    return joined.select(F.col("id").alias(id), "base", F.coalesce("added", F.expr("slice(base, 1, 0)")).alias("added"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, by kind as listed and then start, comma-joined."""
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["b"].alias("b"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x["kind"], x["b"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans are merged under the first one's kind.

    Joined on the id (a null id is left as it is); ids are to be unique in ``found``.
    """
    spans = found.select(F.col(id).alias("__id"), F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(x["b"].alias("b"), x["e"].alias("e"), x["kind"].alias("kind")))).alias("__spans"))
    whole = F.struct(
        _pieces(F.col(text)).alias("pieces"), F.col("__spans").alias("spans"),
        _running(F.transform("__spans", lambda x: x["e"]), F.greatest, 0).alias("ends"), F.length(text).cast("long").alias("n"),
    )

    def done(x: Column) -> Column:
        zero = F.lit(0).cast("long")

        def one(y: Column, i: Column) -> Column:
            past = F.coalesce(F.get(x["ends"], i - 1), zero)
            return F.when(y["b"] >= past, F.concat(_cut(x["pieces"], past, y["b"]), F.lit("["), y["kind"], F.lit("]"))).otherwise(F.lit(""))

        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(F.transform(x["spans"], one), ""), F.when(last < x["n"], _cut(x["pieces"], last, x["n"])).otherwise(F.lit("")))

    joined = docs.join(spans, docs[id] == F.col("__id"), "left")
    return joined.withColumn(text, F.when(F.size("__spans") > 0, _let(whole, done)).otherwise(F.col(text))).select(*docs.columns)
