"""Personal data by bootstrapped contextual extraction, in built-in expressions only.

*Seeds.* Emails, IP addresses, payment cards and phone numbers have forms that can be checked
(``base_spans``). *Patterns.* The one or two words to the left of an identifier are its
lexical patterns. *Graph.* Distinct (pattern, instance) pairs link patterns with the
identifier-like strings they introduce, seeds and others. *Scores.* In turns, a pattern scores the mean
of its instances' scores (one unknown instance is added to each, so that rare patterns stay modest), and an
instance that is no seed scores as its best pattern. A pattern counts once ``LEAST_SUPPORT`` different instances that score at
least ``CONFIDENT`` support it, seeds or not, so identifiers found behind one pattern support others in the next turn.
Scores only grow; the turns end when one brings no new confident instance and all scores together grow by a ten-thousandth
at most. *Discovery.* Identifiers behind a
pattern that scores at least ``CONFIDENT`` become spans of kind ``id``. Discovered spans never overlap a base span, and base
spans stay. Patterns are looked for in the ``CONTEXT_CHARS`` characters before an identifier: a longer word beside it counts
with its end.

The graph is gathered over all documents; equal texts are held once, by digest. Hot patterns are summed
map-side and joined as ``join_small`` does. What is collected per text is bounded by the text.

Positions are code points, ends exclusive. Null texts are empty and have no spans. Repeated rows each get
their spans. Without seeds nothing is discovered. An empty table gives an empty result. Columns of the input are kept
in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import cut_lineage, join_small, packed, text_of, written

CONFIDENT = 0.5
LEAST_SUPPORT = 3
SETTLED = 1e-4
CONTEXT_CHARS = 64
SPAN = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"

# The forms of the base kinds. Possessive quantifiers and look-behinds match the same strings as the
# plain forms do from left to right, without trying again inside a run that has failed.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_/-]{5,}+"
LEAST_DIGITS = 4
KINDS = ("email", "ip", "card", "phone", "id")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, kind: str, maybe: Column, valid) -> Column:
    """Spans of the matches for which ``valid`` holds.

    Spark gives matches without their places; they follow from the lengths of the matches and of the
    gaps between them. Texts for which ``maybe`` is false are not searched.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))

        def step(a: Column, m: Column) -> Column:
            start = a["end"] + F.length(m["gap"])
            end = start + F.length(m["found"])
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m["found"].alias("found"))
            return F.struct(end.alias("end"), F.concat(a["spans"], F.array(one)).alias("spans"))

        start = F.struct(F.lit(0).cast("bigint").alias("end"), none.alias("spans"))
        return F.aggregate(steps, start, step, lambda a: F.filter(a["spans"], lambda s: valid(s["found"])))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(maybe, _let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"[^0-9]", "")


def _is_ip(found: Column) -> Column:
    return F.forall(F.split(found, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3)
                    & (F.coalesce(part.try_cast("bigint"), F.lit(1000)) <= 255))


def _passes_luhn(found: Column) -> Column:
    """Every second digit from the right is doubled, 9 taken off above 9; the sum ends in 0."""
    figures = F.reverse(F.filter(F.split(_digits(found), ""), lambda d: d != ""))
    values = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(10, 15)


def base_spans(text: Column) -> Column:
    """Seed spans of all kinds, by start and then kind in the order of ``KINDS``."""
    digit = text.rlike("[0-9]")
    found = F.concat(
        _spans(text, EMAIL, "email", F.contains(text, F.lit("@")), lambda f: F.lit(True)),
        _spans(text, IP, "ip", digit & F.contains(text, F.lit(".")), _is_ip),
        _spans(text, CARD, "card", digit, _passes_luhn),
        _spans(text, PHONE, "phone", F.contains(text, F.lit("+")), _is_phone))
    return in_order(found)


def in_order(spans: Column) -> Column:
    """Spans by start, then kind in the order of ``KINDS``."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("a"), F.array_position(order, s["kind"]).alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def span_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def _other_identifiers(text: Column, base: Column) -> Column:
    """Identifier-like strings that overlap no base span."""
    found = _spans(text, IDENTIFIER, "id", text.rlike("[0-9]"), lambda f: F.length(_digits(f)) >= LEAST_DIGITS)
    return F.filter(found, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def _patterns(text: Column, span: Column) -> Column:
    """The word, and the two words, that end right before the span; none where there are no letters."""
    begin = F.greatest(F.lit(0), span["start"] - CONTEXT_CHARS)
    left = F.lower(F.substring(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int")))
    one = F.regexp_extract(left, r"(\p{L}[^\s]*[\s]*)$", 1)
    two = F.regexp_extract(left, r"(\p{L}[^\s]*\s+[^\s]+[\s]*)$", 1)
    return F.array_distinct(F.filter(F.transform(F.array(one, two), lambda p: F.regexp_replace(p, r"\s+", " ")),
                                     lambda p: p != ""))


def occurrences(docs: DataFrame) -> DataFrame:
    """text_key, kind, start, end, instance and patterns of every seed and identifier, once per distinct text."""
    texts = docs.select(text_of("text").alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.withColumn("base", base_spans(F.col("text")))
    texts = texts.withColumn("spans", F.concat("base", _other_identifiers(F.col("text"), F.col("base"))))
    rows = texts.where(F.size("spans") > 0).select(
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"), "text", F.explode("spans").alias("s"))
    return rows.select(
        "text_key", "s.kind", "s.start", "s.end", F.lower("s.found").alias("instance"),
        _patterns(F.col("text"), F.col("s")).alias("patterns")).distinct()


def confident_patterns(seen: DataFrame) -> DataFrame:
    """pattern and score of those that score at least ``CONFIDENT``; each turn is two aggregates."""
    edges = cut_lineage(seen.select(F.explode("patterns").alias("pattern"), "instance", (F.col("kind") != "id").alias("seed"))
                        .groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    instances = written(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), "instances")
    before = None
    while True:
        sure = F.col("score") >= CONFIDENT
        scored = written(
            join_small(edges, instances, ["instance"], "inner").groupBy("pattern")
            .agg((F.round(F.sum("score") / (F.count(F.lit(1)) + 1), 10)).alias("pattern_score"), F.count_if(sure).alias("support"))
            .where(F.col("support") >= LEAST_SUPPORT), "patterns")
        found = scored.where(F.col("pattern_score") >= CONFIDENT)
        instances = written(
            join_small(edges, scored, ["pattern"], "left").groupBy("instance").agg(
                F.greatest(F.max(F.col("seed").cast("double")),
                           F.coalesce(F.max("pattern_score"), F.lit(0.0))).alias("score")), "instances")
        now = instances.agg(F.count_if(sure), F.sum("score")).first()
        if before and now[0] == before[0] and now[1] - before[1] <= SETTLED * now[1] or not now[0]:
            return found.select("pattern", "pattern_score")
        before = now


def discovered(docs: DataFrame) -> DataFrame:
    """text_key and its discovered spans, in order."""
    seen = cut_lineage(occurrences(docs))
    patterns = cut_lineage(confident_patterns(seen))
    unseen = seen.where("kind = 'id'").select("text_key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    hits = join_small(unseen, patterns, ["pattern"], "left_semi").select("text_key", "start", "end", "instance").distinct()
    one = F.struct(F.lit("id").alias("kind"), "start", "end", F.col("instance").alias("found"))
    return hits.groupBy("text_key").agg(F.collect_list(one).cast(SPAN).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """row (all columns of the input), base (seed spans) and spans (with the discovered ones) of every document."""
    more = cut_lineage(discovered(docs)).withColumnRenamed("text_key", "of")
    rows = docs.select(packed(docs).alias("row"), text_of("text").alias("text_"))
    rows = rows.select("row", F.unhex(F.sha2(F.col("text_").cast("binary"), 256)).alias("text_key"),
                       base_spans(F.col("text_")).alias("base"))
    joined = join_small(rows, more, F.col("text_key") == F.col("of"))
    return joined.select("row", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        in_order(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span of the text replaced by its kind in brackets."""
    rows = personal_data(docs)

    def put(a: Column, s: Column) -> Column:
        text = F.col("row")["text"]
        begin = F.greatest(a["end"], s["start"])
        gap = F.substring(text, (a["end"] + 1).cast("int"), (begin - a["end"]).cast("int"))
        mark = F.when(s["start"] >= a["end"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.concat(a["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("out"))
    text = F.when(F.size("spans") == 0, F.col("row")["text"]).otherwise(F.aggregate(
        "spans", start, put, lambda a: F.concat(a["out"], F.substring(
            F.col("row")["text"], (a["end"] + 1).cast("int"), F.length(F.col("row")["text"])))))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
