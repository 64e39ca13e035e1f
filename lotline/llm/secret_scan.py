"""Secrets told from other random-looking strings by a random forest.

*Candidates* are runs of 16 or more letters, digits and ``_+/.-``, every value assigned to a secret's name, of any length
and with any symbols, up to the closing quote or white space, and blocks of private keys. *Measures* of one are its length,
shares of character classes, how often the class changes from character to character, its variety of characters, how much of
it is made of words of the corpus, whether it looks like a path or stands in one, and how much prose is beside it.

*Training.* Labelled findings are candidates with a verdict. Where no table of them is given, findings
that need no judgement are used, and what they are known by is kept from the forest: a value with digits, assigned to a name
such as ``token`` or ``password`` (a short number is left to the forest), or of a published form (``FORMS``) is one; a candidate
without such a name beside it that is part of an address, or has letters or digits only, is none.
The forest learns from the strings themselves, so it also finds secrets that no name introduces.
It is fitted on a bounded sample of ``SAMPLE`` findings per verdict, chosen by hash. Everything
else runs over all candidates: the forest decides about each but those of published forms, which are secrets.

*Dictionary.* Letter runs of candidates are looked up among the words of all documents: one that at least ``LEAST_DOCS``
distinct texts use as a word is a dictionary word. Only words that candidates ask for are counted, map-side first.

Candidates are held by digest of the text, so copies share a result. Null texts are empty. Without findings of
both verdicts there is nothing to learn from, and every candidate assigned to a secret's name or of a published form counts as
secret. Repeated
rows each get their result. An empty table gives an empty result. Columns of the input are kept in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import cut_lineage, join_small, packed, text_of, white_words

CANDIDATE = r"[A-Za-z0-9_+/.-]{16,}+={0,2}"
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential|auth)"
ASSIGNED = r"[\"']?\s*(?:=|:=|:|=>)\s*[\"']?$"
VALUE = (r"((?i:" + NAMES.removeprefix("(?i)") + r")[A-Za-z0-9_-]*[\"']?\s*(?::=|=>|=|:)\s*"
         r"(?:\"(?=[^\"\r\n]+\")|'(?=[^'\r\n]+')|`(?=[^`\r\n]+`)|[\"'`]?(?=[^\s\"'`])))"
         r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?<=`)[^`\r\n]+(?=`)|[^\s\"'`]*[^\s\"'`,;)\]}])")
KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
# Published forms of access keys and tokens.
FORMS = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
         r"|AIza[0-9A-Za-z_-]{35}|glpat-[A-Za-z0-9_-]{20}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"
         r"|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*)$")
SAMPLE = 10_000
LEAST_DOCS = 3
BESIDE = 48
TREES, DEPTH, SEED = 24, 6, 17
MEASURES = ("length", "digits", "capitals", "marks", "changes", "variety", "dictionary", "slashes", "dots",
            "in_path", "quoted", "words_beside", "prose_beside")
"""What the forest sees. The columns at_sign, named, assigned and known, by which findings are labelled, are not among it."""
SPAN = "array<struct<start:bigint,end:bigint,found:string>>"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, lead: Column | None = None) -> Column:
    """Places of all matches, from their lengths and those of the gaps between them. ``lead``: what each begins with and is no part of it."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        first = F.transform(found, lambda m: F.lit("")) if lead is None else lead
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.arrays_zip(found.alias("found"), gaps.alias("gap"), first.alias("lead"))

        def step(a: Column, m: Column) -> Column:
            start = a["end"] + F.length(m["gap"]) + F.length(m["lead"])
            end = start - F.length(m["lead"]) + F.length(m["found"])
            value = F.substring(m["found"], F.length(m["lead"]) + 1, F.length(m["found"]))
            one = F.struct(start.alias("start"), end.alias("end"), value.alias("found"))
            return F.struct(end.alias("end"), F.concat(a["spans"], F.array(one)).alias("spans"))

        return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("end"), none.alias("spans")), step, lambda a: a["spans"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def candidates(docs: DataFrame) -> DataFrame:
    """text_key, start, end, found, before and after (the text beside it), once per distinct text."""
    text = F.col("text")
    values = _spans(text, VALUE, F.regexp_extract_all(text, F.lit(VALUE), F.lit(1)))
    blocks = F.when(text.contains("PRIVATE KEY-----"), _spans(text, KEY_BLOCK)).otherwise(F.array().cast(SPAN))
    spans = F.concat(_spans(text, CANDIDATE), values, blocks)
    texts = docs.select(text_of("text").alias("text")).select("text", spans.alias("spans"))
    rows = texts.select(text_key(F.col("text")).alias("text_key"), "text", F.explode("spans").alias("s"))
    begin = F.greatest(F.lit(0), F.col("s.start") - BESIDE)
    return rows.select(
        "text_key", "s.start", "s.end", "s.found",
        F.substring("text", (begin + 1).cast("int"), (F.col("s.start") - begin).cast("int")).alias("before"),
        F.substring("text", (F.col("s.end") + 1).cast("int"), F.lit(BESIDE)).alias("after")).distinct()


def _letter_runs(found: Column) -> Column:
    return F.filter(F.split(F.lower(found), "[^a-z]+"), lambda w: F.length(w) >= 3)


def dictionary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """word: the letter runs of candidates that enough distinct texts have as a word."""
    asked = cut_lineage(found.select(F.explode(_letter_runs(F.col("found"))).alias("word")).distinct())
    words = F.array_distinct(F.transform(white_words(text_of("text")), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}]+|[^\p{L}]+$", "")))
    used = docs.select(F.xxhash64(text_of("text")).alias("text"), F.explode(words).alias("word"))
    used = join_small(used, asked, ["word"], "inner").distinct()
    return used.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS).select("word")


def _class(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3)


def measured(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``MEASURES`` to candidates."""
    found = found.withColumn("c", F.monotonically_increasing_id())
    found = cut_lineage(found)
    known = cut_lineage(dictionary(docs, found))
    runs = found.select("c", F.explode(_letter_runs(F.col("found"))).alias("word"))
    covered = join_small(runs, known, ["word"], "left_semi").groupBy("c").agg(F.sum(F.length("word")).alias("covered"))
    rows = found.join(covered, "c", "left").drop("c")
    s, n = F.col("found"), F.length("found")
    classes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), _class)
    changes = _let(classes, lambda k: F.size(F.filter(F.sequence(F.lit(1), F.size(k) - 1), lambda i: F.get(k, i) != F.get(k, i - 1))))
    count = lambda pattern: F.regexp_count(s, F.lit(pattern)) / n
    flag = lambda condition: condition.cast("double")
    name = F.col("before").rlike(NAMES) | s.rlike("^" + NAMES)
    return rows.withColumns({
        "length": n.cast("double"), "digits": count("[0-9]"), "capitals": count("[A-Z]"), "marks": count("[^A-Za-z0-9]"),
        "changes": changes / F.greatest(n - 1, F.lit(1)), "variety": F.size(F.array_distinct(F.split(s, ""))) / F.least(n, F.lit(64)),
        "dictionary": F.coalesce("covered", F.lit(0)) / n, "slashes": count("/"), "dots": count("[.]"),
        "at_sign": flag(F.col("before").endswith("@") | F.col("after").startswith("@")),
        "named": flag(name), "assigned": flag(F.col("before").rlike(NAMES + r"[A-Za-z0-9_-]*" + ASSIGNED)),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "in_path": flag(F.col("before").rlike(r"[/\\.:]$") | F.col("after").rlike(r"^[/\\:]")),
        "known": flag(s.rlike(FORMS)),
        "words_beside": F.size(white_words(F.col("before"))) / 8.0,
        "prose_beside": F.regexp_count(F.concat("before", "after"), F.lit(r"[\p{L} ]")) / float(2 * BESIDE)})


def verdict() -> Column:
    """1 or 0 for candidates that need no judgement, else null."""
    number = (F.col("digits") == 1) & (F.col("length") < 16)
    return (F.when((F.col("known") == 1) | (F.col("assigned") == 1) & (F.col("digits") > 0.05) & ~number, 1.0)
            .when((F.col("named") == 0) & ((F.col("digits") == 0) | (F.col("digits") == 1) | (F.col("at_sign") == 1)), 0.0))


def _assembled(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler  # MLlib is loaded only where it is used
    return VectorAssembler(inputCols=list(MEASURES), outputCol="features").transform(rows)


def fit(findings: DataFrame, sample: int = SAMPLE):
    """A forest of the findings (``MEASURES`` and label); at most ``sample`` distinct ones of each label, by hash."""
    from pyspark.ml.classification import RandomForestClassifier
    order = F.xxhash64(F.lit(SEED), "found", "before", "after")
    findings = findings.dropDuplicates(["found", "before", "after", "label"])  # near copies repeat a finding
    parts = [findings.where(F.col("label") == label).orderBy(order).limit(sample) for label in (0.0, 1.0)]
    chosen = cut_lineage(parts[0].unionByName(parts[1]))
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return forest.fit(_assembled(chosen.repartition(1).sortWithinPartitions("found", "before", "after")))


def scored(rows: DataFrame, model) -> DataFrame:
    """Adds chance (of being a secret)."""
    from pyspark.ml.functions import vector_to_array
    if model is None:
        return rows.withColumn("chance", F.greatest("assigned", "known"))
    out = model.transform(_assembled(rows))
    return out.withColumn("chance", F.when(F.col("known") == 1, 1.0).otherwise(vector_to_array("probability")[1])).drop(
        "features", "rawPrediction", "probability", "prediction")


def secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """row (all columns of the input), n_candidates, and secrets (start, end, chance) of every document.

    ``findings``: labelled candidates (found, before, after, label), else see ``verdict``.
    """
    rows = cut_lineage(measured(docs, candidates(docs)))
    labelled = (measured(docs, findings.withColumn("start", F.lit(0))).withColumn("label", F.col("label").cast("double"))
                if findings is not None else rows.withColumn("label", verdict()).where("label is not null"))
    judged = scored(rows, fit(labelled))
    by_text = cut_lineage(judged.groupBy("text_key").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.array_sort(F.collect_list(F.when(F.col("chance") > 0.5, F.struct("start", "end", F.round("chance", 6).alias("chance"))))).alias("secrets"))
        .withColumnRenamed("text_key", "of"))
    out = docs.select(packed(docs).alias("row"), text_key(text_of("text")).alias("text_key"))
    out = join_small(out, by_text, F.col("text_key") == F.col("of"))
    return out.select("row", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                      F.coalesce("secrets", F.array().cast("array<struct<start:bigint,end:bigint,chance:double>>")).alias("secrets"))
