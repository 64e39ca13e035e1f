"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotline.llm import (conversation_repair, decontamination, license_scan, mixing, near_duplicates, personal_data,
                         quality_rules, repeated_bytes, secret_scan, shingle_join, token_alignment, token_files,
                         warc)
from lotline.llm.common import cut_lineage, new_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rows(_table(spark, sf_dir, "documents"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "quality", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.decontaminated(_table(spark, sf_dir, "documents"),
                                          _table(spark, sf_dir, "benchmark"))
    return rows.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.personal_data(_table(spark, sf_dir, "documents"))
    counts = [personal_data.count_of("base", kind).alias(f"n_{kind}") for kind in personal_data.KINDS[:4]]
    digest = F.sha2(personal_data.span_text(F.col("base")).cast("binary"), 256)
    return rows.select("row.doc_id", *counts, digest.alias("base_sha256"),
                       personal_data.span_text(F.col("spans")).alias("spans"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secrets(_table(spark, sf_dir, "documents"))
    spans = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("row.doc_id", "n_candidates", F.size("secrets").cast("bigint").alias("n_secrets"),
                       F.array_join(spans, ",").alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.licenses(_table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_sentences", "n_licenses", F.array_join("licenses", ",").alias("licenses"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, sources = mixing.place(_table(spark, sf_dir, "documents"))
    placed = cut_lineage(placed)
    return mixing.taken_words(placed, mixing.draw_takes(placed, sources))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_ids(_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.read_digests(spark, folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.records(warc.read_chunks(spark, folder, payload="false")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.linked_documents(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.aligned(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(given)
    found = cut_lineage(conversation_repair.repairs(rows))
    digests = conversation_repair.digests(conversation_repair.repaired_rows(rows, found))
    found = found.withColumnRenamed("conv_id", "found_id")
    digests = digests.withColumnRenamed("conv_id", "digest_id")
    every = given.select("conv_id").distinct()
    joined = (every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
              .join(digests, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
    "op11_shingle_join": op11_shingle_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM
                 (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
        dw AS (SELECT r, n, s, w[s:s + n - 1] AS win FROM
                 (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT r, n, s, item_id FROM dw JOIN iw USING (win)),
        words AS (SELECT r, count(*) AS n_hit FROM
                    (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op5_repeated_bytes": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS g
                    FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
        again AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
        starts AS (SELECT r, i FROM windows SEMI JOIN again USING (g)),
        marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM starts),
        runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM
                   (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run),
        gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS first, a AS last FROM runs
                 UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
        kept AS (SELECT r, string_agg(substr(h, 2 * first + 1, 2 * (coalesce(last, len(h) // 2) - first)), '' ORDER BY first) AS k
                 FROM gaps JOIN d USING (r) GROUP BY r),
        removed AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM runs GROUP BY r)
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
               sha256(unhex(coalesce(k, h))) AS kept_sha256
        FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest
              FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d),
        r AS (SELECT *, payload_bytes >= 100 AND page_id > first_page AS again FROM f)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_page END AS refers_to
        FROM r""",
    "op11_shingle_join": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, w[i:i + 3] AS g FROM
                (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        shared AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
        links AS (SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        components AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM d LEFT JOIN sizes USING (r) LEFT JOIN components USING (r)""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE steps AS (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b:
                     CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
            FROM (SELECT unnest(range(256)) AS n)),
        keyed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g,
                    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        crcs AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT,
                     list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
                 FROM (SELECT DISTINCT k FROM keyed), steps),
        hurt AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
                             ELSE coalesce(text, ' ') END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
                 FROM keyed JOIN crcs USING (k)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        faults AS (SELECT *, left(role, 1) AS r, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_char,
                     row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
                     lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS r_before FROM placed),
        marked AS (SELECT *, last_char = '' OR again AS gone,
                     CASE WHEN last_char = '' THEN 'blank' WHEN again THEN 'duplicate'
                          WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM faults),
        counts AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (r_before IS NOT NULL AND r_before || r NOT IN ('su', 'ua', 'au')) AS illegal
                   FROM marked GROUP BY g),
        -- v holds the best of the rows from i on, for the states: start, after s, after u, after a
        best AS (
            SELECT g, n + 1 AS i, [{'c': 0::BIGINT, 'a': ''}, {'c': 10::BIGINT, 'a': 'II'},
                                   {'c': 5::BIGINT, 'a': 'I'}, {'c': 0::BIGINT, 'a': ''}] AS v FROM counts
            UNION ALL
            SELECT g, i, list_transform([1, 2, 3, 4], lambda s: list_min([b[s],
                       {'c': 5 + b[[3, 3, 4, 3][s]].c, 'a': 'I' || b[[3, 3, 4, 3][s]].a},
                       {'c': 10 + b[[4, 4, 3, 4][s]].c, 'a': 'II' || b[[4, 4, 3, 4][s]].a}])) AS v
            FROM (SELECT m.g, m.i, list_transform([1, 2, 3, 4], lambda s: list_min([
                       {'c': 2 + v[s].c, 'a': 'D' || v[s].a},
                       CASE WHEN NOT gone THEN {'c': 1 + more + v[[3, 3, 4, 3][s]].c, 'a': 'R' || v[[3, 3, 4, 3][s]].a} END,
                       CASE WHEN NOT gone AND r = ['u', 'u', 'a', 'u'][s]
                            THEN {'c': more + v[[3, 3, 4, 3][s]].c, 'a': 'K' || v[[3, 3, 4, 3][s]].a}
                            WHEN NOT gone AND r = 's' AND s = 1 THEN {'c': more + v[2].c, 'a': 'K' || v[2].a} END])) AS b
                  FROM (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM marked) m
                  JOIN best ON m.g = best.g AND m.i = best.i - 1)),
        plans AS (SELECT g, v[1].c AS cost, v[1].a AS audit FROM best WHERE i = 1),
        letters AS (SELECT g, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM plans WHERE audit <> ''),
        edits AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY g ORDER BY p) AS i FROM letters),
        kept AS (SELECT d.g, p, e, role, r, text, row_number() OVER (PARTITION BY d.g ORDER BY p) AS q
                 FROM edits d LEFT JOIN marked m ON d.g = m.g AND d.i = m.i AND e <> 'I' WHERE e <> 'D'),
        named AS (SELECT *, CASE WHEN e = 'K' THEN role
                    WHEN (q - max(CASE WHEN q = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g)) % 2 = 1
                    THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM kept),
        digests AS (SELECT g, sha256(string_agg(line, chr(10) ORDER BY p)) AS d FROM named GROUP BY g)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
               coalesce(audit, '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, g FROM keyed) LEFT JOIN counts USING (g) LEFT JOIN plans USING (g) LEFT JOIN digests USING (g)""",
}
