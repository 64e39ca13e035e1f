import hashlib
import re

from lotline.llm import personal_data as personal
from lotline.llm.queries import op4_personal_data

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, form) in enumerate(FORMS.items())
             for m in re.finditer(form, text or "") if valid(kind, m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


def test_base_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, seen = op4_personal_data(spark, sf_dir).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(w.startswith(k + ":") for w in want) for k in FORMS)
        assert set(want) <= set(filter(None, r.spans.split(",")))
        seen += len(want)
    assert seen > 50


ODD = [None, "", "a@b.c_d@e.f g@h.i.", "@@x@y.z+1 555 123 4567", "1.2.3.4.5.6.7.8 999.1.1.1.5 1.2.3 0001.02.003.4 .1.1.1.1.",
       "4111 1111 1111 1111 4111-1111-1111-1111 5 -4111111111111111 4111111111111111 0", "4111111111111111" * 2,
       "+1 (234) 567-8901 ++12345678901234567 +7.", "é\U0001F600 4111111111111111 x@é.com y@z.com",
       "9" * 60_000, "a" * 60_000, "1 2 " * 20_000, "x." * 30_000 + "@a.b", "1.1.1.1" + ".1" * 5_000,
       "12345678901234567890123 192.168.0.256 00.0.0.0 256.1.1.1", "99999999999999999999999999.1.1.1 a@b.c@d.e"]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(ODD)] * 2 + [(None, ODD[2], None, None)],
                                 "doc_id bigint, text string, spans string, base int")
    rows = personal.personal_data(docs).select(
        "row.*", personal.span_text(personal.F.col("base")).alias("got")).collect()
    assert len(rows) == 2 * len(ODD) + 1
    for r in rows:
        assert r.got == ",".join(brute(r.text)), r.text and r.text[:80]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please call me on +1 (555) 000-{1000 + i} today") for i in range(12)]
    rows += [(50, "please call me on AB-77-1234 today"), (51, "bought on AB-77-1234 of them"), (52, "the year is 20241231")]
    rows += [(60 + i, f"part number X{100000 + i} is here") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in personal.personal_data(docs).select(
        "row.doc_id", personal.span_text(personal.F.col("spans")).alias("spans")).collect()}
    assert spans[50] == "id:18:28" and spans[52] == "" and spans[60] == ""
    assert spans[3] == "phone:18:35"
    masked = {r.doc_id: r.text for r in personal.masked(docs).collect()}
    assert masked[50] == "please call me on [id] today" and masked[0] == "please call me on [phone] today"
    assert masked[52] == rows[14][1]


def test_discoveries_support_further_contexts(spark):
    """Identifiers found behind the context of phones occur behind another one, which finds identifiers of its own."""
    rows = [(i, f"please call me on +1 (555) 000-{1000 + i} today") for i in range(12)]
    for k in range(4):
        rows += [(100 + k, f"please call me on AB-77-{1234 + k} today"), (200 + k, f"employee id: AB-77-{1234 + k} is theirs")]
    rows += [(300, "employee id: CD-88-9999 is theirs"), (301, "badge of CD-88-9999 here"), (302, "shelf number CD-90-1111 here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in personal.personal_data(docs).select(
        "row.doc_id", personal.span_text(personal.F.col("spans")).alias("spans")).collect()}
    assert spans[100] == "id:18:28" and spans[200] == "id:13:23" and spans[300] == "id:13:23"
    assert spans[301] == spans[302] == ""


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert personal.personal_data(docs).collect() == []
