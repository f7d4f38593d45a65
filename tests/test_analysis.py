"""Document-wide semantics with injected detectors."""

import pytest

from veilspan.operators import analysis as A
from veilspan.operators.extract import dictionary, find_patterns
from veilspan.plans import redact as R


def readings(spark, rows):
    """rows: (doc, unit, reading, is_scan, page, text)"""
    return spark.createDataFrame(rows, "doc_id long, unit_no int, reading_no int, is_scan boolean, page int, text string")


def typed(spark, *texts):
    return readings(spark, [(1, i, 0, False, i, t) for i, t in enumerate(texts)])


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, unit_no int, reading_no int, start int, end int, label string, score double")


def test_repeats_across_pages(spark):
    r = typed(spark, "Ana Souza signs.", "ANA   souza again, Anabel not")
    marks, found = R.analyse_readings(r, dictionary({"Ana Souza": ("private_person", 0.9)}))
    assert sorted((x["unit_no"], x["value"]) for x in marks.collect()) == [(0, "Ana Souza"), (1, "ANA   souza")]
    assert {x["detection_id"] for x in found.collect()} == {"0:0-9:private_person", "1:0-11:private_person"}


def test_weak_or_short_values_stay_where_they_are(spark):
    r = typed(spark, "Bo and Carl here", "Bo and Carl there")
    s = spans_of(spark, [(1, 0, 0, 0, 2, "private_person", 0.9), (1, 0, 0, 7, 11, "private_person", 0.5)])
    assert A.repeats(A.tokens(s, r), r).count() == 0


def test_token_keeps_the_strongest(spark):
    r = typed(spark, "Ana x Ana")
    s = spans_of(spark, [(1, 0, 0, 0, 3, "private_person", 0.7), (1, 0, 0, 6, 9, "secret", 0.9)])
    assert [tuple(x)[1:] for x in A.tokens(s, r).collect()] == [("ana", "Ana", "secret", 0.9)]


def test_never_across_documents(spark):
    r = readings(spark, [(1, 0, 0, False, None, "Ana Souza"), (2, 0, 0, False, None, "Ana Souza")])
    s = spans_of(spark, [(1, 0, 0, 0, 9, "private_person", 0.9)])
    assert {x["doc_id"] for x in A.reconcile(s, r).collect()} == {1}


def test_defined_terms(spark):
    text = 'Zora Labs ("Client") hires Pedro Filho ("Pedro"). The Client pays Pedro. (each, an "Extra Part") (the “Role”)'
    r = typed(spark, text)
    at = lambda v: (text.index(v), text.index(v) + len(v))
    s = spans_of(spark, [(1, 0, 0, *at("Pedro Filho"), "private_person", 0.9), (1, 0, 0, *at("The Client"), "private_person", 0.9)])
    assert {x["term"] for x in A.defined_terms(s, r).collect()} == {"client", "extra part", "role"}
    assert {x["at"] for x in A.definitions(r).collect()} == {i for i, c in enumerate(text) if c == "("}
    kept = {text[x["start"] : x["end"]] for x in A.reconcile(s, r).collect()}
    assert kept == {"Pedro Filho"}


def test_scan_values_are_one_decision(spark):
    r = readings(spark, [(1, 0, 0, True, 3, "Ana Souza x Ana-Souza"), (1, 0, 1, True, 3, "Ána Souza")])
    s = spans_of(spark, [(1, 0, 0, 0, 9, "private_person", 0.7), (1, 0, 0, 12, 21, "private_person", 0.8), (1, 0, 1, 0, 9, "private_person", 0.9), (1, 0, 1, 0, 9, "private_person", 0.6)])
    marks = A.marks(s, r)
    assert marks.count() == 3 and {x["detection_id"] for x in marks.collect()} == {"3:private_person:anasouza"}
    d = A.detections(marks).collect()
    assert len(d) == 1 and d[0]["score"] == 0.9 and d[0]["page"] == 3
    kept = A.kept(marks, A.default_decisions(A.detections(marks)))
    assert A.redaction_counts(kept, r).first()["redaction_count"] == 2


def test_review_and_decisions(spark):
    r = typed(spark, "Ana Bob")
    s = spans_of(spark, [(1, 0, 0, 0, 3, "private_person", 0.9), (1, 0, 0, 4, 7, "private_person", 0.3)])
    found = A.detections(A.marks(s, r))
    assert [x["bucket"] for x in A.review_list(found).orderBy("place").collect()] == ["suggestion", "certain"]
    assert A.default_decisions(found).count() == 1


@pytest.mark.parametrize(
    ("kind", "text", "want", "count"),
    [
        ("text", "mail a@b.co, A@B.CO\r\nbye", "mail ██████, ██████\r\nbye", 2),
        ("csv", "name,email\n\"Ana, B\",a@b.co\n", "name,email\n\"██████\",██████\n", 2),
        ("json", '{"name":"Ana","n":[1e5]}', '{"name":"███","n":[1e5]}', 1),
        ("text", "", "", 0),
        ("text", None, "", 0),
    ],
)
def test_redact(spark, kind, text, want, count):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = R.redact(docs, kind=kind).first()
    assert (r["text"], r["redaction_count"]) == (want, count)
    assert r["warnings"] == ([] if text else ["warning.noText"])
    assert tuple(R.redact_long(docs, kind=kind).first()) == tuple(r)


def test_one_pass_and_long_form_agree(spark):
    texts = ['Zora ("Client") met Ana Souza ("Ana") a@b.co. The Client and ana  SOUZA, Ana.', "Bo a@b.co x@y.zz\r\nA@B.CO", "(the “a@b.co”) a@b.co", "", None, '+1 (212) 555-0199 "x"', "Ana Souza🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = dictionary({"Ana Souza": ("private_person", 0.9), "Client": ("private_person", 0.8), "Souza": ("private_person", 0.95), "Bo": ("secret", 0.3)})
    find = lambda text: model(text) + find_patterns(text)
    one = {tuple(map(str, r)) for r in R.redact(docs, find).collect()}
    assert one == {tuple(map(str, r)) for r in R.redact_long(docs, find).collect()}


def test_review_then_apply(spark):
    docs = spark.createDataFrame([(1, "a@b.co and +1 (212) 555-0199")], "doc_id long, text string")
    a = R.analyse(docs)
    only = a.detections.where("label = 'private_phone'").select("doc_id", "detection_id")
    r = R.apply(a, only).first()
    assert r["text"].startswith("a@b.co and █") and r["redaction_count"] == 1 and r["warnings"] == ["warning.notFullyRedacted"]


def test_files_fail_alone(spark):
    files = spark.createDataFrame([(1, "a.txt", "text", "x a@b.co"), (2, "b.csv", "csv", "email\nfoo"), (3, "c.exe", None, "?")], "doc_id long, name string, format string, text string")
    got = {r["name"]: (r["text"], r["error_key"]) for r in R.redact_files(files).collect()}
    assert got == {"a.txt": ("x ██████", None), "b.csv": ("email\n███", None), "c.exe": (None, "failure.unsupported")}
    assert find_patterns("x") == []
