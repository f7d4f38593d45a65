"""Patterns, checks and the two ways of extraction."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checks
from veilspan.functions import patterns as P
from veilspan.operators.extract import absorb, dictionary, find_patterns, native_places, native_spans, pattern_spans, spread, tighten, with_patterns

VALID = {"cpf": ["529.982.247-25", "52998224725"], "cnpj": ["11.222.333/0001-81"], "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], "dni": ["12345678Z", "X1234567L"], "card": ["4111 1111 1111 1111", "4012-8888-8888-1881"]}
INVALID = {"cpf": ["529.982.247-24", "111.111.111-11", "123"], "cnpj": ["11.222.333/0001-80", "00000000000000"], "iban": ["GB83 WEST 1234 5698 7654 32"], "dni": ["12345678A", "1234567"], "card": ["4111 1111 1111 1112", "411111111111"]}


@pytest.mark.parametrize("kind", VALID)
def test_checks(spark, kind):
    column = {"cpf": checks.is_cpf, "cnpj": checks.is_cnpj, "iban": checks.is_iban, "dni": checks.is_dni, "card": checks.is_card}[kind]
    for values, want in ((VALID[kind], True), (INVALID[kind], False)):
        assert [getattr(checks, kind)(v) for v in values] == [want] * len(values)
        rows = spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()
        assert [r[0] for r in rows] == [want] * len(values)


def covered(text):
    return [(text[s:e], label) for s, e, label, _ in find_patterns(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to ana.souza+x@exemplo.com.br now", [("ana.souza+x@exemplo.com.br", "private_email")]),
        ("CPF 529.982.247-25.", [("529.982.247-25", "account_number")]),
        ("CPF 529.982.247-24.", []),
        ("RG: 12.345.678-X e CNH 12345678901", [("12.345.678-X", "account_number"), ("12345678901", "account_number")]),
        ("CEP 01310-100", [("01310-100", "private_address")]),
        ("mora na Rua das Flores, nº 123, centro", [("Rua das Flores, nº 123", "private_address")]),
        ("em 05/11/2023 e 31/13/2023", [("05/11/2023", "private_date")]),
        ("14 de março de 2024 or April 2nd, 2024", [("14 de março de 2024", "private_date"), ("April 2nd, 2024", "private_date")]),
        ("call +55 11 91234-5678", [("+55 11 91234-5678", "private_phone")]),
        ("years 2019-2023 only", []),
        ("212-555-0199", [("212-555-0199", "private_phone")]),
        ("ç52998224725", [("52998224725", "account_number")]),
        ("", []),
    ],
)
def test_patterns(text, want):
    assert covered(text) == want


def test_both_ways_agree(spark):
    texts = [(1, "a@b.co and c.d@e.org"), (2, "card 4111 1111 1111 1111 or 4111111111111112"), (3, "+1 (212) 555-0199 212-555-0123"), (4, ""), (5, None), (6, "🙂 x@y.zz")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    native = {tuple(r) for r in native_spans(df, ["email", "card", "phone_a", "phone_b"]).select("doc_id", "start", "end", "label").collect()}
    arrow = {tuple(r) for r in pattern_spans(df).select("doc_id", "start", "end", "label").collect()}
    assert native >= arrow and (6, 2, 8, "private_email") in arrow
    rg = spark.createDataFrame([(1, "RG 12.345.678-9 and CEP: 01310-100")], "doc_id long, text string")
    assert [r["value"] for r in native_spans(rg, ["rg", "cep"]).orderBy("start").collect()] == ["12.345.678-9", "01310-100"]


def test_absorb_and_tighten():
    assert absorb([(0, 10, "a", 0.5), (2, 5, "a", 0.9), (3, 12, "a", 0.1), (2, 5, "b", 0.2)]) == [(0, 10, "a", 0.9), (2, 5, "b", 0.2), (3, 12, "a", 0.1)]
    text = "mail me: a@b.co today 7"
    assert tighten([(0, 15, "private_email", 0.8)], [(9, 15, "private_email", 1.0)], text) == [(9, 15, "private_email", 1.0)]
    assert len(tighten([(9, 23, "private_email", 0.8)], [(9, 15, "private_email", 1.0)], text)) == 2
    assert with_patterns(dictionary({"today": ("private_date", 0.7)}))(text) == [(16, 21, "private_date", 0.7), (9, 15, "private_email", 1.0)]


def _odd_texts(n, seed=7):
    r = random.Random(seed)
    bits = ["@", "a@b.co", "x@y", ".", ".com", "-", "9", "_", "%", " ", "\n", "\u00a0", "é", "ſ", "K", "\u0345", "529.982.247-25", "52998224725", "11.222.333/0001-81", "GB82WEST12345698765432", "12345678Z", "4111 1111 1111 1111", "+55 11 91234-5678", "(11) 1234-5678", "2019-2020", "RG: 1234567", "CNH 123456789", "CEP 12345-678", "Rua das Flores, 12", "01/02/2021", "2 de março de 2019", "march 3, 2020", "ſeptember 4", "b"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_outwards_is_the_pattern():
    email = P.by_id("email")
    rx, found = P.python(email), P.outwards(email)
    for text in _odd_texts(20_000):
        assert list(found(text)) == [m.span() for m in rx.finditer(text)], text


def test_native_places_are_the_matches(spark):
    texts = [t.replace("\u0345", "") or " " for t in _odd_texts(3_000, 8)]  # a mark that folds to a letter: one engine's letters hold it
    rows = native_places(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), [p.id for p in P.PATTERNS], keep=("doc_id",)).collect()
    assert len(rows) == len(texts)
    for p in P.PATTERNS:
        rx = P.python(p)
        for row in rows:
            want = [m.span(int(p.value)) for m in rx.finditer(texts[row["doc_id"]]) if p.verify is None or P.VERIFY[p.verify](m[int(p.value)])]
            assert [(s["start"], s["end"]) for s in row[p.id]] == want, (p.id, texts[row["doc_id"]])


def test_heavy_work_is_dealt_over_the_cores(spark, tmp_path):
    """A file of keys alone is one split; what is done with each key is heavy."""
    spark.range(5_000).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    keys = spark.read.parquet(str(tmp_path / "orders.parquet"))
    assert keys.rdd.getNumPartitions() == 1
    dealt = spread(keys, "o_orderkey")
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and dealt.distinct().count() == 5_000


def test_native_reads_its_texts_once(spark, tmp_path):
    from veilspan.plans import queries as Q

    spark.range(50).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    plan = Q.QUERIES["q51b_planted_by_pattern"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
