import pytest

from veilspan.operators import fields as X


def seen(find, text):
    return [(text[s:e], label) for s, e, label, _ in find(text)]


@pytest.mark.parametrize(("name", "label"), [("E-mail", "private_email"), ("Télefono", "private_phone"), ("data de nascimento", "private_date"), ("date", None), ("CPF", "account_number"), ("", None)])
def test_labels(name, label):
    assert X.label_of(name) == label


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("name,email\nAna, a@b.co \n", [("Ana", "private_person"), ("a@b.co", "private_email")]),
        ('nome;cpf\n"Ana; Maria";1', [("Ana; Maria", "private_person"), ("1", "account_number")]),
        ('name\n"say ""hi"""\n', [('say ""hi""', "private_person")]),
        ("name\temail\n\tx@y.zz", [("x@y.zz", "private_email")]),
        ('name,note\n"two\nlines",x\n', [("two\nlines", "private_person")]),
        ('name\nAna\nB"ob\nCarl', [("Ana", "private_person")]),
        ("", []),
        ("a,b\n1,2", []),
    ],
)
def test_csv(text, want):
    assert seen(X.csv_spans, text) == want


def test_csv_body():
    assert X.csv_body("email,name\na@b.co,Ana") == "a@b.co,Ana" and X.csv_body("") == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"name": "Ana", "phone": 123, "tags": ["x"]}', [("Ana", "private_person"), ("123", "private_phone")]),
        ('{"na\\u006de": "Ana"}', [("Ana", "private_person")]),
        ('{"email": ["a@b.co"]}', []),
        ('{"email": null, "x": "y"}', []),
        ('{"name": ""}', []),
        ('{"name": "Ana"} x', []),
        ('{"name": NaN}', []),
        ('{"a": {"password" : "p\\"q"}}', [('p\\"q', "secret")]),
    ],
)
def test_json(text, want):
    assert seen(X.json_spans, text) == want


def test_lookup_join(spark):
    rows = spark.createDataFrame([("Endereço",), ("nope",)], "name string")
    assert {r["name"]: r["label"] for r in X.labelled_fields(rows).collect()} == {"Endereço": "private_address", "nope": None}
