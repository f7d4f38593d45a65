import zipfile

import pytest

from veilspan.sources import archive, corpus, formats
from veilspan.streaming.redact import redact_batches, redact_rows


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a.txt": "mail a@b.co", "sub/b.CSV": "email\nx@y.zz\n", "c.bin": "?", "d.json": '{"name": "Ana"}'}.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return tmp_path / "in"


def test_read_files(spark, folder):
    known, dead = formats.read_files(spark, str(folder))
    assert {(r["name"], r["format"]) for r in known.collect()} == {("a.txt", "text"), ("b.CSV", "csv"), ("d.json", "json")}
    assert [tuple(r)[1:] for r in dead.collect()] == [("c.bin", "failure.unsupported")]
    known, _ = formats.read_files(spark, str(folder), 2)
    assert known.count() == 2 and known.first()["limited"]
    assert formats.read_texts(spark, str(folder)).where("format = 'csv'").first()["text"] == "email\nx@y.zz\n"
    assert formats.accept_list().startswith(".csv,text/csv") and ".heic" not in formats.node_types()


def test_names(spark):
    assert archive.archive_names(["a.txt", "/a.txt", "..\\b", "", "b (2)", "b", "b", ".x"]) == ["a.txt", "a (2).txt", "b", "file", "b (2)", "b (3)", "b (4)", ".x"]
    rows = spark.createDataFrame([(1, "x/a.txt"), (2, "x//a.txt"), (3, ".x"), (4, "../.x"), (5, "..")], "n int, name string")
    assert [r["entry"] for r in archive.numbered_names(rows, "n").orderBy("n").collect()] == ["x/a.txt", "x/a (2).txt", ".x", ".x (2)", "file"]


def test_numbered_names_as_one_by_one(spark):
    names = ["a.txt", "a (2).txt", "a.txt", "a.txt", "a (2).txt", "a (2) (2).txt", "b", "b", "c (2)", "c", ".x (2)", ".x", ".x", "", "file", "d.e/f", "d.e/f"]
    rows = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    got = [r["entry"] for r in archive.numbered_names(rows, "n").orderBy("n").collect()]
    assert got == archive.archive_names(names) and len(set(got)) == len(got)
    assert archive.numbered_names(spark.createDataFrame([], "n int, name string"), "n").count() == 0
    paths = spark.createDataFrame([("in/sub/x.heic", "x.png"), ("y", "y"), (None, "z")], "path string, name string")
    assert [r[0] for r in paths.select(archive.path_entry(paths["path"], paths["name"])).collect()] == ["in/sub/x.png", "y", None]


def test_zip(tmp_path):
    path = str(tmp_path / "out.zip")
    assert archive.write_zip(path, [("a", b"1"), ("a", b"2")]) == path
    again = archive.write_zip(path, [("b", b"3")])
    assert again.endswith("out (2).zip") and zipfile.ZipFile(path).namelist() == ["a", "a (2)"]
    with pytest.raises(ValueError):
        archive.build_zip([])


def test_corpus(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"id": "one", "language": "en", "source": "synthetic", "marked": "To [[private_person|Ana]]: [[secret|x y]]."}')
    row = corpus.load(spark, str(tmp_path)).first()
    assert row["text"] == "To Ana: x y." and [tuple(s) for s in row["spans"]] == [(3, 6, "private_person"), (8, 11, "secret")] and row["format"] == "text"
    assert corpus.gold_spans(corpus.load(spark, str(tmp_path))).count() == 2
    (tmp_path / "2.json").write_text('{"id": "one", "language": "en", "source": "synthetic", "marked": "x"}')
    with pytest.raises(ValueError, match="one"):
        corpus.load(spark, str(tmp_path))
    for bad in ("[[nope|x]]", "[[secret|]]"):
        with pytest.raises(Exception, match="marked span"):
            corpus.parse_marked(spark.createDataFrame([("i", bad)], "id string, marked string")).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "to a@b.co"), (2, None)], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    q = redact_rows(stream).writeStream.format("memory").queryName("rows").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM rows").collect()} == {(1, "to ██████", 1), (2, None, 0)}
    out = str(tmp_path / "out")
    q = redact_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{out}/0").collect()} == {(1, "to ██████"), (2, "")}


def test_model_files(spark):
    from veilspan.sources import models

    m = spark.createDataFrame([("a", "r/x", "v1", "m.onnx"), ("b", "r/x", "v1", "n.onnx")], "id string, repo string, revision string, file string")
    urls = models.file_urls(m, "https://hub.example/")
    assert urls.count() == 6 and [r[0] for r in models.owned_urls(urls, "a").collect()] == ["https://hub.example/r/x/resolve/v1/onnx/m.onnx"]
    kept = spark.createDataFrame([("https://hub.example/r/x/resolve/v1/onnx/m.onnx", 10), ("https://old", 3)], "url string, size long")
    assert [r["url"] for r in models.stale(kept, urls).collect()] == ["https://old"]
    assert {r["id"]: r["status"] for r in models.status(urls, kept).collect()} == {"a": "partial", "b": "absent"}
    files = spark.createDataFrame([("u", 25), ("v", 0)], "url string, total long")
    held = spark.createDataFrame([("u", 10)], "url string, start long")
    assert sorted(tuple(r) for r in models.missing(files, held, 10).collect()) == [("u", 0, 10), ("u", 20, 5)]
    assert [tuple(r) for r in models.banked(files, held, 10).collect()] == [("u", 10)]
    name = kept.select(models.kept_name(kept["url"])).first()[0]
    assert name.endswith("-m.onnx") and len(name) == 16 + 7


def test_command(spark, folder, tmp_path):
    from veilspan.__main__ import main

    (folder / "sub" / "a.txt").write_text("again c@d.co")
    (folder / "e.pdf").write_bytes(b"%PDF")
    out = tmp_path / "res"
    for _ in range(2):
        total = main([str(folder), str(tmp_path / "nowhere"), str(out), "--zip"])
        assert total["file_count"] == 4 and total["redaction_count"] == 4 and total["failures"] == 2
        files = {p.name: p.read_text() for p in (out / "files").iterdir() if p.suffix != ".crc"}
        assert files == {"a.txt": "mail ██████", "a (2).txt": "again ██████", "b.CSV": "email\n██████\n", "d.json": '{"name": "███"}'}
    assert sorted(zipfile.ZipFile(out / "redacted.zip").namelist()) == sorted(files) and (out / "redacted (2).zip").exists()
    assert main(["models"])[0][1] in ("span", "token")
    with pytest.raises(SystemExit):
        main([str(tmp_path / "nowhere"), str(out)])


def test_evaluation_run(spark, tmp_path):
    from veilspan.plans import evaluation

    (tmp_path / "1.json").write_text('{"id": "one", "language": "en", "source": "synthetic", "marked": "To [[private_email|a@b.co]], [[private_person|Ana]]."}')
    (tmp_path / "2.json").write_text('{"id": "two", "language": "pt", "source": "synthetic", "marked": "nada"}')
    docs = corpus.load(spark, str(tmp_path))
    done = evaluation.run(docs)
    scores = {(r["table"], r["name"]): (r["true_positive"], r["false_positive"], r["false_negative"]) for r in done.scores().collect()}
    assert all(scores[t, "TOTAL"] == (1, 0, 1) for t in evaluation.TABLES if t != "by_language") and scores["by_language", "en"] == (1, 0, 1)
    assert {r["id"]: len(r["predicted"]) for r in done.predicted.collect()} == {"one": 1, "two": 0}
    assert done.report().count("TOTAL") == 5
    assert evaluation.run(docs, chosen="on").predicted.count() == 1
    assert evaluation.run(docs, floor=1.1).predicted.where("size(predicted) > 0").count() == 0
    with pytest.raises(ValueError, match="nobody"):
        evaluation.run(docs, chosen="nobody")


def test_trimmed_vocabulary(spark):
    from veilspan.sources import models

    own = spark.createDataFrame([("▁a", 0), ("né", 1), ("日", 2), ("я", 3), ("", 4), ("x\n", 5)], "piece string, old int")
    protected = spark.createDataFrame([("я",)], "piece string")
    assert {r["old"] for r in models.trimmed(own, protected).collect()} == {0, 1, 3, 4, 5}


def test_words_that_a_font_lacks(spark):
    from veilspan.operators import geometry

    rows = spark.createDataFrame([(1, "né €"), (2, "日本"), (2, "я"), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in geometry.dropped_characters(rows).collect()] == [(2, "warning.droppedCharacters")]


def test_failures_are_isolated(spark):
    from veilspan.plans.redact import redact

    def find(text):
        if "boom" in text:
            raise ValueError("boom")
        return []

    rows = spark.createDataFrame([(1, "fine"), (2, "boom")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["warnings"]) for r in redact(rows, find, isolate=True).collect()}
    assert got == {1: ("fine", []), 2: (None, ["failure: ValueError: boom"])}
    with pytest.raises(Exception, match="boom"):
        redact(rows, find).collect()

    def gone(text):
        from veilspan.plans.redact import RedactionFailure

        raise RedactionFailure("failure.modelGone", "no weights")

    assert {r["warnings"][0] for r in redact(rows, gone, isolate=True).collect()} == {"failure.modelGone"}


def test_public_names():
    import veilspan

    for name in veilspan.__all__:
        assert getattr(veilspan, name) is not None
    with pytest.raises(AttributeError):
        veilspan.nothing


def test_scores_by_language(spark):
    from veilspan.operators import evaluate

    gold = spark.createDataFrame([(1, 0, 5, "a"), (1, 9, 12, "a"), (2, 0, 4, "b")], "doc_id long, start int, end int, label string")
    found = spark.createDataFrame([(1, 1, 4, "a", 1.0), (1, 3, 6, "a", 1.0), (2, 8, 9, "b", 1.0)], "doc_id long, start int, end int, label string, score double")
    docs = spark.createDataFrame([(1, "en"), (2, "pt"), (3, "es")], "doc_id long, language string")
    counts = evaluate.counts(gold, found)
    got = {r["language"]: (r["true_positive"], r["false_positive"], r["false_negative"]) for r in evaluate.by_language(counts, docs).collect()}
    assert got == {"en": (1, 0, 1), "pt": (0, 1, 1)}
    exact = {r["label"]: r["true_positive"] for r in evaluate.counts(gold, gold.selectExpr("*", "1.0 AS score"), exact=True).collect()}
    assert exact == {"a": 2, "b": 1}


def test_offsets_in_one_pass(spark):
    from pyspark.sql import functions as F

    from veilspan.functions.text import offsets

    rows = spark.createDataFrame([(["ab", "", "🙂c"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in rows.select(offsets(F.col("p"), 1)).collect()] == [[0, 3, 4, 7], [0], None]


def test_analysis_gives_its_storage_back(spark):
    from veilspan.plans import redact as R

    a = R.analyse(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"))
    assert a.marks.count() == 1 and a.marks.is_cached
    a.release()
    assert not a.marks.is_cached
