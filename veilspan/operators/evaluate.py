"""Accuracy against labelled spans: merged predictions, one-to-one pairs by overlap, counts and F1 by any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.spans import overlap


def pairs(gold: DataFrame, predicted: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, label, g, p): candidates by overlap, then in order, each side taken once. One array a document and label."""
    g = gold.select("doc_id", "label", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = predicted.select("doc_id", "label", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    size = overlap(F.col("g_start"), F.col("g_end"), F.col("p_start"), F.col("p_end"))
    met = g.join(p, ["doc_id", "label"]).withColumn("overlap", size).where("overlap > 0")
    if exact:
        met = met.where("g_start = p_start and g_end = p_end")
    item = F.struct((-F.col("overlap")).alias("rank"), "g_start", "g_end", "p_start", "p_end")
    rows = met.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(item)).alias("__all"))
    none = F.filter("__all", lambda x: F.lit(False))
    clash = lambda x, y: ((x["g_start"] == y["g_start"]) & (x["g_end"] == y["g_end"])) | ((x["p_start"] == y["p_start"]) & (x["p_end"] == y["p_end"]))
    taken = F.aggregate("__all", none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("doc_id", "label", F.explode(taken).alias("m")).select("doc_id", "label", "m.g_start", "m.g_end", "m.p_start", "m.p_end")


def counts(gold: DataFrame, predicted: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, label, true_positive, false_positive, false_negative) of each document and label that has any. Both sides meet
    in one exchange; what merges, pairs and counts them works on the arrays of a document and label."""
    side = lambda df, n: df.select("doc_id", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(n).alias("side"))
    own = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("start", "end"))))
    rows = side(gold, 0).unionByName(side(predicted, 1)).groupBy("doc_id", "label").agg(own(0).alias("g"), own(1).alias("p"))

    def merged(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    rows = rows.withColumn("p", F.aggregate("p", F.filter("p", lambda x: F.lit(False)), merged))

    def met(g: Column, p: Column) -> Column:
        return (g["start"] == p["start"]) & (g["end"] == p["end"]) if exact else overlap(g["start"], g["end"], p["start"], p["end"]) > 0

    item = lambda g, p: F.struct((-overlap(g["start"], g["end"], p["start"], p["end"])).alias("rank"), g.alias("g"), p.alias("p"))
    every = F.array_sort(F.flatten(F.transform("g", lambda g: F.transform(F.filter("p", lambda p: met(g, p)), lambda p: item(g, p)))))
    rows = rows.withColumn("__all", every)
    clash = lambda x, y: (x["g"] == y["g"]) | (x["p"] == y["p"])
    taken = F.aggregate("__all", F.filter("__all", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    rows = rows.withColumn("true_positive", F.size(taken).cast("long"))
    return rows.select("doc_id", "label", "true_positive", (F.size("p") - F.col("true_positive")).alias("false_positive"), (F.size("g") - F.col("true_positive")).alias("false_negative"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def scored(counts_: DataFrame) -> DataFrame:
    """Counts with precision, recall and F1."""
    tp = F.col("true_positive")
    out = counts_.withColumn("precision", ratio(tp, tp + F.col("false_positive"))).withColumn("recall", ratio(tp, tp + F.col("false_negative")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def by_label(counts_: DataFrame) -> DataFrame:
    """A row for each label and one, TOTAL, for all."""
    sums = counts_.rollup("label").agg(*(F.sum(c).alias(c) for c in ("true_positive", "false_positive", "false_negative")))
    return scored(sums.withColumn("label", F.coalesce("label", F.lit("TOTAL"))))


def by_language(counts_: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each language of ``docs`` (doc_id, language); documents without counts have none."""
    sums = counts_.join(docs.select("doc_id", "language"), "doc_id").groupBy("language").agg(*(F.sum(c).alias(c) for c in ("true_positive", "false_positive", "false_negative")))
    return scored(sums)


def report(scores: DataFrame, title: str = "", name: str = "label") -> str:
    """A table of percentages with one decimal, for people."""
    rows = sorted((r.asDict() for r in scores.collect()), key=lambda r: (r[name] == "TOTAL", r[name]))
    lines = [*([title] if title else []), f"{name:<18}{'P':>7}{'R':>7}{'F1':>7}{'tp/fp/fn':>14}"]
    for r in rows:
        lines.append(f"{r[name]:<18}" + "".join(f"{100 * r[c]:>7.1f}" for c in ("precision", "recall", "f1")) + f"{r['true_positive']:>8}/{r['false_positive']}/{r['false_negative']}")
    return "\n".join(lines)
