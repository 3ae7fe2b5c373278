from pyspark.sql import functions as F

from palimpsest.operators import serving


def test_verdicts(spark):
    said = [
        ('{"verdict": "correct", "reason": "same"}', "correct", "same"),
        (' ```JSON\n{"verdict": "partial", "reason": "' + "r" * 300 + '"}\n``` ', "partial", "r" * 200),
        ('{"verdict": "incorrect"}', "incorrect", ""),
        ('{"verdict": "incorrect", "reason": 7}', "incorrect", ""),
        ('{"verdict": "Correct"}', "unparsed", 'judge did not return valid JSON: {"verdict": "Correct"}'),
        ('["correct"]', "unparsed", 'judge did not return valid JSON: ["correct"]'),
        ("x" * 500, "unparsed", "judge did not return valid JSON: " + "x" * 150),
        ("", "unparsed", "judge did not return valid JSON: "),
        (None, "unparsed", "judge did not return valid JSON: "),
    ]
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(said)], "i int, raw string")
    got = df.select("i", serving.judge_verdict(F.col("raw")).alias("v")).orderBy("i").collect()
    assert [(r.v.verdict, r.v.reason) for r in got] == [s[1:] for s in said]


def test_grades_without_gold(spark):
    df = spark.createDataFrame([(False, "abstained", None), (False, "answered", None), (False, "partial", None), (True, "answered", "partial")], "a boolean, c string, j string")
    assert [r.g for r in df.select(serving.graded(F.col("a"), F.col("c"), F.col("j")).alias("g")).collect()] == ["correct", "incorrect", "partial", "partial"]
