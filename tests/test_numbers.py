from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tidemark.functions.images import format_value
from tidemark.functions.numbers import canonical_numbers
from tidemark.operators.diff import field_diff


def canonical(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r[0] for r in frame.orderBy("n").select(canonical_numbers(F.col("text"))).collect()]


def test_one_form_per_value(spark):
    cases = {
        "1e2": "100", "100.0": "100", "1.0E2": "100", "[1e2,{\"a\":-1.50}]": "[100,{\"a\":-1.5}]",
        "1e-7": "1e-7", "0.0000001": "1e-7", "0.000001": "0.000001", "1E-6": "0.000001", "-0.0": "0", "0e9": "0", "-0": "0",
        "1e25": "1e+25", "1" + "0" * 25: "1e+25", "1e20": "1" + "0" * 20, "1" + "0" * 21: "1e+21", "1e21": "1e+21",
        "12345678901234567890123": "1.2345678901234567890123e+22", "123.4500": "123.45", "1.25e1": "12.5", "-2.5e-10": "-2.5e-10",
        '"1e2"': '"1e2"', '{"k 1.0":"a \\" 2.0","b":[ 3.0 , true,null]}': '{"k 1.0":"a \\" 2.0","b":[ 3 , true,null]}',
        "": "", "17": "17",
    }
    assert canonical(spark, cases) == list(cases.values())
    assert canonical(spark, [None]) == [None]


def test_values_are_kept(spark):
    random.seed(4)
    texts = [f"{random.choice(['', '-'])}{random.randrange(10**random.randint(1, 12))}"
             + random.choice(["", f".{random.randrange(10**6)}"]) + random.choice(["", f"e{random.randint(-30, 30)}", f"E+{random.randint(0, 9)}"])
             for _ in range(300)]
    found = canonical(spark, texts)
    from decimal import Decimal

    assert [Decimal(f) for f in found] == [Decimal(t) for t in texts]
    again = canonical(spark, found)
    assert again == found


def test_long_strings_need_no_stack(spark):
    text = json.dumps({"a": 'x\\"' * 100_000, "b": 1.0})
    assert canonical(spark, [text]) == [text.replace("1.0}", "1}")]


def test_equal_numbers_are_no_change(spark, make_log):
    log = make_log(
        ("t", 0, {"old_values": '{"a":[1e2],"b":1e-7,"c":1e25,"d":{"x":[0.10]},"e":1}',
                  "new_values": '{"a":[100],"b":0.0000001,"c":10000000000000000000000000,"d":{"x":[1e-1]},"e":1.5e0}'}),
    )
    assert [tuple(r) for r in field_diff(log).select("field", "old_value", "new_value").collect()] == [("e", "1", "1.5")]
    values = log.select(F.from_json("old_values", "map<string,variant>").alias("m"))
    shown = values.select(*[format_value(F.col("m")[k]) for k in "abcd"]).first()
    assert tuple(shown) == ("[100]", "1e-7", "1e+25", '{"x":[0.1]}')
