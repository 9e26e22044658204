"""Canonical JSON against Python's own, hash trees against each other."""

import json
import random

from pyspark.sql import functions as F

from tracemill.functions import canonical as K

KIND = "z struct<b:string,a:array<struct<y:double,x:map<string,bigint>>>>, s string, n int, f double, t boolean"


def test_against_python(spark):
    rnd = random.Random(4)
    pool = ["", "plain", 'q"uo\\te', "é", "😀x", "\x00\x1f\x7f", "tab\tnew\nline\r\f\b", " ", "Ünï"]
    numbers = [0.0, -0.0, 1.0, -2.5, 0.0001, 0.00001234, 1e15, 12345678.9, 1e16, 1.5e300, 2.5e-7, 123456789012.125, None]
    value = lambda: {
        "z": rnd.choice([None, {"b": rnd.choice(pool), "a": rnd.choice([None, [], [{"y": rnd.choice(numbers), "x": {rnd.choice(pool): rnd.randint(-5, 9) for _ in range(3)}}, None]])}]),
        "s": rnd.choice([*pool, None]), "n": rnd.choice([None, -7, 0]), "f": rnd.choice(numbers), "t": rnd.choice([True, False, None]),
    }
    rows = [value() for _ in range(150)] + [{"z": None, "s": p, "n": 1, "f": x, "t": True} for p, x in zip(pool * 2, numbers, strict=False)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, row struct<{', '.join(c.replace(' ', ':', 1) for c in KIND.split(', '))}>").select("k", "row.*")
    for comma, colon in ((",", ":"), (", ", ": ")):
        got = [r.c for r in df.withColumn("c", K.canonical_row(df, ["t", "f", "n", "s", "z"], comma, colon)).orderBy("k").collect()]
        assert got == [json.dumps(r, sort_keys=True, separators=(comma, colon)) for r in rows]


def test_other_kinds(spark):
    df = spark.sql("select cast(1.50 as decimal(9,3)) d, cast(20 as decimal(9,0)) w, date'2026-01-02' t, x'00ff' b, double('NaN') n, double('-Infinity') i")
    assert df.select(K.canonical_row(df, df.columns)).first()[0] == '{"b":"00ff","d":1.5,"i":-Infinity,"n":NaN,"t":"2026-01-02","w":20}'
    texts = spark.createDataFrame([('{"b": [1, {"d":null, "c":"é"}],  "a": true}',), ('{"a":true,"b":[1,{"c":"é","d":null}]}',), ("{broken",), (None,)], "j string")
    assert [r[0] for r in texts.select(K.canonical_text(F.col("j"))).collect()] == ['{"a":true,"b":[1,{"c":"é","d":null}]}'] * 2 + [None, None]


def test_hash_trees(spark):
    rows = [("g" if k % 2 else "h", k, f"row {k}") for k in range(400)]
    tree = lambda rs: K.hash_tree(spark.createDataFrame(rs, "g string, k int, c string").repartition(5), ["g"], "k", F.col("c"))
    roots = lambda t: {r.g: (r.n, r.digest) for r in t.filter("prefix = ''").collect()}
    one, shuffled = tree(rows), tree(rows[::-1])
    assert roots(one) == roots(shuffled) and K.tree_changes(one, shuffled, ["g"]).count() == 0
    swapped = [(g, k, {5: "row 7", 7: "row 5"}.get(k, c)) for g, k, c in rows]  # the same keys, contents and sums
    changed = K.tree_changes(one, tree(swapped), ["g"]).collect()
    assert {r.g for r in changed} == {"g"} and 1 <= len(changed) <= 2 and roots(one)["h"] == roots(tree(swapped))["h"]
    assert roots(one)["g"] != roots(tree([*rows, rows[1]]))["g"]
    assert tree(rows).filter("prefix = ''").count() == 2 and K.hash_tree(spark.createDataFrame([], "g string, k int, c string"), ["g"], "k", F.col("c")).count() == 0
