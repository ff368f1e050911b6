import pytest
from pyspark.sql import functions as F

from terragrain.functions import pathquery, predicates

LINES = [
    '{"type":"Feature","id":7,"geometry":{"type":"Point","coordinates":[12.5,-33.25]},"properties":{"Accuracy":8.25,"Activity":"Resting","Name":"otter4","Speed":0,"On":true,"No":null,"Text":"9"}}',
    '{"type":"Feature","id":8,"geometry":{"type":"Point","coordinates":[13.5,-34.75]},"properties":{"Accuracy":240.5,"Activity":"Rowing","Name":"otter4","Speed":3}',
    '[{"properties":{"Accuracy":500}},{"properties":{"Accuracy":5}}]',
    "not json",
]


def which(spark, column):
    df = spark.createDataFrame(list(enumerate(LINES)), "k int, value string")
    return [r.k for r in df.where(column(F.col("value"))).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("query", "lines"),
    [
        ("#[properties.Accuracy<100]", [0, 2]),
        ('#[properties.Activity="Rowing"]', [1]),
        ("#(properties.Accuracy<100)", [0, 2]),
        ('#(properties.Activity="Rowing")', [1]),
        ('#(properties.Activity!="Rowing")', [0]),
        ("#(properties.Missing!=1)", []),
        ("#(properties.Name)", [0, 1]),
        ('#(properties.Name%"ot*")', [0, 1]),
        ('#(properties.Name!%"ot?er4")', []),
        ('#(properties.Text<"10")', []),
        ('#(properties.Text>"10")', [0]),
        ("#(properties.On=true)", [0]),
        ("#(properties.On!=true)", []),
        ("#(properties.No=null)", []),
        ("#(properties.Accuracy>=240.5)", [1, 2]),
        ("#(properties.On=~true)", [0]),
        ("#(nothing)#", [0, 1, 2, 3]),
    ],
)
def test_path_queries(spark, query, lines):
    assert which(spark, lambda v: pathquery.matches(v, query)) == lines


def test_escapes_elements_and_lengths(spark):
    line = '{"a.b":{"it\'s":[5,"x",{"y":true}]},"c d":0,"e<f":2}'
    df = spark.createDataFrame([(line,)], "value string")
    yes = ['#(a\\.b.it\'s.0=5)', '#(a\\.b.it\'s.2.y=true)', "#(a\\.b.it's.#=3)", "#(a\\.b.it's.#>2)", "#(c\\ d=0)", "#(e\\<f=2)", "#(a\\.b.it's.#)"]
    no = ["#(a.b=5)", "#(a\\.b.it's.#<3)", "#(a\\.b.#)", "#(a\\.b.it's.9)", "#(nothing.#)"]
    for query in yes + no:
        assert df.where(pathquery.matches(F.col("value"), query)).count() == (query in yes), query


def test_patterns_of_keys_and_queries_inside_queries(spark):
    line = '{"zeta":{"n":1},"zebra":{"n":2},"*":9,"friends":[{"first":"Ada","age":44,"nets":["x","y"]},{"first":"Bo","age":68,"nets":["y","z)"]},{"first":"Cy","age":47,"nets":[]}],"deep":{"b1":{"c":[{"k":[1,2]},{"k":[3]}]}},"tags":["p",5,true]}'
    df = spark.createDataFrame([(line,), (f"[{line}]",), (line[:-1],)], "value string")
    yes = [
        "#(z*.n=1)", "#(ze?ra.n=2)", "#(fri*.#=3)", "#(z*)", "#(\\*=9)", "#(*.n=1)", "#(de*.b?.c.1.k.0=3)", "#(f*.1.f*t=\"Bo\")", "#(?)",
        '#(friends.#(first="Bo").age=68)', '#(friends.#(age>45).first="Bo")', "#(friends.#(age>45)#.#=2)", '#(friends.#(nets.#(="z)")).age=68)', "#(friends.#(nets.#=0).age==47)", "#(deep.*.c.#(k.#(=3)).k.#=1)",
        '#(tags.#(="p"))', '#(tags.#(>4)="p")', "#(tags.#(=5)=5)", "#[friends.#[age<45].first%A*]", "#(friends.#(age>99)#.#=0)", "#(friends.#(age>99)#)",
    ]
    no = ["#(z*.n=2)", "#(q*)", "#(friends.#(age>99))", '#(friends.#(first="Bo").age=44)', "#(zeta.#(n=1))", "#(friends.#(nets.#(=\"w\")).age>0)", "#(??)", "#(tags.#(=7))"]
    for query in yes + no:
        assert df.where(pathquery.matches(F.col("value"), query)).count() == 3 * (query in yes), query


def test_clauses(spark):
    under, running = "#(properties.Accuracy<100)", '#(properties.Activity="Rowing")'
    assert which(spark, lambda v: pathquery.match_all(v, [under])) == [0, 2]
    assert which(spark, lambda v: pathquery.match_all(v, [])) == [0, 1, 2, 3]
    assert which(spark, lambda v: pathquery.match_any(v, [under, running])) == [0, 1, 2]
    assert which(spark, lambda v: pathquery.match_any(v, [])) == [0, 1, 2, 3]
    assert which(spark, lambda v: pathquery.match_none(v, [under, "#(properties.Missing=1)"])) == [1, 3]
    assert which(spark, lambda v: pathquery.rejection(v, [under], [], []) == "match-all") == [1, 3]


def test_reading_queries():
    assert pathquery.split_queries("") == [] and pathquery.split_queries("a,b") == ["a", "b"]
    with pytest.raises(ValueError):
        pathquery.parse("properties.Accuracy<100")


def test_predicates(spark):
    df = spark.createDataFrame([(0.0,), (99.9,), (100.0,), (-1.0,)], "a double")
    assert [r.a for r in df.where(predicates.passes_accuracy(F.col("a"), 100)).collect()] == [99.9]
    assert df.where(predicates.passes_accuracy(F.col("a"), -1)).count() == 4
    names = spark.createDataFrame([("",), ("Unknown",), ("unknown",)], "a string")
    assert [r.a for r in names.where(predicates.valid_activity(F.col("a"))).collect()] == ["unknown"]
    assert names.where(predicates.valid_activity(F.col("a"), require=False)).count() == 3
    fips = spark.createDataFrame([("1",), ("48",), ("480",)], "f string").select(predicates.pad_fips(F.col("f")).alias("f"))
    assert [r.f for r in fips.collect()] == ["01", "48", "480"]
    texts = spark.createDataFrame([("1e2",), (" 5 ",), ("1d",), ("1.5f",), ("inf",), ("0x10",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(predicates.lenient_double(F.col("t"))).collect()] == [100.0, 5.0, None, None, None, None, None, None]
