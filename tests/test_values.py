import gzip
import json
import random

import pytest

from terragrain.sources import features, values


def decode(text):
    """The values of a text, by Python's decoder."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out
        value, at = decoder.raw_decode(text, at)
        out.append(value)


def some_text(seed, n):
    pick = random.Random(seed)

    def value(depth):
        kind = pick.randint(0, 6 if depth else 3)
        if kind < 2 or depth > 4:
            return pick.choice(["plain", 'q"uote', "br{ace", "}", "]", "[", "\\", '\\"', "line\nend", "", 'a\\\\"{', 1, 2.5, None, True])
        if kind == 4:
            return [value(depth + 1) for _ in range(pick.randint(0, 3))]
        return {pick.choice("abcdef") + pick.choice(['"', "{", "", "\\"]): value(depth + 1) for _ in range(pick.randint(0, 4))}

    def whole():
        v = value(0)
        return v if isinstance(v, (dict, list)) else {"v": v}

    out = []
    for _ in range(n):
        out.append(json.dumps(whole(), indent=pick.choice([None, None, 1])))
        out.append(pick.choice(["", "", "\n", " ", "\r\n", "\n\n\t"]))
    return "".join(out)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("size", "few"), [(1 << 20, 100), (700, 100), (61, 1000), (700, 0)])
def test_values_equal_the_decoders_at_any_split_size(spark, tmp_path, small_splits, monkeypatch, size, few):
    monkeypatch.setattr(values, "FEW_BLOCKS", few)
    texts = {name: some_text(k, n) for k, (name, n) in enumerate([("c", 30), ("a", 50), ("b", 1), ("e", 0), ("d", 40 if size > 100 else 5)])}
    texts["f"] = json.dumps({"long": ["x{}" * 300, {"y": '"' * 200}]})
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    small_splits(size)
    got = [json.loads(r.value) for r in values.read_values(spark, str(tmp_path)).orderBy("_at").collect()]
    assert got == [v for name in sorted(texts) for v in decode(texts[name])]


def test_compressed_files_and_one_without_line_ends(spark, tmp_path, small_splits):
    text = some_text(7, 60).replace("\n", " ").replace("\r", " ")
    (tmp_path / "a.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b").write_text(text)
    small_splits(500)
    got = [json.loads(r.value) for r in values.read_values(spark, str(tmp_path)).orderBy("_at").collect()]
    assert got == decode(text) * 2


def test_what_is_no_value_or_incomplete(spark, tmp_path):
    good = '{"type":"Feature","id":%d,"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"Name":"a"}}'
    for name, text, ids in (("cut", good % 1 + '{"type":"Feature","id":2,"geometry"', [1]), ("between", good % 1 + " nonsense " + good % 2, [1, 2]), ("number", "7" + good % 3, [3])):
        (tmp_path / name).write_text(text)
        lenient = features.read_features(spark, str(tmp_path / name), strict=False, anywhere=True).where("geometry IS NOT NULL").collect()
        assert sorted(r["id"] for r in lenient) == ids
        with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
            features.read_features(spark, str(tmp_path / name), anywhere=True).collect()
    (tmp_path / "none").write_text(" \n ")
    assert features.read_features(spark, str(tmp_path / "none"), anywhere=True).count() == 0
    for name, text in (("lines", "\n".join(good % k for k in range(4))), ("one", "".join(good % k for k in range(4))), ("spread", "\n".join(json.dumps(json.loads(good % k), indent=2) for k in range(4)))):
        (tmp_path / name).write_text(text)
        assert [r["id"] for r in features.read_features(spark, str(tmp_path / name), anywhere=True).orderBy("_at").collect()] == [0, 1, 2, 3]
