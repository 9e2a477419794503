"""JSON array files read in splits."""

import json
import os
import random
import tempfile

import pytest

from mailsift.sources.arrays import array_elements
from mailsift.sources.messages import read_messages


def write(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(text)


def elements(spark, folder):
    return [r["value"] for r in read_messages(spark, folder, "array").orderBy("position").collect()]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def nasty(rng):
    text = "".join(rng.choice(['}', '{', '"', "\\", ",", "[", "]", "é", "漢", "x", "\n", " "]) for _ in range(rng.randint(0, 30)))
    return rng.choice([{"id": text, "payload": {"parts": [{"a": text}, [], {}], text: "}"}}, {}, [], [[text], {"b": {}}], text, 5, None,
                       {"long": text * 20}])


@pytest.mark.parametrize("split", [37, 200, 100_000])
def test_any_split_gives_the_elements_in_order(spark, small_splits, split):
    rng = random.Random(split)
    folder = tempfile.mkdtemp(prefix="mailsift-arrays-")
    want = []
    for i in range(3):
        items = [nasty(rng) for _ in range(40)]
        want += items
        write(folder, f"{i}.json", json.dumps(items, indent=rng.choice([None, 1]), ensure_ascii=rng.choice([True, False])))
    write(folder, "3.json", " [ ] ")
    write(folder, "4.json", '[{"one": 1}]')
    small_splits(split)
    got = read_messages(spark, folder, "array").collect()
    assert sorted(r["position"] for r in got) == list(range(len(want) + 1))
    assert [json.loads(v) for v in elements(spark, folder)] == [*want, {"one": 1}]


def test_a_large_array_uses_several_tasks(spark, small_splits):
    folder = tempfile.mkdtemp(prefix="mailsift-arrays-")
    items = [{"id": f"m{i}", "payload": {"body": "x" * 1000}} for i in range(2000)]
    write(folder, "big.json", json.dumps(items))
    small_splits(200_000)
    df = array_elements(spark, folder)
    assert df.select("source_at").distinct().count() >= 8
    assert [json.loads(v)["id"] for v in elements(spark, folder)] == [x["id"] for x in items]


def test_unclosed_arrays(spark, small_splits):
    folder = tempfile.mkdtemp(prefix="mailsift-arrays-")
    write(folder, "a.json", '[{"a": 1}, {"b": [2')
    write(folder, "b.json", '[{"a": 1}, {"b": 2}')
    write(folder, "c.json", '[{"a": 1}] trailing {"x": 1}')
    for split in (5, 1000):
        small_splits(split)
        got = elements(spark, folder)
        good = []
        for v in got:
            try:
                good.append(json.loads(v))
            except ValueError:
                good.append("malformed")
        assert good == [{"a": 1}, "malformed", {"a": 1}, "malformed", {"a": 1}]
