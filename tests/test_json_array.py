"""One JSON array read by many tasks equals the unsplit reading, wherever the ranges end; a malformed file raises."""

import json

import pytest

from piisieve.sources.json_array import advance, read_json_array, write_json_array

SCHEMA = "document long, full_text string, tokens array<string>, extra struct<a:long,b:string>"
ROWS = [{"document": i, "full_text": t, "tokens": ["{", "}", '"', "\\", "]["] * (i % 3), "extra": {"a": i, "b": "}{" * i}}
        for i, t in enumerate(['}', '\\"}', 'a "quoted } text"', "", "\\\\", "é😀}\n[", "x" * 300 + "}" * 40, '{"document": 7}', "],[{", "\t"])]


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(size):
        spark.conf.set(name, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    spark.conf.set(name, before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def got(spark, path):
    return sorted((r.asDict(recursive=True) for r in read_json_array(spark, str(path), SCHEMA).collect()), key=lambda r: r["document"])


def test_state_over_pieces():
    for text, want in (('[{"a": "x', (2, True)), ('{"a": 1', (0, False)), ('"}"]', (-2, False)), ('\\"', (0, True))):
        assert advance(text, text.startswith("\\")) == want


@pytest.mark.parametrize("size,indent", [(64, None), (333, 2), (1 << 20, None)])
def test_any_cut_gives_the_same_rows(spark, tmp_path, small_ranges, size, indent):
    text = json.dumps(ROWS, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(" [ \n ] ")
    (tmp_path / "c.json").write_text("")
    small_ranges(size)
    frame = read_json_array(spark, str(tmp_path), SCHEMA)
    assert got(spark, tmp_path) == ROWS
    assert size > 1000 or frame.rdd.getNumPartitions() > 4


@pytest.mark.parametrize("tail", ["", "}", "]}", "},]", '},{"document": 3', "}] x", "}]]", '}, 5]', '},{"document": "x"}]', '} {"document": 2}]', '}, "open'])
def test_malformed_files_raise(spark, tmp_path, small_ranges, tail):
    (tmp_path / "a.json").write_text('[{"document": 1' + tail)
    small_ranges(16)
    with pytest.raises(Exception):
        read_json_array(spark, str(tmp_path), SCHEMA).collect()


def test_written_arrays_read_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    write_json_array(df, str(tmp_path / "out"))
    assert spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "out")).count() == len(ROWS)
    assert got(spark, tmp_path / "out") == ROWS
