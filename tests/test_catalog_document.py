"""A document read in many splits has the entries of the document read as one row."""

import json

import pytest

from veilworks.sources.catalog_document import read_document
from veilworks.sources.catalog_files import read_catalog


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def log(i):
    return {"id": f"{i + 1}", "name": f"n {{{i}", "sample": f'a "q\\" }} ] , // {i} /* é' + "x" * (i % 90), "test_case": {"k": ["}", "]"]} if i % 3 else {}}


@pytest.mark.parametrize("size", [37, 500])
@pytest.mark.parametrize("indent", [None, 2])
def test_equal_to_the_whole_document(spark, tmp_path, small_splits, size, indent):
    text = json.dumps({"note": "\"logs\": [", "other": [1, {"a": 2}], "schema_version": 1, "logs": [log(i) for i in range(25)], "last": {"logs": [3, 4]}}, indent=indent, ensure_ascii=False)
    plain = tmp_path / "plain.json"
    plain.write_text(text)
    want = rows(read_catalog(spark, str(plain)))
    text = "/* { \" */" + text.replace('"last"', '/* ] } " */ "last"')
    path = tmp_path / "catalog.json"
    path.write_text(text if indent is None else text.replace("\n", " // a } comment \" [\n") + "\n")
    small_splits(size)
    assert len(want) == 25 and rows(read_document(spark, str(path))) == want


@pytest.mark.parametrize("text, found", [('{"schema_version": 1, "logs": []}', 0), ('{"logs": [ /* none */ ], "schema_version": 1}\n', 0)])
def test_no_entries(spark, tmp_path, text, found):
    (tmp_path / "c.json").write_text(text)
    assert read_document(spark, str(tmp_path / "c.json")).count() == found


@pytest.mark.parametrize("text", ['{"schema_version": 1, "logs": [{"id": "7"', '{"schema_version": 1}', '{"schema_version": 2, "logs": []}', '{"schema_version": 1, "logs": [], "logs": []}', '{"schema_version": 1, "logs": [{"id": 5, "name": "n", "sample": "s"}]}', '{"schema_version": 1, "logs": [] /* open }'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError):
        read_document(spark, str(tmp_path / "c.json"))
