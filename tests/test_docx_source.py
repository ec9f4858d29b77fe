"""Word-processor files as a data source: the same rows as the parse of all relations, in a batch and as they arrive."""

import time

import pytest

from tests.test_patch import package
from vellum.sources import docx as D
from vellum.sources.docx_source import DocxSource, groups, listed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("source")
    (at / "deep").mkdir()
    for k in range(5):
        (at / "deep" / f"f{k}.docx").write_bytes(package())
    (at / "odd.docx").write_bytes(b"none")
    (at / "other.txt").write_bytes(b"none")
    return at


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("relation", list(D.SCHEMAS))
def test_relations_equal_those_of_the_parse(spark, folder, relation):
    spark.dataSource.register(DocxSource)
    got = spark.read.format("docx").option("relation", relation).option("group_bytes", 5000).load(f"file://{folder}")
    assert rows(got) == rows(D.read_docx(spark, f"file://{folder}")[relation].select(got.columns))


def test_files_are_grouped_by_bytes_and_unknown_relations_refused(spark, folder):
    files = listed(str(folder))
    assert len(files) == 6 and [len(g.paths) for g in groups(files, 1)] == [1] * 6 and len(groups(files, 1 << 30)) == 1 and groups([], 5) == []
    spark.dataSource.register(DocxSource)
    with pytest.raises(Exception, match="no relation"):
        spark.read.format("docx").option("relation", "pages").load(str(folder)).schema  # noqa: B018


def test_files_are_read_once_as_they_arrive(spark, tmp_path):
    spark.dataSource.register(DocxSource)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.docx").write_bytes(package())

    def run():
        stream = spark.readStream.format("docx").option("relation", "bookmarks").load(str(source))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out).count()

    first = run()
    assert first == 4 and run() == first
    time.sleep(0.01)
    (source / "b.docx").write_bytes(package())
    assert run() == 2 * first
