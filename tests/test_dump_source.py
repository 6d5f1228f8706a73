"""The data source of multistream dumps against Spark's own XML reader; broken files; a stream that is stopped and goes on."""

import bz2

import pytest

from lexmill.sources import dump_source, dumps


def page(i, text="t"):
    redirect = f'<redirect title="P{i + 1}" />' if i % 4 == 0 else ""
    return f"<page><title>P:{i}é</title><ns>{i % 2}</ns><id>{i}</id>{redirect}<revision><id>{100 + i}</id><timestamp>2020-01-0{1 + i % 9}T00:00:00Z</timestamp><text>{text} {i} &lt;b&gt;</text></revision></page>"


def written(folder, groups, packed=True):
    """Writes a dump whose streams hold the groups of page numbers -> addresses of dump and index."""
    data, lines, xml = b"", [], ""
    for ids in groups:
        body = "".join(page(i, "long " * 60_000 if i == 3 else "#REDIRECT [[Target]]" if i == 5 else "t") for i in ids) + ("<page><id>9999</id></page>" if ids[0] == 0 else "")
        lines += [f"{len(data)}:{i}:P:{i}é" for i in ids]
        data += bz2.compress(body.encode())
        xml += body
    (folder / "dump.bz2").write_bytes(data)
    index = "\n".join(lines).encode() + b"\n"
    (folder / "index").write_bytes(bz2.compress(index[: len(index) // 2]) + bz2.compress(index[len(index) // 2 :]) if packed else index)
    (folder / "all.xml").write_text(f"<mediawiki>{xml}</mediawiki>")
    return f"file://{folder}/dump.bz2", f"file://{folder}/index"


GROUPS = [[0, 1, 2], [3], [4, 5, 6, 7], [8, 9]]


@pytest.mark.parametrize("packed", [True, False])
def test_same_as_the_xml_reader(spark, tmp_path, packed):
    dump, index = written(tmp_path, GROUPS, packed)
    got = dump_source.read_dump(spark, dump, index, streams=2)
    assert got.rdd.getNumPartitions() == 2
    want = dumps.read_pages(spark, str(tmp_path / "all.xml"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert got.count() == 10 and {r["redirect"] for r in got.where("page_id in (4, 5)").collect()} == {"P5", "Target"}


def test_empty_index(spark, tmp_path):
    dump, _ = written(tmp_path, GROUPS)
    (tmp_path / "none").write_bytes(b"\n")
    assert dump_source.read_dump(spark, dump, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("lines, message", [("x:1:t", "not an index line"), ("5:t", "not an index line"), ("0:1:a\n999999999:2:b", "behind the end"), ("7:1:a", "no stream begins"), ("0:1:a\n50:1:b\n20:2:c", "below the one before")])
def test_broken_index(spark, tmp_path, lines, message):
    dump, _ = written(tmp_path, GROUPS)
    (tmp_path / "bad").write_text(lines)
    with pytest.raises(Exception, match=message):
        dump_source.read_dump(spark, dump, f"file://{tmp_path}/bad").count()


def test_cut_stream(spark, tmp_path):
    dump, index = written(tmp_path, GROUPS)
    data = (tmp_path / "dump.bz2").read_bytes()
    (tmp_path / "dump.bz2").write_bytes(data[:-10])
    with pytest.raises(Exception, match="is cut"):
        dump_source.read_dump(spark, dump, index).count()


def test_stopped_and_resumed(spark, tmp_path):
    """Each page comes once, though the query is started three times and the dump has grown before the last."""

    def run():
        pages = dump_source.stream_dump(spark, *written(tmp_path, groups), streams=1)
        q = pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    groups = GROUPS[:2]
    assert run() == [0, 1, 2, 3]
    assert run() == [0, 1, 2, 3]
    groups = GROUPS
    assert run() == list(range(10))
