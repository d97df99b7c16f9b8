import gzip
import zipfile

from brickloom.sources import documents as d
from brickloom.sources import ldraw as src
from brickloom.streaming.jobs import BatchCatalog, incremental_ingest

MODEL = "0 NAME Car\n1 4 0 0 0 1 0 0 0 1 0 0 0 1 3005.dat\n1 4 0 -24 0 1 0 0 0 1 0 0 0 1 3005.dat\n"


def test_files_are_read_and_ingested_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "car.ldr").write_text(MODEL)
    (inbox / "9999-1.ldr").write_text(MODEL)
    assert {r.assembly_id for r in src.read_ldraw(spark, str(inbox)).collect()} == {"car", "9999-1"}
    catalog = BatchCatalog(spark, str(tmp_path / "catalog"))
    for _ in range(2):
        incremental_ingest(spark, str(inbox), catalog, str(tmp_path / "progress"))
    row = catalog.read("sets").collect()
    assert [(r.set_id, r.name, r.theme, r.parts_count, r.is_fully_connected) for r in row] == [("car", "Car", "Studio MOC", 2, 1)]


def test_dump_and_archive_files(spark, tmp_path):
    with gzip.open(tmp_path / "themes.csv.gz", "wt") as f:
        f.write('id,name,parent_id\n1,"Town, old",\n2,City,1\nx,Bad,1\n3\n')
    rows = {tuple(r) for r in d.read_dump(spark, str(tmp_path / "themes.csv.gz"), "themes").collect()}
    assert rows == {(1, "Town, old", None), (2, "City", 1)}
    with zipfile.ZipFile(tmp_path / "m.io", "w") as z:
        z.writestr("part.ldr", "0 part")
        z.writestr("modelv2.ldr", MODEL)
    got = d.archive_members(d.read_archives(spark, str(tmp_path / "m.io"))).collect()
    assert [(r.assembly_id, r.member, r.text) for r in got] == [("m", "modelv2.ldr", MODEL)]
