import csv
import io
import random

import pytest

from brickloom.sources import documents as d
from brickloom.sources import ldraw as src
from brickloom.sources.lines import csv_records, read_lines


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_over_many_blocks(spark, tmp_path, small_blocks):
    r = random.Random(3)
    texts = {}
    for name, end in (("a", "\n"), ("b c", "\r\n"), ("d", "\r")):
        lines = [f"{i} " + "x" * r.choice([0, 3, 40, 2000]) for i in range(120)] + ["", "  last  "]
        texts[name] = lines
        (tmp_path / f"{name}.ldr").write_bytes((end.join(lines) + end * (name == "a")).encode())
    (tmp_path / "empty.ldr").write_bytes(b"")
    df = read_lines(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    got = {(x.assembly_id, x.line_no): x.line for x in src.read_ldraw_lines(spark, str(tmp_path)).collect()}
    assert got == {(n, i): line.strip() for n, lines in texts.items() for i, line in enumerate(lines)}
    whole = src.text_lines(src.read_ldraw(spark, str(tmp_path))).filter("line <> '' OR line_no < 120").collect()
    assert {(x.assembly_id, x.line_no): x.line for x in whole if x.line or x.assembly_id != "empty"}.items() <= got.items()


def random_file(r, rows):
    """Fields with quotes, commas and line breaks, some quoted without need, some with a quote inside an unquoted field."""
    out = []
    for i in range(rows):
        fields = [str(i)]
        for _ in range(r.randint(1, 3)):
            raw = "".join(r.choice('ab ,"\n') for _ in range(r.randint(0, 9)))
            fields.append('"' + raw.replace('"', '""') + '"' if r.random() < 0.7 else "u" + raw.replace(",", "").replace("\n", ""))
        out.append(",".join(fields))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("limited", [False, True])
def test_records_against_the_csv_module(spark, tmp_path, small_blocks, limited, request):
    if limited:
        request.getfixturevalue("tiny_groups")
    r = random.Random(7)
    want = {}
    for k in range(3):
        text = random_file(r, 150)
        if k == 2:
            text += '9,"never closed\nand more,1\n\n2'
        (tmp_path / f"f{k}.csv").write_text(text)
        want[f"f{k}.csv"] = [row for row in csv.reader(io.StringIO(text)) if row]
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n\n2,y\n")
    want["plain.csv"] = [["a", "b"], ["1", "x"], ["2", "y"]]
    got = {}
    for x in sorted(csv_records(read_lines(spark, str(tmp_path))).collect()):
        (row,) = csv.reader(io.StringIO(x.record))
        got.setdefault(x.file_path.rsplit("/", 1)[-1], []).append(row)
    assert got == want


def test_large_dump_equals_the_whole_file_reading(spark, tmp_path, small_blocks):
    rows = ["id,name,parent_id"] + [f'{i},"Town, ""old""\nno {i}",{i // 2}' if i % 3 else f"{i},City {i}," for i in range(1, 200)] + ["x,Bad,1", "3"]
    (tmp_path / "themes.csv").write_text("\n".join(rows) + "\n")
    want = sorted(map(tuple, d.read_dump(spark, str(tmp_path / "themes.csv"), "themes").collect()), key=str)
    got = sorted(map(tuple, d.read_large_dump(spark, str(tmp_path / "themes.csv"), "themes").collect()), key=str)
    assert len(want) == 199 and got == want
    (tmp_path / "none.csv").write_text("")
    assert d.read_large_dump(spark, str(tmp_path / "none.csv"), "themes").collect() == []
