"""CSV files read in blocks against a reader that goes through the text character by character."""

import random

import pytest

from namelens.sources import watchlist as wl


def by_character(text):
    """Rows of fields: a quote toggles anywhere, two within quotes are one, and blank lines are none."""
    rows, row, field, inside, k = [], [], "", False, 0
    while k < len(text):
        c = text[k]
        if c == '"' and inside and text[k + 1 : k + 2] == '"':
            field, k = field + '"', k + 1
        elif c == '"':
            inside = not inside
        elif not inside and c == ",":
            row, field = row + [field], ""
        elif not inside and c in "\r\n":
            row, field = row + [field], ""
            rows, row = rows + [row], []
        else:
            field += c
        k += 1
    rows = rows + [row + [field]]
    return [r for r in rows if len(r) > 1 or r[0]]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


TEXTS = [
    'id,name\n1,a"b,c"d\n2,"x ""y"" z"\n3,"one\ntwo\n\nthree",end\n',
    'id,name\r\n1,"a\r\nb"\r\n\r\n2,b\rc,d\r"e\rf",g',
    'a\n"",x\n"""",y\n""\n,\n"open, to the end\nof the file',
    "",
]


def made(rng):
    parts = ["a", "é", ",", '"', '""', "\n", "\r\n", "\r", '"q,\n"', "long " * 9, ";"]
    return "".join(rng.choices(parts, weights=[9, 2, 6, 1, 2, 3, 1, 1, 3, 2, 1], k=rng.randrange(900)))


def test_records_equal_those_read_by_character(spark, small_blocks, tmp_path):
    rng = random.Random(4)
    texts = {f"{k}.csv": text for k, text in enumerate(TEXTS + [made(rng) for _ in range(12)])}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {name: [] for name in texts}
    for r in wl.csv_records(spark, str(tmp_path)).orderBy("row_order", "piece").collect():
        got[r.file.rsplit("/", 1)[1]].append(r.fields)
    assert got == {name: by_character(text) for name, text in texts.items()}


def test_a_large_record_spans_blocks_that_are_read_apart(spark, small_blocks, tmp_path):
    text = "id,schema,name,id\n" + "".join(f'{k},Person,"line {k}\nand ""more""\n{"x" * (k % 90)}",i{k}\n' for k in range(60))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text("name,schema\nKim,Person\nonly\n")
    lines = wl.csv_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 6 and lines.select("file", "block").distinct().count() > 6
    got = wl.read_csv(spark, str(tmp_path)).orderBy("row_order").collect()
    assert [(r.id, r.name) for r in got] == [(f"i{k}", f'line {k}\nand "more"\n{"x" * (k % 90)}') for k in range(60)] + [("", "Kim"), ("", "only")]
    assert {r.aliases for r in got} == {""} and len({r.row_order for r in got}) == len(got)
