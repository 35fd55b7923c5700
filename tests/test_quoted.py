"""CSV with line breaks inside quotes, in many parts, against the standard library's reader."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.sources import lists, quoted


@pytest.fixture
def small_parts(spark):
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    before = {name: spark.conf.get(name) for name in names}

    def use(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def expected(text):
    """Rows of the standard reader; lines of comments go first where no field is open."""
    kept, buffer = [], ""
    for line in text.removesuffix("\n").split("\n"):  # a line break at the end begins no line
        if not buffer and (line.startswith("#") or not line.strip("\r ")):
            continue
        buffer += line
        state, fresh, k = False, True, 0
        while k < len(buffer):  # a plain machine over characters
            c = buffer[k]
            if state and buffer[k : k + 2] == '""':
                k += 2
                continue
            if c == '"' and (state or fresh):
                state = not state
                fresh = False
            elif not state:
                fresh = c == ","
            k += 1
        if state:
            buffer += "\n"
        else:
            kept.append(buffer)
            buffer = ""
    return kept + ([buffer[:-1]] if buffer else [])


def test_rows_in_a_hundred_parts(spark, tmp_path, small_parts):
    r = random.Random(5)
    words = ["plain", "two words", 'a "quote"', "line\nbreak", "a,b", "# no comment", "\n\n", 'end"', "", "é", "x\r\ny", '"', '5" disk']
    out = io.StringIO()
    out.write("# head, with a \" quote\nid,note,more\n")
    writer, want = csv.writer(out, lineterminator="\n"), []
    for k in range(6000):
        row = [f"GSE{k}", r.choice(words) * r.randint(1, 3), r.choice(words)]
        writer.writerow(row)
        want.append((k + 1, *(v or None for v in row)))
        if k % 50 == 0:
            out.write("# between \"rows\n\n")
    path = tmp_path / "list.csv"
    path.write_bytes(out.getvalue().encode())
    small_parts(path.stat().st_size // 120)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 100
    got = [tuple(x) for x in lists.read_list(spark, path).orderBy("row").collect()]
    assert got == want


def test_records_by_brute_force(spark, tmp_path, small_parts):
    small_parts(37)
    path = tmp_path / "odd.csv"

    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.sampled_from(['"', '""', ",", "a", "b c", "\n", "#", '",', ',"', '"\n"', "\n#"]), min_size=1, max_size=120).map("".join))
    def check(text):
        path.write_text("id,n\n" + text)
        got = [r.text for r in quoted.records(spark, f"file://{path}").orderBy("record").collect()]
        assert got == expected("id,n\n" + text)

    check()


def test_parts_do_not_pass_through_the_driver(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('id,n\n"a\nb",1\nc,2\n')
    plan = lists.read_list(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert [tuple(x) for x in lists.read_list(spark, path).orderBy("row").collect()] == [(1, "a\nb", "1"), (2, "c", "2")]


def test_a_block_is_many_parts(spark, tmp_path, monkeypatch):
    """Lines are put in order a few at a time, however many a file's block holds."""
    monkeypatch.setattr(quoted, "LINES", 3)
    path, out, want = tmp_path / "list.csv", io.StringIO(), []
    out.write("id,note\n")
    writer = csv.writer(out, lineterminator="\n")
    for k in range(400):
        want.append((k + 1, str(k), 'a\n"b",\n\n# c' if k % 3 == 0 else "by rail"))
        writer.writerow(want[-1][1:])
    path.write_text(out.getvalue())
    rows = lists.read_list(spark, path)
    assert "hashpartitioning(block#" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "chunk#" in plan
    assert [tuple(x) for x in rows.orderBy("row").collect()] == want
