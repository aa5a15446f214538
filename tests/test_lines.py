"""Lines of append-only logs under any split, torn lines, and the latest finding of an entity."""

import io
import json
import random

import pytest

from tenderloom.sources import lines, registers


def expected(data):
    out, at = [], 0
    for piece in data.split(b"\n")[:-1]:
        out.append((at, True, piece))
        at += len(piece) + 1
    return out + ([(at, False, data[at:])] if data[at:] else [])


@pytest.mark.parametrize("seed", range(40))
def test_every_line_once_whatever_the_splits(seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([b"\n", b"a\n", b"long line " * rng.randrange(1, 9) + b"\n", b"\r\n", "é\n".encode(), b"x"]) for _ in range(rng.randrange(0, 40)))
    split, block = rng.randrange(1, 30), rng.randrange(1, 30)
    got = [line for a in range(0, len(data), split)
           for line in lines.lines_of(io.BytesIO(data), a, min(a + split, len(data)), len(data), block)]
    assert got == expected(data)


def finding(entity, platform, **more):
    return json.dumps({"entity_id": entity, "platform": platform, **more})


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    a = [finding("e1", "opengov"), finding("e2", "unknown"), '{"entity_id": "e1", "platform": "bon' + finding("e9", "opengov"), "", "  ", finding("", "opengov"),
         finding("e1", "bonfire", note="line\nbreak inside", also=["x", "y"]), "not json", finding(None, "x")]
    (tmp_path / "log" / "2024-01.jsonl").write_text("\n".join(a) + "\n")
    (tmp_path / "log" / "2024-02.jsonl").write_text(finding("e2", "ionwave") + "\n" + finding("e3", "selfhosted") + "\n" + '{"entity_id": "e1", "pla')
    (tmp_path / "log" / "_SUCCESS").write_text("")
    (tmp_path / "log" / "empty.jsonl").write_text("")
    return str(tmp_path / "log")


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_latest_whole_line_of_each_entity(spark, log, split):
    found = registers.finding_lines(spark, log, split)
    assert found.filter("torn").count() == 3
    latest = {r.entity_id: r for r in registers.latest_findings(found).collect()}
    assert {k: r.platform for k, r in latest.items()} == {"e1": "bonfire", "e2": "ionwave", "e3": "selfhosted"}
    assert (latest["e1"].note, latest["e1"].also) == ("line\nbreak inside", ["x", "y"])
    assert {r.entity_id for r in registers.worth_rechecking(registers.read_findings(spark, log)).collect()} == {"e1", "e2", "e3"}


def test_one_file_an_empty_folder_and_none(spark, log, tmp_path):
    assert registers.finding_lines(spark, f"file://{log}/2024-02.jsonl").count() == 3
    (tmp_path / "none").mkdir()
    assert registers.finding_lines(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="is not there"):
        registers.finding_lines(spark, str(tmp_path / "nowhere")).count()


def test_roster(spark, tmp_path):
    (tmp_path / "r.csv").write_text('entity_id,name,tier,county,website,email,phone,notes\ne1,"City, of X",municipal,broward,https://x.gov,,,"two\nlines, ""quoted"""\ne2,Y,,,  ,,,\ne3,Z,,,http://z,,,\n')
    asked = spark.createDataFrame([("e1",), ("e2",), ("e2",)], "entity_id string")
    rows = registers.read_roster(spark, str(tmp_path / "r.csv"), asked).collect()
    assert [(r.entity_id, r.name, r.notes) for r in rows] == [("e1", "City, of X", 'two\nlines, "quoted"')]
