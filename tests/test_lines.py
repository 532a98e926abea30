"""Programs read by lines, in pieces of any size, against the same programs read whole."""

from __future__ import annotations

import random

import pytest
from codeloom.functions import runs
from codeloom.functions.runs import in_order, neighbours, running
from codeloom.functions.tables import written
from codeloom.operators import relations
from codeloom.plans.facts import Facts
from codeloom.sources import programs
from codeloom.sources.programs import from_programs, parse_errors, read_lines, read_programs
from codeloom.sources.tables import NAMES
from codeloom.sources.texts import faulty_texts, program_texts
from pyspark.sql import functions as F
from small_programs import ALPHA, BROKEN

SF = "/root/testdata/sf0.001"


def random_list(rng, depth: int) -> str:
    """Statements, nested up to a depth."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["assign", "read", "print", "while", "if"] if depth else ["assign", "read"])
        x, y = rng.choice("xyz"), rng.choice("xyz")
        simple = {"assign": f"{x} = {y} + 1 ;", "read": f"read {x} ;", "print": f"print {x} ;"}
        inner = lambda: random_list(rng, depth - 1)
        out.append(simple.get(kind) or (f"while ( {x} > 1 ) {{ {inner()} }}" if kind == "while" else f"if ( {x} == {y} ) then {{ {inner()} }} else {{ {inner()} }}"))
    return " ".join(out)


def random_program(rng) -> str:
    return " ".join(f"procedure p{k} {{ {random_list(rng, 3)} }}" for k in range(3))


def lines_of(texts, size: int):
    """Lines of whole texts, `size` to a piece."""
    t = texts.select("program_id", F.posexplode(F.split("source", "\n")).alias("line", "source"))
    return t.select("program_id", F.floor(F.col("line") / size).alias("piece"), "line", "source")


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def assert_same_facts(got, want):
    for name in NAMES:
        columns = getattr(want, name).columns
        assert rows(getattr(got, name), columns) == rows(getattr(want, name), columns), name


@pytest.mark.parametrize("size", [1, 7])
def test_lines_give_the_facts_of_whole_texts(spark, size):
    rng = random.Random(size)
    sources = [ALPHA, *[random_program(rng) for _ in range(6)], "", " \n "]
    # A line for each token, or nearly so, with empty lines between.
    texts = spark.createDataFrame([(str(k), s.replace(" ", "\n\n" if k % 2 else "\n")) for k, s in enumerate(sources)], "program_id string, source string")
    assert_same_facts(from_programs(lines_of(texts, size)), from_programs(texts))


def test_lines_give_the_errors_of_whole_texts(spark):
    texts = faulty_texts(program_texts(spark.read.parquet(f"{SF}/events.parquet")))
    more = [s.replace(" ", "\n") for s, _ in BROKEN.values()] + ["", "\n", "procedure p { x = 1;\n} ;", "procedure p {\nif (x == 1) then {\ny = 1; }\nx = 2; }", "procedure p { else {\n x = 1; } }", "}\n{"]
    texts = texts.unionByName(spark.createDataFrame([(f"m{k}", s) for k, s in enumerate(more)], "program_id string, source string"))
    want = rows(parse_errors(texts), ["program_id", "message"])
    assert len({m for _, m in want}) > 8
    assert rows(parse_errors(lines_of(texts, 3)), ["program_id", "message"]) == want


def test_files_and_folders_are_read_by_lines(spark, tmp_path):
    first, second = "procedure p { while (x > 1) {\n  y = 2;", "  if (y == x) then { z = 1; }\n  else { call q; } } }\nprocedure q { read x; }"
    for k, text in ((1, first), (2, second)):
        (tmp_path / "whole").mkdir(exist_ok=True)
        (tmp_path / "whole" / f"part-{k}.txt").write_text(text)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "all.txt").write_text(first + "\n" + second)
    want = from_programs(read_programs(spark, str(tmp_path / "one")))
    # Files are split after a few bytes, so that blocks and parts begin anywhere.
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        one = read_lines(spark, str(tmp_path / "one"), lines=2)
        parts = read_lines(spark, str(tmp_path / "whole"), folders=True, lines=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert one.select("piece").distinct().count() > 3
    assert parts.select("program_id").distinct().count() == 1
    for lines in (one, parts):
        got = from_programs(lines)
        for name in NAMES:
            columns = [c for c in getattr(want, name).columns if c != "program_id"]
            assert rows(getattr(got, name), columns) == rows(getattr(want, name), columns), name


def test_runs_in_pieces_are_runs_of_the_group(spark):
    rng = random.Random(3)
    data = [(g, i, i // 3, rng.choice([None, "a", "b"]), rng.choice([None, 1, -1]), f"t{i}") for g in "pq" for i in range(11)]
    df = spark.createDataFrame(data, "g string, i long, piece long, name string, step int, word string")
    df = df.where("i % 5 <> 1")  # pieces of one row among them
    for piece in (None, "piece"):
        t = running(df, ["g"], "i", sums={"total": F.col("step")}, lasts={"seen": F.col("name")}, piece=piece)
        t = neighbours(t, ["g"], "i", "word", piece)
        got = rows(t, ["g", "i", F.coalesce("total", F.lit(0)), "seen", "prev", "next", "next2"])
        want = got if piece is None else want
        assert got == want


@pytest.mark.parametrize("size", [1, 3, 100])
def test_pairs_in_order_by_cells(spark, size):
    rng = random.Random(size)
    left = [(g, rng.randrange(20), k) for g in "abc" for k in range(15)]
    right = [(g, rng.randrange(20), k) for g in "bcd" for k in range(15)]
    a = spark.createDataFrame(left, "g string, pos_l long, l int")
    b = spark.createDataFrame(right, "g string, pos_r long, r int")
    want = sorted(((g, l, r) for g, x, l in left for h, y, r in right if g == h and x < y), key=repr)
    assert rows(in_order(a, b, ["g"], size), ["g", "l", "r"]) == want


@pytest.mark.parametrize("relation", ["follows", "follows_t", "next", "next_t", "affects"])
def test_long_lists_are_cut(spark, monkeypatch, relation):
    """With cells of three positions the lists of these programs are long; rows are as without."""
    rng = random.Random(11)
    texts = spark.createDataFrame([(str(k), random_program(rng).replace("p0 {", "p0 { x = 2 ; y = x + 1 ; z = y + x ; read y ; y = x + y ; print z ; x = y + z ;")) for k in range(4)], "program_id string, source string")
    facts = from_programs(texts)
    want = rows(getattr(relations, relation)(facts), ["program_id", "l", "r"])
    monkeypatch.setattr(runs, "CELL", 3)
    facts = Facts.from_tables({name: getattr(facts, name) for name in NAMES})
    assert facts.piece is not None and len(want) > 20
    assert rows(getattr(relations, relation)(facts), ["program_id", "l", "r"]) == want


def test_steps_have_a_row_for_a_segment_and_no_names_of_files(spark, tmp_path, monkeypatch):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "all.txt").write_text("procedure p {\n" + "while (x > 1) {\n x = y + z * 3 - 1;\n print x; }\n" * 20 + "}")
    lines = read_lines(spark, str(tmp_path / "one"), lines=5)
    assert dict(lines.dtypes)["piece"] == "bigint"
    made = []

    def counted(df, name):
        t = written(df, name)
        made.append((name, t.count()))
        return t

    monkeypatch.setattr(programs, "written", counted)
    facts = from_programs(lines)
    assert facts.stmt.count() == 60
    # 82 segments of 304 tokens; where blocks are looked up, those that begin or end one.
    assert made and max(n for _, n in made) <= 82, made
