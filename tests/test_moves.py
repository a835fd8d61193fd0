"""Plans of moves, copies and links."""

import os

import pytest
from pyspark.sql import functions as F

from webstrata.operators import moves

PLAN = "source string, target string, action string"


def _files(folder, names):
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(f"was {name}")


def _there(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


ROWS = [("a", "b", "move"), ("b", "a", "move"), ("c", "d", "move"), ("d", "e/f", "move"), ("x", "y", "move"), ("y", "z", "move"), ("z", "x", "move"), ("k", "l/copy", "copy"), ("k", "l/hard", "hardlink"), ("k", "l/soft", "symlink"), ("same", "same", "move"), ("m", "n", "move")]
WANT = {"b": "was a", "a": "was b", "d": "was c", "e/f": "was d", "y": "was x", "z": "was y", "x": "was z", "k": "was k", "l/copy": "was k", "l/hard": "was k", "l/soft": "was k", "same": "was same", "n": "was m"}


@pytest.fixture
def folder(tmp_path):
    _files(tmp_path / "files", ["a", "b", "c", "d", "x", "y", "z", "k", "same", "m"])
    return tmp_path / "files"


def test_swaps_chains_and_circles(spark, folder, tmp_path):
    plan = spark.createDataFrame(ROWS, PLAN)
    assert moves.relocate(plan, str(folder), str(tmp_path / "j")) == 11
    assert _there(folder) == WANT
    assert os.path.islink(folder / "l/soft") and os.path.samefile(folder / "l/hard", folder / "k") and not os.path.samefile(folder / "l/copy", folder / "k")
    assert moves.relocate(plan, str(folder), str(tmp_path / "j")) == 11  # all is done already
    assert _there(folder) == WANT


@pytest.mark.parametrize("at", ["1-link", "2-leave", "3-move", "4-arrive"])
def test_a_plan_that_was_broken_off(spark, folder, tmp_path, monkeypatch, at):
    plan, step = spark.createDataFrame(ROWS, PLAN), moves._step
    names = dict(zip(["1-link", "2-leave", "3-move", "4-arrive"], range(4)))
    calls = []

    def broken(rows, *more):
        calls.append(1)
        if len(calls) - 1 == names[at]:
            step(rows.where(F.col("target").isin("b", "y", "e/f", "l/hard", "n")), *more).count()  # some rows are done, then all is lost
            raise RuntimeError("lost")
        return step(rows, *more)

    monkeypatch.setattr(moves, "_step", broken)
    with pytest.raises(RuntimeError):
        moves.relocate(plan, str(folder), str(tmp_path / "j"))
    monkeypatch.setattr(moves, "_step", step)
    moves.relocate(plan, str(folder), str(tmp_path / "j"))
    assert _there(folder) == WANT


@pytest.mark.parametrize("rows, what", [([("a", "q", "move"), ("b", "q", "move")], "several"), ([("a", "q", "burn")], "unknown"), ([("a", "q", "move"), ("a", "r", "copy")], "other uses"), ([("a", "q", "copy"), ("b", "a", "move")], "overwritten"), ([("a", "../q", "move")], "not below"), ([("a", "b", "copy")], "b")])
def test_plans_that_are_refused(spark, folder, tmp_path, rows, what):
    before = _there(folder)
    with pytest.raises(Exception, match=what):
        moves.relocate(spark.createDataFrame(rows, PLAN), str(folder), str(tmp_path / "j"))
    assert _there(folder) == before
    assert moves.relocate(spark.createDataFrame([("a", "b", "copy")], PLAN), str(folder), str(tmp_path / "k"), overwrite=True) == 1
    assert _there(folder)["b"] == "was a"
