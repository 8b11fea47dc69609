"""Switching generations: one of two writers wins, readers stay with what they read, profiles don't mix."""

import pytest

from grainline.sources.generations import Generations, ProfileMismatch, Superseded


def ids(df):
    return sorted(r.id for r in df.collect())


def test_one_of_two_writers_wins(spark, tmp_path):
    table = Generations(spark, f"{tmp_path}/t")
    assert table.manifest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    first = table.commit(table.stage(spark.range(3)), "p1", parent=0)
    assert (first.version, first.rows) == (1, 3)
    a, b = table.stage(spark.range(5)), Generations(spark, f"{tmp_path}/t").stage(spark.range(7))
    assert ids(table.read()) == [0, 1, 2]
    table.commit(b, "p1", parent=1)
    with pytest.raises(Superseded):
        table.commit(a, "p1", parent=1)
    assert ids(table.read()) == list(range(7)) and table.versions() == [1, 2]


def test_a_lost_race_for_a_number_fails(spark, tmp_path, monkeypatch):
    table = Generations(spark, f"{tmp_path}/t")
    table.commit(table.stage(spark.range(1)), "p", parent=0)
    slow = table.stage(spark.range(2))
    publish = Generations._publish

    def overtaken(self, aside, version):
        monkeypatch.setattr(Generations, "_publish", publish)
        other = Generations(spark, f"{tmp_path}/t")
        other.commit(other.stage(spark.range(9)), "p", parent=1)
        publish(self, aside, version)

    monkeypatch.setattr(Generations, "_publish", overtaken)
    with pytest.raises(Superseded):
        table.commit(slow, "p", parent=1)
    assert ids(table.read()) == list(range(9))
    assert not [f for f in (tmp_path / "t" / "_manifest").iterdir() if not f.name.startswith((".v", "v"))]


def test_readers_keep_their_version(spark, tmp_path):
    table = Generations(spark, f"{tmp_path}/t")
    table.commit(table.stage(spark.range(2)), "p", parent=0)
    held = table.read()
    table.commit(table.stage(spark.range(10, 14)), "p", parent=1)
    assert ids(held) == [0, 1] and ids(table.read(1)) == [0, 1] and ids(table.read()) == [10, 11, 12, 13]
    table.commit(table.stage(spark.range(1)), "p", parent=2)
    assert len(table.expire(keep=2)) == 1 and table.versions() == [2, 3]
    assert ids(table.read(2)) == [10, 11, 12, 13]


def test_other_profiles_and_halves_are_refused(spark, tmp_path):
    table = Generations(spark, f"{tmp_path}/t")
    table.commit(table.stage(spark.range(2)), "p", parent=0)
    with pytest.raises(ProfileMismatch):
        table.commit(table.stage(spark.range(2)), "q", parent=1)
    half = table.stage(spark.range(2))
    (tmp_path / "t" / f"generation={half}" / "_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        table.commit(half, "p", parent=1)
    assert table.versions() == [1]
