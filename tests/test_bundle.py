"""A report bundle is committed whole, or the previous one stays."""

import pytest
from pyspark.sql import functions as F

from retentia import sinks
from retentia.sinks import bundle


def _frame(spark, tag, fail=False):
    df = spark.createDataFrame([(tag,)], "tag string")
    return df.select(F.raise_error(F.lit("broken member")).cast("string").alias("tag")) if fail else df


def _write(spark, out, tag, fail=False):
    return sinks.write_correlation_report(_frame(spark, tag), _frame(spark, tag), _frame(spark, tag, fail), out)


def _tags(spark, out):
    return [spark.read.json(f"{out}/{f}").first().tag for f in ("pearson.json", "spearman.json", "strong_pairs.json")]


def _helpers(out):
    return [p.name for p in out.iterdir() if p.name.startswith((bundle.STAGED, bundle.PREVIOUS))]


def test_failing_member_leaves_the_previous_bundle(spark, tmp_path):
    out = str(tmp_path)
    (tmp_path / "mine.txt").write_text("kept")
    paths = _write(spark, out, "one")
    first = bundle.manifest(spark, out)
    assert first["members"] == {k: p.rsplit("/", 1)[1] for k, p in paths.items()}
    with pytest.raises(Exception, match="broken member"):
        _write(spark, out, "two", fail=True)
    assert _tags(spark, out) == ["one"] * 3 and bundle.manifest(spark, out) == first and not _helpers(tmp_path)
    _write(spark, out, "three")
    assert _tags(spark, out) == ["three"] * 3 and bundle.manifest(spark, out) != first
    assert (tmp_path / "mine.txt").read_text() == "kept" and not _helpers(tmp_path)


def test_first_bundle_that_fails_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="broken member"):
        _write(spark, str(tmp_path), "one", fail=True)
    assert bundle.manifest(spark, str(tmp_path)) is None and list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("moves", range(9))
def test_every_point_of_a_swap(spark, tmp_path, monkeypatch, moves):
    """A failing move is undone at once; a dead driver's swap is undone, or found finished, by the next writer."""
    out = str(tmp_path)
    _write(spark, out, "one")
    real, left = bundle.Folder.move, [moves]

    def move(self, source, target):
        if left[0] == 0:
            raise OSError("no more moves")
        left[0] -= 1
        real(self, source, target)

    undo = bundle._undo
    monkeypatch.setattr(bundle.Folder, "move", move)
    monkeypatch.setattr(bundle, "_undo", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))  # the driver dies here
    if moves < 8:  # the old manifest and three members out, the same in
        with pytest.raises(KeyboardInterrupt):
            _write(spark, out, "two")
    else:
        _write(spark, out, "two")
    monkeypatch.setattr(bundle.Folder, "move", real)
    monkeypatch.setattr(bundle, "_undo", undo)
    bundle.recover(spark, out)
    assert _tags(spark, out) == ["one" if moves < 8 else "two"] * 3
    assert bundle.manifest(spark, out) is not None and not _helpers(tmp_path)


def test_failing_move_is_undone_at_once(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    _write(spark, out, "one")
    real = bundle.Folder.move

    def move(self, source, target):
        if source.startswith(bundle.STAGED) and target == "spearman.json":
            raise OSError("disk is gone")
        real(self, source, target)

    monkeypatch.setattr(bundle.Folder, "move", move)
    with pytest.raises(OSError, match="disk is gone"):
        _write(spark, out, "two")
    assert _tags(spark, out) == ["one"] * 3 and not _helpers(tmp_path)
