import pytest
from pyspark.sql import functions as F

from citegrid.operators import reconcile
from citegrid.sources import files


def test_key_lists_and_selection(spark, tmp_path):
    (tmp_path / "keys").write_text(" a \n\nb\n")
    keys = files.keys(spark, str(tmp_path / "keys"))
    assert sorted(r.entry_key for r in keys.collect()) == ["a", "b"]
    (tmp_path / "none").write_text("\n  \n")
    with pytest.raises(ValueError):
        files.keys(spark, str(tmp_path / "none"))
    records = spark.createDataFrame([("a", "misc"), ("b", "misc"), ("c", "misc"), ("s", "bibsource")], "entry_key string, entry_type string")
    assert reconcile.selected(records, keys).count() == 2 and reconcile.selected(records, None).count() == 3
    with pytest.raises(KeyError, match="s"):
        reconcile.selected(records, spark.createDataFrame([("s",)], "entry_key string"))
    with pytest.raises(KeyError):
        reconcile.selected(records, keys.limit(0))


def test_folder(spark, tmp_path):
    (tmp_path / "b.BIB").write_text("@misc{x, a = {1}}\n")
    (tmp_path / "a.bib").write_text("% none\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.bib").write_text("")
    (tmp_path / "d.txt").write_text("")
    assert sorted(r.file.rsplit("/", 1)[1] for r in files.bibliographies(spark, str(tmp_path)).collect()) == ["a.bib", "b.BIB"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.bibliographies(spark, str(tmp_path / "empty"))
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_unseal_keeps_evidence(spark):
    f = F.create_map(*map(F.lit, ("integrity", "h", "bibapprovalid", "x", "bibsource", "s", "title", "t")))
    assert spark.range(1).select(reconcile.unseal(f)).first()[0] == {"bibsource": "s", "title": "t"}
