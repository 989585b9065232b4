"""Discovery of files and folders by name, and digests that tell what changed."""

import pytest

from flintsieve.operators import select
from flintsieve.sources import readers


def test_discovery_ranks_by_part_and_length(spark, tmp_path):
    for name in ("outputs/a/dataset_top260.csv", "outputs/dataset_top260.csv", "outputs/dataset_final.csv", "outputs/other.txt", "samples/dataset_x.csv", "outputs/models_top260/metrics.csv", "outputs/deep/models_top260/metrics.csv", "outputs/models_none/x.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    own = lambda rows: [r["path"].split(f"{tmp_path.name}/")[1] for r in rows]
    found = readers.discover(spark, str(tmp_path), [r"(^|/)dataset_[^/]*\.csv$"], ["_top260", "_final"])
    assert own(found.collect()) == ["outputs/dataset_top260.csv", "outputs/a/dataset_top260.csv", "outputs/dataset_final.csv", "samples/dataset_x.csv"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    models = readers.discover(spark, str(tmp_path), [r"models[^/]*$"], ["top260"], beside="metrics.csv")
    assert own(models.collect()) == ["outputs/models_top260", "outputs/deep/models_top260"]
    assert readers.discover(spark, str(tmp_path), ["nothing"], []).isEmpty()


def test_a_changed_byte_is_an_error(spark, tmp_path):
    folder = tmp_path / "models"
    (folder / "a").mkdir(parents=True)
    (folder / "a" / "part").write_bytes(b"\x00\x01" * 1000)
    (folder / "b").write_text("text")
    readers.write_manifest(spark, str(folder))
    readers.check_manifest(spark, str(folder))
    raw = bytearray((folder / "a" / "part").read_bytes())
    raw[77] ^= 1
    (folder / "a" / "part").write_bytes(raw)
    with pytest.raises(ValueError, match="a/part"):
        readers.check_manifest(spark, str(folder))
    raw[77] ^= 1
    (folder / "a" / "part").write_bytes(raw)
    (folder / "new").write_text("x")
    with pytest.raises(ValueError, match="new"):
        readers.check_manifest(spark, str(folder))
    (folder / "new").unlink()
    (folder / "b").unlink()
    with pytest.raises(ValueError, match="b"):
        readers.check_manifest(spark, str(folder))


def test_features_by_membership(spark):
    audit = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "feature string, n int")
    data = spark.createDataFrame([(1, 2)], "a int, c int")
    assert [tuple(r) for r in select.only_known(audit, select.columns_of(data)).collect()] == [("a", 1)]
    assert [r[0] for r in select.lacking(select.columns_of(data), audit).collect()] == ["c"]
