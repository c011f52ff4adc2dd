import os

from quire.plans import durable


def test_folders_of_a_block_go_with_it(spark):
    kept = durable.fresh_folder(spark, "kept")
    with durable.owned(spark):
        one = durable.settled(spark.range(5))
        with durable.owned(spark):
            inner = durable.fresh_folder(spark, "inner")
            assert os.path.isdir(inner)
        assert not os.path.exists(inner)
        rows = durable.settled(one.selectExpr("id * 2 AS id"), kept)
        made = one.inputFiles()
        assert made
    assert not any(os.path.exists(p.removeprefix("file://")) for p in made)
    assert sorted(r.id for r in rows.collect()) == [0, 2, 4, 6, 8]
    assert durable.settled(spark.range(3)).count() == 3
