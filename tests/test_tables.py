"""Stored matrices, versions, labels and hops."""

import pytest
from pyspark.sql import functions as F

from quillon.queries import landed
from quillon.sources import tables


def test_matrix_copies(spark):
    cells = spark.createDataFrame([(r, c, (r * c) % 7 + 1) for r in range(40) for c in range(30) if (r + c) % 3], "row long, col long, n long")
    folder = tables.shared_folder(spark)
    tables.write_matrix(cells, "cells_by_row", "cells_by_col", buckets=4, folder=folder)
    by_row, by_col = tables.read_matrix(spark, "cells_by_row", "cells_by_col")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for t, key in ((by_row, "row"), (by_col, "col")):
            share = landed.matrix_share(t, key)
            assert "Exchange" not in share._jdf.queryExecution().executedPlan().toString()
            assert share.count() == cells.count() and abs(share.agg(F.sum("share")).first()[0] - cells.select(key).distinct().count()) < 1e-6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tables.write_matrix(cells.where("row > 0"), "cells_by_row", "other", buckets=4, folder=tables.shared_folder(spark))
    with pytest.raises(ValueError):
        tables.read_matrix(spark, "cells_by_row", "cells_by_col")


def test_pruning_keeps_the_current_version(spark):
    root = tables.shared_folder(spark)
    made = [tables.publish(spark.range(k + 1), root, "t") for k in range(5)]
    spark.createDataFrame([(made[0],)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/t/current")  # rolled back
    assert sorted(tables.prune(spark, root, "t", 2)) == sorted(made[1:3])
    assert tables.current(spark, root, "t").count() == 1 and tables.prune(spark, root, "t", 2) == []


def test_labels_and_hops(spark):
    names = [("a", "fr", "x"), ("a", "en", " The  A "), ("b", "mul", "B"), ("b", "fr", "bb"), ("c", "fr", "long name"), ("c", "de", "long name"), ("c", "it", "short"), ("d", "fr", "zz"), ("d", "de", "aa"), ("e", "fr", " "), (None, "en", "n")]
    got = {r.item: r.label for r in tables.entity_labels(spark.createDataFrame(names, "item string, lang string, text string")).collect()}
    assert got == {"a": "The A", "b": "B", "c": "long name", "d": "aa"}
    facts = spark.createDataFrame([("i", "x", 1.0), ("i", "y", 0.5), ("j", "y", 1.0)], "item string, value string, multiplier double")
    triples = spark.createDataFrame([("x", "p", "z"), ("x", "p", "x"), ("y", "q", "z"), ("z", "p", "i"), ("z", "p", "w"), ("w", "p", "v"), ("y", "other", "u")], "item string, prop string, value string")
    hops = {(r.item, r.value): (r.multiplier, r.hops) for r in tables.typed_hops(facts, triples, {"p": 0.5, "q": 0.8}).collect()}
    assert hops == {("i", "x"): (1.0, 0), ("i", "y"): (0.5, 0), ("j", "y"): (1.0, 0), ("i", "z"): (0.5, 1), ("j", "z"): (0.8, 1), ("i", "w"): (0.25, 2), ("j", "w"): (0.4, 2), ("j", "i"): (0.4, 2)}
