"""The queries on shots over small tables of orders and lines."""

from kairoframe.plans import extras, reporting

_LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"


def tables(spark, folder, lines, orders):
    spark.createDataFrame(lines, _LINE).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_equal_shots_go_by_supplier(spark, tmp_path):
    same = [(1, 14, s, 2, 100.0, 0.1, flag, "F") for s, flag in ((9, "R"), (5, "A"), (7, "R"))]
    for i, lines in enumerate((same, same[::-1])):
        d = tables(spark, tmp_path / str(i), lines, [(1, 3, "F")])
        assert [tuple(r) for r in extras.compact_shots(spark, d).collect()] == [(3, 3, "forehand-loop,backhand-loop,backhand-loop")]


def test_findings_join_shots_once(spark, tmp_path):
    lines = [(o, 4, 1, 1, 100.0, 0.1, "A", "F") for o in range(1, 5)] + [(o, 5, 2, 2, 100.0, 0.1, "A", "O") for o in range(1, 5)]
    d = tables(spark, tmp_path, lines, [(o, 3, "O") for o in range(1, 5)])
    tips = reporting.coaching_tips(spark, d)
    assert [tuple(r) for r in tips.collect()] == [(3, "Backhand is under-used; Weight falling backwards at contact; Balance at contact; Errors into the net")]
    assert tips._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
