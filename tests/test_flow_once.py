"""Functions folded once: what walks take along gives the same rows as a join with the functions."""

from graphloom.operators import compare as D
from graphloom.operators import flow as O
from graphloom.plans.limits import QUICK
from graphloom.sources import flows as S

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_walks_take_along_what_is_asked_of_paths(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_LINES", 500)
    flow = O.without_loops(O.fold_stored(S.order_blocks(spark, DIR)))
    arrays = S.order_arrays(spark, DIR)
    assert arrays.rdd.getNumPartitions() > 10  # tasks grow in number, not in size
    light = O.without_loops(O.fold_arrays(arrays, walks_only=True))
    paths = O.enumerate_paths(flow)
    assert rows(O.hot_paths(O.enumerate_paths(light, also=("tags",)), None, None)) == rows(O.hot_paths(paths, flow, None))
    whole = O.enumerate_paths(O.without_loops(O.fold_arrays(arrays)), also=O.FEASIBLE_BY)
    assert rows(O.feasible_paths(whole, None)) == rows(O.feasible_paths(paths, flow))
    assert rows(O.hotspots_of_flow(light, QUICK)) == rows(O.hotspots(O.enumerate_paths(flow, QUICK, dead_ends=False), flow))


def test_supergraph_of_given_functions(spark):
    calls = spark.createDataFrame([(k, k + 3) for k in range(0, 60, 3)], "caller long, callee long")
    entries = spark.createDataFrame([(0,), (30,)], "function_id long")
    found = D.called_within(calls, entries)
    own = S.order_blocks(spark, DIR, functions=found)
    assert {r.function_id for r in own.collect()} <= {0, 3, 6, 9, 30, 33, 36, 39}
    want = D.icfg(*S.order_flows(spark, DIR), calls, entries)
    got = D.icfg(own, S.derive_edges(own), calls, entries, found=found)
    assert [rows(x) for x in got] == [rows(x) for x in want]
