"""Kernels have few functions at once; loops' bodies that walks take along rank paths as a join with the loops does."""

import pyarrow as pa

from graphloom.functions import kernels as K
from graphloom.operators import flow as O
from graphloom.plans.limits import QUICK
from graphloom.sources import flows as S

DIR = "/root/testdata/sf0.001"


def test_hot_paths_of_loops_fold_functions_once(spark):
    headed = O.with_headers(O.fold(*S.journey_flows(spark, DIR)))
    once = O.hot_paths(O.enumerate_paths(O.with_bodies(headed), QUICK, also=("tags", "bodies")), None, None, 5, 2.0)
    want = O.hot_paths(O.enumerate_paths(headed, QUICK), headed, O.natural_loops(headed), 5, 2.0).collect()
    assert want and sorted(map(str, once.collect())) == sorted(map(str, want))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_a_batch_is_taken_in_parts():
    b = pa.RecordBatch.from_pydict({"x": list(range(3 * K.ROWS + 1))})
    parts = list(K._few(iter([b, b.slice(0, 0)])))
    assert max(p.num_rows for p in parts) == K.ROWS and pa.Table.from_batches(parts) == pa.Table.from_batches([b])
