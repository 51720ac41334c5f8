import json

import pytest

from graphloom.sources import flows, path_store
from graphloom.sources.path_store import PathStore
from graphloom.streaming import incremental


def test_path_cache_follows_a_stream(spark, tmp_path):
    schema = "function_id long, id long, kind string, terminator string"
    src, cache = f"{tmp_path}/in", f"{tmp_path}/cache"

    def build(batch):
        blocks = flows.decode_blocks(batch, ["id"])
        return blocks, flows.derive_edges(blocks)

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = incremental.maintain_paths(spark.readStream.schema(schema).parquet(src), build, cache, f"{tmp_path}/check", "kind = 'removed'")
        q.awaitTermination()

    def paths():
        return sorted((r.function_id, list(r.blocks)) for r in PathStore(spark, cache).paths().collect())

    feed([(1, 0, "entry", "goto"), (1, 1, "return", "return"), (2, 0, "entry", "return")])
    assert paths() == [(1, [0, 1]), (2, [0])]
    feed([(1, 0, "entry", "conditional"), (1, 1, "x", "panic"), (1, 2, "return", "return")])
    assert paths() == [(1, [0, 1]), (1, [0, 2]), (2, [0])]
    # function 1 loses its only exit, function 2 goes
    feed([(1, 0, "entry", "goto"), (1, 1, "x", "goto"), (2, 0, "removed", None), (3, 0, "entry", "return")])
    assert paths() == [(3, [0])]


def test_store_round_trip(spark, tmp_path):
    store, schema = PathStore(spark, f"{tmp_path}/store"), "function_id long, path_id string, path_kind string, blocks array<int>"
    marks = lambda *f: spark.createDataFrame([(x, f"h{x}") for x in f], "function_id long, content_hash string")
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: sorted((r.function_id, r.path_id, r.path_kind, r.entry, r.exit, list(r.blocks)) for r in store.paths().collect())
    assert read() == [] and store.next_epoch() == 1
    long = list(range(50))
    store.put(marks(1, 2), rows((1, "a", "Normal", [0, 1]), (1, "b", "Error", [0, 2]), (2, "a", "Normal", long)), store.next_epoch())
    assert read() == [(1, "a", "Normal", 0, 1, [0, 1]), (1, "b", "Error", 0, 2, [0, 2]), (2, "a", "Normal", 0, 49, long)]
    store.put(marks(1), rows((1, "c", "Degenerate", [0, 3])), store.next_epoch())
    store.invalidate(marks(2), store.next_epoch())
    assert read() == [(1, "c", "Degenerate", 0, 3, [0, 3])]
    assert {r.function_id for r in store.marks().where("content_hash is null").collect()} == {2}


SCHEMA = "function_id long, path_id string, path_kind string, blocks array<int>"


def store_of(spark, folder):
    marks = lambda *f: spark.createDataFrame([(x, f"h{x}") for x in f], "function_id long, content_hash string")
    one = lambda f, *blocks: (marks(f), spark.createDataFrame([(f, "p", "Normal", list(blocks))], SCHEMA))
    return PathStore(spark, folder), one, lambda s: sorted((r.function_id, list(r.blocks)) for r in s.paths().collect())


def test_writers_lose_nothing_to_each_other(spark, tmp_path, monkeypatch):
    store, one, read = store_of(spark, f"{tmp_path}/store")
    assert store.put(*one(1, 0), 1) == 1 and store.put(*one(2, 0), 2) == 2
    assert store.put(*one(3, 0), 1) == 3  # another writer's first
    assert read(store) == [(1, [0]), (2, [0]), (3, [0])]
    assert store.put(*one(4, 0), 0, "a") == 4 and store.put(*one(4, 9), 0, "a") is None and store.put(*one(5, 0), 0, "b") == 5
    assert read(store)[3:] == [(4, [0]), (5, [0])]
    fixed = store.at(5)
    store.put(*one(1, 7))
    assert read(fixed)[0] == (1, [0]) and read(store)[0] == (1, [7])
    assert read(store.at(0)) == []
    # a number that a writer took and never wrote to is passed over
    monkeypatch.setattr(path_store, "WAIT", 0.2)
    (tmp_path / "store/versions" / f"{7:012d}").touch()
    assert store.put(*one(6, 0)) == 8 and read(store)[-1] == (6, [0])


def test_slow_writer_is_joined(spark, tmp_path, monkeypatch):
    """A version that was passed over and is written after all is found by who passed it."""
    store, one, read = store_of(spark, f"{tmp_path}/store")
    monkeypatch.setattr(path_store, "WAIT", 0.2)
    store.put(*one(1, 0))
    name = next((tmp_path / "store/parts").iterdir()).name
    late = tmp_path / "store/versions" / f"{2:012d}"
    late.touch()
    create, slow = store._entry(1), PathStore(spark, f"{tmp_path}/store")
    slow._write("late", *one(2, 5)[:1], path_store.path_elements(one(2, 5)[1]))
    mend = store._mend

    def written_now(*a):
        late.write_text(json.dumps({"parts": [*create["parts"], [2, "late"]], "writers": {}}))
        (tmp_path / "store/versions" / f".{2:012d}.crc").unlink(missing_ok=True)
        mend(*a)

    monkeypatch.setattr(store, "_mend", written_now)
    store.put(*one(3, 0))
    monkeypatch.undo()
    assert name and read(store) == [(1, [0]), (2, [5]), (3, [0])]


def test_compaction_keeps_what_is_valid_and_bounds_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(path_store, "PARTS", 3)
    store, one, read = store_of(spark, f"{tmp_path}/store")
    want = {}
    for k in range(9):
        store.put(*one(k % 4, k), k, "w")
        want[k % 4] = [k]
        assert len(store._parts()) <= 4 and read(store) == sorted(want.items())
    store.invalidate(spark.createDataFrame([(2,)], "function_id long"))
    store.compact()
    del want[2]
    assert len(store._parts()) == 1 and read(store) == sorted(want.items())
    assert store.put(*one(0, 99), 8, "w") is None  # known after compactions too
    store.expire()
    assert len(store.versions()) == 1 and len(list((tmp_path / "store/parts").iterdir())) == 1 and read(store) == sorted(want.items())
    assert [r.function_id for r in store.paths([3, 77]).collect()] == [3]
    with pytest.raises(ValueError):
        store.at(1)


def test_functions_in_parts_across_batches_and_restarts(spark, tmp_path):
    schema, src, folder = "function_id long, id long, kind string, terminator string, seq int", f"{tmp_path}/in", f"{tmp_path}/store"
    fed = 0

    def build(batch):
        blocks = flows.decode_blocks(batch, ["id"])
        return blocks, flows.derive_edges(blocks)

    def feed(rows, check="check"):
        nonlocal fed
        fed += 1
        if rows:
            spark.createDataFrame([(*r, fed) for r in rows], schema).coalesce(1).write.mode("append").parquet(src)
        incremental.maintain_paths(spark.readStream.schema(schema).parquet(src), build, folder, f"{tmp_path}/{check}", "kind = 'removed'", "id", "seq").awaitTermination()
        return sorted((r.function_id, list(r.blocks)) for r in PathStore(spark, folder).paths().collect())

    assert feed([(1, 0, "entry", "goto"), (1, 1, "x", "goto"), (2, 0, "entry", "return")]) == [(2, [0])]
    assert feed([(1, 2, "x", "goto"), (1, 3, "return", "return")]) == [(1, [0, 1, 2, 3]), (2, [0])]
    assert feed([(1, 1, "x", "conditional"), (None, 0, "entry", "return")]) == [(1, [0, 1, 2, 3]), (1, [0, 1, 3]), (2, [0])]
    assert feed([(1, 2, "removed", None), (2, None, "removed", None)]) == [(1, [0, 1, 2])]
    # a new checkpoint begins with batch 0 again
    PathStore(spark, folder).put(spark.createDataFrame([(9, "h")], "function_id long, content_hash string"), spark.createDataFrame([(9, "p", "Normal", [0])], SCHEMA))
    assert feed([], "other") == [(1, [0, 1, 2]), (9, [0])]
