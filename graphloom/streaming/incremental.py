"""Keeping a path store up to date from a stream of stored blocks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from graphloom.operators import flow
from graphloom.operators.compare import KEY, content_hashes
from graphloom.sources.path_store import PathStore

_GONE = "graphloom_gone"


class FunctionBlocks(StatefulProcessor):
    """A function's rows by block. A batch with any of them gives all that it has now; one without blocks, a row that says so."""

    def __init__(self, schema: StructType, block: str, order: str | None):
        self.schema, self.block, self.order = schema, block, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = StructType([StructField("block", self.schema[self.block].dataType)])
        self.blocks = handle.getMapState("blocks", key, self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        names = self.schema.fieldNames()
        row = Row(*names, _GONE)
        for r in sorted(rows, key=lambda r: (r[self.order] is not None, r[self.order])) if self.order else rows:
            place = (r[self.block],)
            if not r[_GONE]:
                self.blocks.updateValue(place, tuple(r[c] for c in names))
            elif place[0] is None:
                self.blocks.clear()
            elif self.blocks.containsKey(place):
                self.blocks.removeKey(place)
        some = False
        for value in self.blocks.values():
            some = True
            yield row(*value, False)
        if not some:
            yield row(*(key[0] if c == KEY else None for c in names), True)

    def close(self) -> None:
        pass


def whole_functions(stream: DataFrame, block: str, removed: str | None = None, order: str | None = None) -> DataFrame:
    """A stream in which each micro-batch has all rows of every function that it changes, and a boolean that says a
    function has none left.

    ``block`` is the column that tells a function's rows apart: a row takes the place of an earlier one. Where ``removed``
    holds it takes that away, or, without a block, all of its function's. Within a batch, rows of a function follow one
    another by ``order`` (nulls first); without it a batch must not have two rows of one block. State is a row per block.
    """
    rows = stream.where(f"{KEY} is not null").withColumn(_GONE, F.expr(f"coalesce({removed or 'false'}, false)")).where(f"`{block}` is not null or {_GONE}")
    out = StructType([*stream.schema.fields, StructField(_GONE, BooleanType())])
    return rows.groupBy(KEY).transformWithState(FunctionBlocks(stream.schema, block, order), out, "Append", "None")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gave its stream: another checkpoint, also in the same folder, is another stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def maintain_paths(
    stream: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], store: str, checkpoint: str, removed: str | None = None, block: str | None = None, order: str | None = None
) -> StreamingQuery:
    """Each micro-batch's functions are rebuilt by ``build``, and their paths, or that they have none, replace what the
    store has for them.

    Without ``block`` a micro-batch must have all rows of its functions, and rows for which the SQL condition ``removed``
    holds say that a function is gone. With it, functions may come in any number of batches: ``whole_functions`` keeps
    their rows, later ones by ``order`` (this needs RocksDB as the session's state store, which is set here).

    The store allots versions. A batch repeated after a failure is known by its stream and number and put once; streams
    with other checkpoints, whose numbers begin again, lose nothing of each other's.
    """
    spark = stream.sparkSession
    if block is not None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream, removed = whole_functions(stream, block, removed, order), _GONE

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read for marks and for paths: state must not be asked twice
        live = batch.where(f"not coalesce({removed}, false)") if removed else batch
        blocks, edges = build(live.drop(_GONE))
        headed = flow.with_headers(flow.fold(blocks, edges))
        marks = batch.select(KEY).distinct().join(content_hashes(blocks), KEY, "left").select(KEY, F.col("content_hash"))
        PathStore(batch.sparkSession, store).put(marks, flow.enumerate_paths(headed), number, _stream_id(batch.sparkSession, checkpoint))
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
