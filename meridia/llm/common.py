"""What the operators of this subpackage share: row keys, words, and the tables they write."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.operators import shared
from meridia.operators.shared import connected_components, discard, skew_join

__all__ = ["connected_components", "discard", "skew_join", "materialise", "tables_made", "with_row_key", "in_parts", "met_in_groups", "give_back", "fields", "restored", "sent_if_few", "without_rows", "text_or_empty", "table"]

#: What separates words everywhere here: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


#: The columns of with_row_key.
ROW, DOC = "_row", "_doc"
#: Files that with_row_key numbers, and the most bytes of a table that is sent to all tasks.
MOST_FILES, SENT_BYTES = 100_000, 64 << 20


#: The lists that record what is written, innermost last; each thread has its own.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    out, path = shared.stored(df)
    for made in _recorders.get():
        made.append(path)
    return out


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that materialise writes meanwhile, in this thread."""
    made: list[str] = []
    token = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(token)


def with_row_key(docs: DataFrame) -> DataFrame:
    """_row, another number for every row, that stays as it is, and _doc, a struct of docs' own
    columns, whose names can so clash with none. Where docs is nothing but parquet files
    that are read, as in the pipeline, a row's file and its place there make the key and
    nothing is copied; else the rows are written with their keys."""
    key = F.monotonically_increasing_id()
    scanned = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and docs._jdf.queryExecution().analyzed().simpleString(1000).endswith("parquet")
    if scanned and "_metadata" not in docs.columns and len(docs.inputFiles()) <= MOST_FILES:
        # one row a file
        files = sorted(r["f"] for r in docs.select(F.col("_metadata.file_path").alias("f")).distinct().collect())
        numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_f string, _n long")
        placed = docs.select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"), F.struct(*docs.columns).alias(DOC))
        return placed.join(F.broadcast(numbers), "_f").select((F.shiftleft("_n", 40) + F.col("_i")).alias(ROW), DOC)
    return materialise(docs.select(key.alias(ROW), F.struct(*docs.columns).alias(DOC)))


def sent_if_few(rows: DataFrame, bytes_a_row: int) -> DataFrame:
    """A table from materialise, marked to be sent to all tasks if it is of SENT_BYTES at most;
    a larger one is left for a shuffled join."""
    return F.broadcast(rows) if rows.count() * bytes_a_row <= SENT_BYTES else rows


def without_rows(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """keyed without the rows of ``dropped`` (_row, from materialise): texts stay where they are
    unless the dropped rows are too many to send."""
    return keyed.join(sent_if_few(dropped.select(ROW), 32), ROW, "left_anti")


def fields(keyed: DataFrame, *names: str) -> DataFrame:
    """_row and some of the columns of a keyed table; no others are read."""
    return keyed.select(ROW, *[F.col(f"{DOC}.{n}").alias(n) for n in names])


def restored(keyed: DataFrame) -> DataFrame:
    """docs' own columns of a keyed table."""
    return keyed.select(f"{DOC}.*")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(rows: DataFrame, keys: list[str], ident: str, cell: int) -> DataFrame:
    """The rows of cells (equal ``keys``) that hold more than one row, with own, i and j: a
    cell of over ``cell`` rows is cut into parts, and each pair of parts i <= j is a group of
    its own, in which own says whose part a row is. Groups hold about 2 x cell rows at most."""
    crowded = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*keys, F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(ident), F.col("parts")).cast("int")
    pairs = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, own) as i, greatest(x, own) as j))")
    dealt = skew_join(rows, crowded, keys, "inner").withColumn("own", own).withColumn("p", F.explode(pairs))
    return dealt.withColumns({"i": F.col("p.i"), "j": F.col("p.j")}).drop("p", "parts")


def met_in_groups(held: DataFrame, sent: DataFrame, spots: Column, groups: int) -> DataFrame:
    """Rows in which ``held`` (g and a binary column) and the rows of ``sent``, one copy for each
    group number of ``spots``, come group by group, sorted, what is held first: a task that
    reads them in turn holds one group's ``held`` and lets any number of sent rows pass. For
    a stated set of queries against all rows, in blocks. Columns of the other kind are null."""
    (block,) = [c for c in held.columns if c != "g"]
    a = held.select("g", F.lit(0).alias("kind"), block, *[F.lit(None).cast(t).alias(c) for c, t in sent.dtypes])
    b = sent.withColumn("g", F.explode(spots)).select("g", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias(block), *sent.columns)
    return a.unionByName(b).repartition(groups, "g").sortWithinPartitions("g", "kind")


def give_back() -> None:
    """Returns to the system what this worker has freed: workers live through many stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()
