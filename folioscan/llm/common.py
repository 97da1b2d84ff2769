"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.shipping import ship

#: ASCII white space; what the contracts call a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent (local tests) a folder below the warehouse is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/folioscan-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def held_out(column: str, modulus: int, is_: int) -> Column:
    """True where the remainder is ``is_``; a null id is never held out."""
    return F.coalesce(remainder(column, modulus) == is_, F.lit(False))


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    setup: Callable[[], Callable[[list[bytes], pa.RecordBatch], dict[str, object]]],
    schema: str,
    rows: int = 256,
    text: str = "text",
) -> DataFrame:
    """One output row per input row: ``keep`` columns as they are, the others computed from ``text``.

    ``setup`` runs once per task and returns ``compute(texts, part)``, which gets the UTF-8 bytes
    (null: empty) of at most ``rows`` rows and returns the new columns in ``schema``'s order.
    A kept column of a computed one's name gives way to it. Spark bounds an Arrow batch by rows and bytes, so a
    task holds one batch and its results.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    columns = [f.name for f in new.fields]
    names = [k for k in keep if k not in columns]
    out = T.StructType([df.schema[k] for k in names] + list(new.fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        compute = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                got = compute(texts, part)
                arrays = [part.column(n) for n in names]
                arrays += [pa.array(got[c], type=arrow.field(c).type) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [a.cast(arrow.field(i).type) for i, a in enumerate(arrays)], schema=arrow
                )

    return df.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, out)


def fold_texts(df: DataFrame, keep: Sequence[str], setup, schema: str, rows: int = 1024) -> DataFrame:
    """Partial aggregation in Python: ``setup`` returns ``(take, drain)``.

    ``take(texts, part)`` folds rows into bounded task state and may return rows to emit early;
    ``drain()`` returns what is left. Rows are dicts of columns in ``schema``.
    """
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema)
    columns = [f.name for f in out.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        take, drain = setup()

        def made(got):
            return pa.RecordBatch.from_arrays(
                [pa.array(got[c], type=arrow.field(c).type) for c in columns], schema=arrow
            )

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                if (got := take(texts, part)) is not None:
                    yield made(got)
        if (got := drain()) is not None:
            yield made(got)

    return df.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, out)
