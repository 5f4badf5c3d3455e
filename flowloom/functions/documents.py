"""Row functions over whole documents: one shuffle by document, one ordered scan, no group objects.

For searches that follow a document's own graph and that joins can't express without quadratic rows. A task
holds one document at a time; what a function returns leaves in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

_ROWS = 20_000


def keyed(c: str) -> Column:
    """A value of any type as text that is equal where the value is."""
    return F.to_json(F.struct(F.col(c).alias("v")))


def value_of(key: str, kind: DataType) -> Column:
    """The value of type ``kind`` that :func:`keyed` made a key of."""
    return F.from_json(key, StructType().add("v", kind))["v"]


def by_document(rows: DataFrame, run: Callable, schema: str, order: tuple[str, ...], streamed: str | None = None) -> DataFrame:
    """``doc_id`` and the columns of ``schema``: what ``run`` yields for each document of ``rows``.

    ``run`` takes the document's columns as lists, in the order of ``rows.columns`` without ``doc_id``, and
    yields tuples. With ``streamed``, a column that is 0 or 1, only the rows where it is 0 are held: ``run``
    takes these and returns a function, which takes piece after piece of the others and yields tuples.
    """
    kind = rows.schema["doc_id"].dataType
    out = StructType().add("doc_id", kind)
    for f in StructType.fromDDL(schema):
        out.add(f)
    arrow = to_arrow_schema(out)
    names = [c for c in rows.columns if c != "doc_id"]
    later = None if streamed is None else names.index(streamed)

    def documents(batches) -> Iterator[tuple]:
        """(first piece of the document, its id, columns) for the runs of rows in each batch."""
        last = None
        for b in batches:
            ids, *columns = (c.to_pylist() for c in b.columns)
            at = 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                yield last is None or last[0] != ids[at], ids[at], [c[at:end] for c in columns]
                last, at = (ids[at],), end

    def found(batches) -> Iterator[tuple]:
        held, doc, answer = None, None, None
        for new, doc_id, columns in documents(batches):
            if new:
                if held is not None and later is None:
                    yield from ((doc, *row) for row in run(*held))
                held, doc, answer = [[] for _ in names], doc_id, None
            cut = len(columns[0]) if later is None else columns[later].count(0)
            for whole, c in zip(held, columns):
                whole.extend(c[:cut])
            if later is not None and cut < len(columns[0]):
                answer = answer or run(*held)
                yield from ((doc, *row) for row in answer(*(c[cut:] for c in columns)))
        if held is not None and later is None:
            yield from ((doc, *row) for row in run(*held))

    def scan(batches):
        ready = []
        for row in found(batches):
            ready.append(row)
            if len(ready) == _ROWS:
                yield _batch(ready, arrow)
                ready = []
        if ready:
            yield _batch(ready, arrow)

    keys = ["doc_id", *([streamed] if streamed else []), *order]
    return rows.select("doc_id", *names).repartition("doc_id").sortWithinPartitions(*keys).mapInArrow(scan, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
