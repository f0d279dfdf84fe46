"""Relations as ordered lines of JSON, written by range partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fingerprint import ordered_digest


def write_ordered(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Writes a line per row, in order over all part files, and returns n and digest of the sequence.

    Rows are dealt by ranges of the order (and of the line, among equals), so no task holds more than
    its range and nothing passes through the driver; the bytes of the part files, one after the
    other, and the digest are the same at any number of partitions.
    """
    keys = [f"key{i}" for i in range(len(order))]
    held = rows.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.to_json(F.struct(*rows.columns)).alias("line"))
    held.orderBy(*keys, "line").select("line").write.mode("overwrite").text(folder)
    return ordered_digest(held, keys)


def print_object(relations: dict[str, DataFrame], single: tuple[str, ...], out: TextIO) -> None:
    """One JSON object with a list for each relation (an object for those of one row), a partition at a time."""

    def shown(rows: DataFrame) -> Iterator[str]:
        for line in rows.toJSON().toLocalIterator():
            yield json.dumps(json.loads(line), indent=2, ensure_ascii=False)

    out.write("{")
    for i, (name, rows) in enumerate(relations.items()):
        out.write(f"{',' if i else ''}\n  {json.dumps(name)}: ")
        if name in single:
            out.write(next(shown(rows)).replace("\n", "\n  "))
            continue
        some = False
        for text in shown(rows):
            out.write(("," if some else "[") + "\n    " + text.replace("\n", "\n    "))
            some = True
        out.write("\n  ]" if some else "[]")
    out.write("\n}\n")
