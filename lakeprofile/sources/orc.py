"""ORC footers of many files: no stripes are read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import orc
from pyspark.sql import DataFrame

from lakeprofile.session import spread
from lakeprofile.sources.storage import Storage

FOOTER = "path string, row_count bigint, compression string, fields array<struct<name:string,type:string,nullable:boolean>>, error string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    storage = Storage()
    for batch in batches:
        for path in batch["path"]:
            try:
                with storage.open(path) as handle:
                    file = orc.ORCFile(handle)
                    fields = [{"name": field.name, "type": str(field.type), "nullable": field.nullable} for field in file.schema]
                    row = (path, file.nrows, file.compression, fields, None)
            except Exception as problem:
                row = (path, None, None, None, str(problem))
            yield pd.DataFrame([row], columns=["path", "row_count", "compression", "fields", "error"]).astype({"row_count": "Int64"})


def footers(files: DataFrame) -> DataFrame:
    """``path, row_count, compression, fields, error`` per ORC file in column ``path``."""
    return spread(files.select("path"), "path").mapInPandas(_read, FOOTER)
