"""Running a numpy function on every row of a series table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def per_series_udf(function: Callable[..., dict], result: dict[str, pa.DataType]):
    """Arrow UDF of at least two columns: calls ``function`` with the row's values (arrays as numpy)
    and returns a struct of ``result`` fields plus ``error``.

    An exception in one series becomes that row's ``error``; the job goes on.
    """
    fields = {**result, "error": pa.string()}
    struct = pa.struct(list(fields.items()))

    @F.arrow_udf(from_arrow_type(struct))
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def cell(column, i):
            scalar = column[i]
            if not scalar.is_valid:
                return None
            if pa.types.is_list(column.type):
                return np.asarray(scalar.values.to_numpy(zero_copy_only=False))
            return scalar.as_py()

        def attempt(arguments):
            try:
                if any(a is None for a in arguments):
                    raise ValueError("no data")
                return function(*arguments)
            except Exception as failure:
                return {"error": f"{type(failure).__name__}: {failure}"}

        for columns in batches:
            rows = [attempt([cell(c, i) for c in columns]) for i in range(len(columns[0]))]
            arrays = [pa.array([row.get(name) for row in rows], type=kind) for name, kind in fields.items()]
            yield pa.StructArray.from_arrays(arrays, fields=list(struct))

    # Evaluated once: a deterministic function would be repeated for filters on its result.
    return run.asNondeterministic()


def require_finite(*histories) -> None:
    if not all(np.isfinite(h).all() for h in histories):
        raise ValueError("the series has missing or infinite values")
