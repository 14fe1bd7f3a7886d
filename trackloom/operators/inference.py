"""A model over rows: the caller's function on batches, which are halved where it fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_model(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 32) -> DataFrame:
    """The rows with the columns of ``schema``, which the model gives, and ``error``, null where it did.

    ``make`` is called once in each task and gives the model: a function of a frame of rows to a frame of as many, in their order.
    It gets up to ``batch`` rows at once. Where it fails, or gives another number of rows, each half is tried by itself, down to
    single rows: only those that fail alone have an error and nulls. Names of the schema that the rows have already are
    replaced. Rows keep their order within a task.
    """
    new = [c.split()[0] for c in schema.split(",")]
    given = rows.columns
    kept = [c for c in given if c.lower() not in {n.lower() for n in (*new, "error")}]
    plain = {c: f"c{k}" for k, c in enumerate(given)}  # mapInPandas takes a dot in a name for a field's
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = "".join(f"{plain[c]} {kinds[c]}, " for c in kept)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def tried(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            try:
                out = model(f)
                if len(out) != len(f):
                    raise ValueError(f"{len(out)} results for {len(f)} rows")
                yield f[kept].assign(**{c: out[c].to_numpy() for c in new}, error=None)
            except Exception as e:
                if len(f) == 1:
                    yield f[kept].assign(**dict.fromkeys(new), error=f"{type(e).__name__}: {e}")
                    return
                half = len(f) // 2
                yield from tried(f.iloc[:half])
                yield from tried(f.iloc[half:])

        for f in frames:
            f.columns = given
            for k in range(0, len(f), batch):
                for out in tried(f.iloc[k : k + batch]):
                    yield out.rename(columns={c: plain[c] for c in kept})

    out = rows.toDF(*plain.values()).mapInPandas(work, f"{names}{schema}, error string")
    return out.select(*[F.col(plain[c]).alias(c) for c in kept], *new, "error")
