"""SQL names of the functions: dta_format, dta_missing_tag, dta_missing_key, dta_label."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.formats import formatter
from ..sources.layout import MISSING_KEY, TAGS


def register_functions(spark: SparkSession, label_tables: dict[str, dict[int, str]] | None = None) -> None:
    """Arrow functions, so that SQL text can use them; Column expressions are the faster way in DataFrame code."""
    import numpy as np
    import pyarrow as pa

    from ..sources.codec import missing_offsets
    from ..sources.layout import NUMERIC

    tables = label_tables or {}

    def dta_format(values, formats):
        known: dict = {}
        out = []
        for x, f in zip(values.to_pylist(), formats.to_pylist()):
            if f is not None and f not in known:
                known[f] = formatter(f)
            out.append(None if x is None or f is None else known[f](float(x)))
        return pa.array(out, pa.string())

    def dta_missing_tag(values, storage):
        out: list = [None] * len(values)
        cells, kinds = values.to_pylist(), storage.to_pylist()
        for kind in set(kinds) & set(NUMERIC):
            code = NUMERIC[kind][1]
            at = [i for i, (x, k) in enumerate(zip(cells, kinds)) if k == kind and x is not None and (code[0] == "u" or (x == x and abs(x) < 2**53))]
            x = np.array([cells[i] for i in at], float)
            k = missing_offsets(x.astype(np.int64) if code[0] == "i" else x.astype("f" + code[1]).view(code), kind)
            for i, n in zip(at, k.tolist()):
                out[i] = TAGS[n] if 0 <= n <= 26 else None
        return pa.array(out, pa.string())

    def dta_missing_key(tags):
        keys = {t: MISSING_KEY + i for i, t in enumerate(TAGS)}
        return pa.array([keys.get(t) for t in tags.to_pylist()], pa.int32())

    def dta_label(names, keys):
        return pa.array([None if k is None else tables.get(n, {}).get(k) for n, k in zip(names.to_pylist(), keys.to_pylist())], pa.string())

    for f, kind in ((dta_format, "string"), (dta_missing_tag, "string"), (dta_missing_key, "int"), (dta_label, "string")):
        spark.udf.register(f.__name__, F.arrow_udf(f, kind))
