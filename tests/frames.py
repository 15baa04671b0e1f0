"""Tiny literal frames."""

from scenfold.functions.literals import literal_frame
from scenfold.model import SymbolCatalog


def frame(spark, schema, *rows):
    return literal_frame(spark, schema, rows)


def symbol(spark, dims, *rows):
    """Rows of (dims..., Value, Scenario); ``t`` and ``Year`` are integers."""
    names = dims.split()
    schema = ", ".join(f"{d} {'int' if d in ('t', 'Year') else 'string'}" for d in names)
    return frame(spark, f"{schema}, Value double, Scenario string", *rows)


def catalog(**frames):
    return SymbolCatalog(frames)


def values(df, *keys, value="Value"):
    """{key tuple (or single key): value}."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        key = key[0] if len(key) == 1 else key
        assert key not in out, f"duplicate {key}"
        out[key] = row[value]
    return out
