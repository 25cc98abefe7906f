"""Rows of either engine, made comparable."""


def comparable(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(tuple(comparable(r[i]) for i in at) for r in rows)
