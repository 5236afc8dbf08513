"""What several test modules share."""


def by_id(df, *columns, key="source_row_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.select(key, *columns).collect()}
