"""Table operators: `DataFrame -> DataFrame` functions that compose with `df.transform`."""
