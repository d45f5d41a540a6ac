"""Jobs on pixel, palette and ledger tables: DataFrames in, DataFrames out."""
