"""The registered queries restated as DuckDB SQL over the same Parquet tables."""
