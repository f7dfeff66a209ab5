"""Where graphs come from and go to: tables in memory, folders of Parquet tables, a database."""
