"""Sources and sinks: directories, strings, Parquet corpora, foreign index files, text results."""
