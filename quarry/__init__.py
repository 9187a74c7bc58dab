"""quarry: regular-expression search over document corpora, built on PySpark."""
