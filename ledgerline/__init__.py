"""ledgerline: Spark-native analytics over company financial-statement panels.

Layout
------
sources/    readers: driver tables, the derived (ticker, quarter) panel, files, statements
functions/  column-expression builders (parsers, growth maths, safe casts)
operators/  DataFrame -> DataFrame operators (clean, aggregates, windows, profiling, ...)
plans/      composed jobs and the query registry checked against SQL oracles
streaming/  incremental upload ingest with Structured Streaming
"""

from ledgerline.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
