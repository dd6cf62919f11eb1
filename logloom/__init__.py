"""logloom: log template mining on Spark DataFrames.

Layout
------
sources/    readers and writers (CSV logs, labelled examples, fixture log view)
functions/  Column expressions: message normalisation, masking, tokens, similarity
operators/  DataFrame operators: dedup, dictionary, clustering, sampling,
            catalog, matching joins, labelling, metrics
plans/      end-to-end jobs: rule parse, example sampling, catalog parse, evaluation
streaming/  Structured Streaming parse and first-seen state
"""

__all__ = ["session"]
