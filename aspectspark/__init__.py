"""Spark-native engine for multi-label aspect/polarity annotation data.

Sub-packages:

* ``sources``   -- JSONL / CSV readers and writers, driver-table fixtures
* ``functions`` -- Column-level helpers (taxonomy codes, vectors, prompts)
* ``operators`` -- DataFrame -> DataFrame operators (labels, joins, metrics,
  sampling, voting, tokens)
* ``plans``     -- composite jobs (dataset build, cascade, ensemble, report,
  training)
* ``streaming`` -- Structured Streaming entry points for inference
"""

__version__ = "0.1.0"
