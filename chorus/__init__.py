"""chorus: distributed analytics for short-text corpora and the accounts that write them.

Every public function takes and returns Spark DataFrames (or Columns) and builds a lazy
plan; nothing is collected to the driver except bounded model parameters and
small summaries.

Sub-packages:
  sources    - readers and writers (CSV directories, labelled lines, JSONC lists, sinks)
  functions  - column expressions (text cleaning, tokenising, vector arithmetic)
  operators  - relational, aggregate, ranking, evaluation, sampling, vector and ML operators
  plans      - composed queries over the driver tables and their DuckDB oracles
  streaming  - the stateless text functions applied to a streaming source
"""

from chorus.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
