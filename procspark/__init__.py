"""DataFrame operators for process-mining and multilingual text tables.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until the caller writes or reads the result, apart from
the few places that say so in their docstring.
"""

from procspark.session import build_session

__all__ = ["build_session"]
