"""codeloom: source-corpus analytics as Spark DataFrame operators.

A *file table* is any DataFrame with the columns

    path string, relative string, size bigint, mtime timestamp, content string|binary

(see ``codeloom.sources``).  Operators take DataFrames / Columns and return
DataFrames / Columns; nothing is collected to the driver.
"""

from codeloom.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
