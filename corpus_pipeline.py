"""The corpus pipeline: STAGES over the documents table, in this order, each written as Parquet and read again by the next.

The stages themselves, with what they do with nulls, ties, repeated and very long rows, are in stratagraph.llm.stages.
"""

from __future__ import annotations

from stratagraph.llm.stages import STAGES, run

#: The stages learn filters, link sets and encode with a library's model, which SQL can't express.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
