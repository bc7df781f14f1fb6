"""custlens: customer-behaviour analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; fitted state is a
small DataFrame (or a Spark ML model) rather than a local object.
"""

from custlens.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
