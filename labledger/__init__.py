"""labledger: purchase-order analytics as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame (+ params) -> DataFrame``; the
physical plan is left to Catalyst and AQE.
"""

from labledger.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
