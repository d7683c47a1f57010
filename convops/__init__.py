"""convops — set-at-a-time analytics for a conversational-assistant platform, on Spark.

Layout:
  sources/    typed platform tables: schemas + key metadata, binding from the raw test tables, versioned store
  functions/  column-level helpers (code -> label, blank -> NULL, portable date formats)
  operators/  reusable set-at-a-time building blocks (existence flags, ordered reasons, skew-safe ranking, ids)
  plans/      reports, business-rule jobs, integrity audits, request tables
  streaming/  the online form of the message rate limiter
"""

from convops.session import get_session, checkpoint_dir  # noqa: F401
