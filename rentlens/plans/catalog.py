"""All registered queries.  Importing this module fills the registry."""

from rentlens.plans import drift_queries, io_queries, listing_queries, model_queries, stream_queries  # noqa: F401
from rentlens.plans.registry import ORACLES, QUERIES  # noqa: F401
