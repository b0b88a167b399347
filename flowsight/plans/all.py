"""Import every query module so the registry is complete.  The Spark ML
queries are registered last: they are the most memory-hungry, so everything
else has run before them in a sequential driver."""
from flowsight.plans import attack_q, behavior_q, clean_q, features_q, graph_q, io_q, metrics_q  # noqa: F401
from flowsight.plans import given_q, reports_q, streaming_q  # noqa: F401
from flowsight.plans import learned_q  # noqa: F401
from flowsight.plans import ml_q  # noqa: F401,E402
from flowsight.plans.registry import ORACLE, QUERIES  # noqa: F401
