"""All registered queries: importing a module registers what it holds."""

from skytally.plans import q_ledger, q_markets, q_ml, q_observations, q_payloads, q_reports, q_streams, q_ticks  # noqa: F401
from skytally.plans.registry import ORACLE, QUERIES  # noqa: F401
