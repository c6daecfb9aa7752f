"""All queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quarry.plans import flows, lexical, more, vector

QUERIES: dict = lexical.Q | vector.Q | flows.Q | more.Q
ORACLES: dict = lexical.O | vector.O | flows.O | more.O
