"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from sievelog.plans import alerting, detection, features, parsing, streams, traffic

_MODULES = (parsing, features, detection, alerting, traffic, streams)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
