"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import curation_queries, evaluation_queries, request_queries, stateful_queries, text_queries

QUERIES = {**curation_queries.QUERIES, **evaluation_queries.QUERIES, **text_queries.QUERIES, **stateful_queries.QUERIES, **request_queries.QUERIES}
ORACLES = {**curation_queries.ORACLES, **evaluation_queries.ORACLES, **text_queries.ORACLES, **stateful_queries.ORACLES, **request_queries.ORACLES}
