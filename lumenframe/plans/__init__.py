"""Registered queries and their SQL counterparts."""

from . import adapter, contracts, exposure, files, images, logs, manifests, rendering, streams  # noqa: F401  they register themselves
from .images import q_decode_full as flagship  # noqa: F401
from .registry import ORACLE, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(ORACLE)
