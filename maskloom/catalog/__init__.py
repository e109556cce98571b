"""Registered queries: the operators applied to the driver tables, next to equivalent SQL."""

from maskloom.catalog.common import QUERIES, Query


def registered() -> dict[str, Query]:
    from maskloom.catalog import (  # noqa: F401
        array_queries,
        loop_queries,
        metric_queries,
        registry_queries,
        split_queries,
    )

    return dict(QUERIES)
