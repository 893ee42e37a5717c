"""All registered queries."""

from pathclear.queries import (  # noqa: F401
    chain_queries,
    frame_queries,
    neighbour_queries,
    point_queries,
    stateful_queries,
)
from pathclear.queries.registry import QUERIES, SQL  # noqa: F401
