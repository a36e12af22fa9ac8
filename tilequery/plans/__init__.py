"""Registered queries over the given tables, with their reference SQL."""


def all_queries():
    """``(queries, sql)`` of every query module."""
    from tilequery.plans import (  # noqa: F401
        image_queries,
        model_queries,
        scene_queries,
        selection_queries,
        trajectory_queries,
        triplet_queries,
    )
    from tilequery.plans.registry import QUERIES, SQL

    return QUERIES, SQL
