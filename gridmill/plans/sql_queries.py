"""Queries written in SQL with the registered functions. Each has the same rows as its DataFrame form, and the same SQL to check it."""

from __future__ import annotations

from gridmill import registry
from gridmill.functions import sql
from gridmill.plans import line_queries, rule_queries, shape_queries  # noqa: F401  their SQL is used
from gridmill.plans.views import table
from gridmill.registry import query


def _like(name):
    """Register a query that is checked by another one's SQL."""

    def add(f):
        query()(f)
        registry.ORACLE_SQL[f.__name__] = registry.ORACLE_SQL[name]
        return f

    return add


@_like("utm_scene_transform")
def sql_scene_transform(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT node_id, ROUND(p.x, 2) AS x, ROUND(p.z, 2) + 0 AS z
           FROM (SELECT node_id, scene_point(-117.1225D + x * 1e-6, 33.0165D - z * 1e-6, -117.1225D, 33.0165D) AS p FROM {nodes}) t""",
        nodes=table(spark, sf_dir, "nodes"),
    )


@_like("inside_area_fraction")
def sql_inside_area_fraction(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT box_id, ROUND(inside_fraction(ring, 2e3D, 1e2D, 6e3D, 8e2D), 6) AS share FROM {rings}", rings=shape_queries._ring(spark, sf_dir))


@query("SELECT box_id, 1e0 AS rect FROM {boxes}")
def sql_rectangularity(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT box_id, ROUND(rectangularity(ring), 6) AS rect FROM {rings}", rings=shape_queries._ring(spark, sf_dir))


@_like("offset_points")
def sql_points_along(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT trip, n, ROUND(p.x, 2) + 0 AS x, ROUND(p.z, 2) + 0 AS z
           FROM (SELECT trip, TRANSFORM(ARRAY_SORT(COLLECT_LIST(STRUCT(step, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z))), s -> STRUCT(s.x, s.z)) AS line FROM {path} GROUP BY trip) t, LATERAL points_along(line, 777D, 6D) AS p""",
        path=line_queries._path(spark, sf_dir),
    )
