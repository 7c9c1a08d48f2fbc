"""Imports of whole packages lead to products that are spread over tasks."""

from pyspark.sql import functions as F

from codegraph_spark.operators import relations as R
from codegraph_spark.operators import resolve as X


def test_product_of_one_package_is_spread(spark):
    """No task makes a package's whole product, and nothing of it is lost; imports of nothing stay."""
    imports = spark.range(5000).selectExpr("'r' AS repo", "concat('f', id) AS path", "'import_wildcard' AS kind", "IF(id < 4000, 'a.b', concat('no', id)) AS spec")
    names = spark.range(50).selectExpr("'r' AS repo", "concat('a.b.N', id) AS fqn", "concat('n', id) AS path")
    edges = X.resolve_wildcard(imports, names)
    assert edges.count() == 4000 * 50 + 1000 and edges.distinct().count() == 4000 * 50 + 1000
    assert edges.where("internal").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000 * 50
    outside = R.externals(X.resolve_wildcard(imports, names, packages=True).where("not internal"), names.selectExpr("repo", "path AS id"))
    assert outside.count() == 1000


def test_external_packages_makes_no_product(spark):
    """The query's plan meets packages, not their files."""
    from codegraph_spark.queries import QUERIES

    plan = QUERIES["external_packages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "package:" in plan and "__cg_share" not in plan


def test_products_move_few_rows(spark):
    """Of a package with many imports and files, a row is moved a few times, not once for each thousand rows of the other side."""
    asked = spark.range(40000).selectExpr("'r' AS repo", "concat('f', id) AS path", "'a.b' AS spec").union(spark.sql("SELECT 'r', 'g', 'none'"))
    members = spark.range(300).selectExpr("'r' AS repo", "'a.b' AS spec", "concat('n', id) AS hit")
    product = X._spread(asked, members, ["repo", "spec"])
    assert product.count() == 40000 * 300 + 1 and product.where("hit is null").collect()[0]["path"] == "g"
    assert product.distinct().count() == 40000 * 300 + 1
    grid = product._jdf.queryExecution().optimizedPlan()
    moved = [x for x in str(grid.toString()).split("\n") if "RepartitionByExpression" in x]
    assert len(moved) == 2 and all("__cg_row" in x and "__cg_share" in x for x in moved)
