"""How the page queries deal their work."""

from mizan.plans import page_queries


def test_pages_of_one_row_group_are_made_by_all_cores(spark, small):
    made = page_queries._with_pages(spark, small, [], "p_name").where(f"page_id >= {page_queries._MADE}")
    held = [len(rows) for rows in made.rdd.glom().collect() if rows]
    assert sum(held) == spark.read.parquet(f"{small}/part.parquet").count()
    assert len(held) >= spark.sparkContext.defaultParallelism
