from __future__ import annotations

from pagewright.operators import spatial


def test_links_that_differ_by_rounding_alone_are_ordered_as_by_the_sql(spark):
    box = "page long, id long, box struct<x:double,y:double,width:double,height:double>"
    places = lambda rows: spark.createDataFrame([(1, i, tuple(v / 100 for v in b)) for i, b in rows], box)
    texts, links = [(17244, (50, 67, 5, 2))], [(17244, (42, 67, 16, 3)), (17246, (47, 69, 10, 3))]
    (best,) = spatial.best_links(places(texts), places(links), ["page"]).collect()
    assert (best.link_id, round(best.score, 6)) == (17244, 1.242718)
