"""Wall times of the headline queries, as one JSON line.

``BENCH_SF_DIR`` names the test-data folder, ``BENCH_CPUS`` the number of local cores. The review
tables are written once first (reported as ``load_tables``), as the compared timings are taken on
loaded tables; every query then runs from these files to a full result.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from checks.lexicon import LEXICON
from checks.queries import busiest_business, busiest_user
from checks.tables import base, derive
from reviewgraph.operators import documents as D
from reviewgraph.operators import mining as M
from reviewgraph.operators import profiles as P
from reviewgraph.operators import reduction as C
from reviewgraph.operators import validation as V
from reviewgraph.operators.graph import path_to_root, restaurant_graph, user_graph
from reviewgraph.operators.momentum import momentum
from reviewgraph.operators.recommend import customer_prospects, recommended_restaurants
from reviewgraph.operators.sentiment import sentiment
from reviewgraph.operators.similarity import like_restaurants, like_users
from reviewgraph.plans.explore import explore_user
from reviewgraph.session import local_session
from reviewgraph.sources.staging import release, staged

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    spark = local_session("bench", CPUS)
    times: dict[str, float] = {}

    def timed(name, build):
        """Run ``build()``; a frame it returns is computed in full and thrown away."""
        start = time.perf_counter()
        result = build()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    base(spark, SF_DIR, "region").count()  # start the session's machinery
    t = timed("load_tables", lambda: derive(spark, SF_DIR).staged())
    user, place = staged(busiest_user(t), "seed"), staged(busiest_business(t), "seed")

    timed("count_reviews", lambda: t.review.agg(F.count(F.lit(1))))
    timed("user_profile_all", lambda: P.user_profile(t))
    timed("like_users_one", lambda: like_users(t, user))
    timed("like_restaurants_one", lambda: like_restaurants(t, place))
    timed("explore_user_one", lambda: explore_user(t, user).graph.nodes)
    # written, not thrown away: the next steps start from these tables
    like_u = timed("like_users_all", lambda: [staged(like_users(t), "like")])[0]
    like_r = timed("like_restaurants_all", lambda: [staged(like_restaurants(t), "like")])[0]
    timed("recommended_restaurants_all", lambda: recommended_restaurants(t, like_u))
    timed("customer_prospects_all", lambda: customer_prospects(t, like_r))
    third_u = staged(recommended_restaurants(t, like_u), "third")
    third_r = staged(customer_prospects(t, like_r), "third")
    graph = user_graph(t.users, like_u, third_u)
    timed("user_graph_links_all", lambda: graph.links)
    timed("restaurant_graph_nodes_all", lambda: restaurant_graph(t.business, like_r, third_r).nodes)
    chosen = graph.nodes.where("order = 3").select("seed_id", F.col("id").alias("selected_id"),
                                                   "order")
    timed("path_to_root_all", lambda: path_to_root(graph.links, chosen))
    timed("co_reviewers", lambda: M.co_reviewers(t, user))
    timed("co_reviewed", lambda: M.co_reviewed(t, place))
    timed("third_order_users", lambda: M.third_order_users(t, place))
    timed("third_order_businesses", lambda: M.third_order_businesses(t, user))
    names = t.users.select("name")
    timed("named_reviewers", lambda: M.named_reviewers(t, C.CITY, names))
    clean = t.with_tables(business=C.normalise_city(t.business))
    timed("reduce_to_category_counts", lambda: C.table_counts(t, C.reduce_to_category(t)))
    timed("reduce_to_city_counts", lambda: C.table_counts(t, C.reduce_to_city(clean)))
    timed("reduce_to_city_written", lambda: [C.reduce_to_city(clean).staged()])
    timed("drop_inactive_counts", lambda: C.table_counts(t, C.drop_inactive(t)))
    timed("pair_cross_classes", lambda: V.pair_cross_classes(V.rating_matrix(t, place)))
    timed("user_pairs", lambda: V.user_pairs(t, like_u))
    timed("pair_cross_look_alikes", lambda: V.pair_cross(V.user_pairs(t, like_u)))
    timed("business_documents", lambda: D.business_documents(t))
    timed("user_documents", lambda: D.user_documents(t, reviews=True, tips=True))
    timed("key_orphans", lambda: C.key_orphans(t))
    timed("rows_per_restaurant", lambda: C.rows_per_restaurant(t))
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    timed("sentiment", lambda: sentiment(base(spark, SF_DIR, "documents"), lexicon, "doc_id"))
    timed("momentum_all", lambda: momentum(t.review))

    release(spark)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else SF_DIR,
        "cpus": CPUS}))


if __name__ == "__main__":
    main()
