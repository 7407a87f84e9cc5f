"""The registered queries: every operator over the whole test tables.

Operators that take seeds run for every user or restaurant. The few that the data model only
defines for one chosen seed (walks around it) run for the busiest one, found in the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.lexicon import LEXICON, PROSE_RULES, TOKEN_LEXICON
from checks.tables import base, tables
from reviewgraph.functions import display
from reviewgraph.operators import documents as D
from reviewgraph.operators import graph as G
from reviewgraph.operators import mining as M
from reviewgraph.operators import profiles as P
from reviewgraph.operators import reach as E
from reviewgraph.operators import recommend as R
from reviewgraph.operators import reduction as C
from reviewgraph.operators import sentiment as T
from reviewgraph.operators import shared as H
from reviewgraph.operators import similarity as S
from reviewgraph.operators import uncut as N
from reviewgraph.operators import validation as V
from reviewgraph.operators.momentum import daily_sums, merged_sums, momentum, momentum_of
from reviewgraph.operators.search import folded_names, full_list, search, search_folded
from reviewgraph.plans import explore as X
from reviewgraph.plans.explore import Exploration, explore_restaurant, explore_user
from reviewgraph.sources.export import as_text, read_csv, records, write_csv
from reviewgraph.sources.schemas import TABLES
from reviewgraph.sources.staging import shared_folder, staged
from reviewgraph.sources.tables import Tables, append_rows, empty_like

Query = Callable[[SparkSession, str], DataFrame]
PREFIX = "red"
BATCH = 1000

# Tables that the scoring operators read several times are written first, as loaded ones are; the
# reviews before the others, which are made from them.
SCORED = ("business", "users", "friend")


def _scored(spark: SparkSession, sf_dir: str) -> Tables:
    return tables(spark, sf_dir, write_reviews=True).staged(*SCORED)


def _explore(spark: SparkSession, sf_dir: str, side: str) -> Exploration:
    """An exploration of all seeds; each query makes its own."""
    run = explore_user if side == "user" else explore_restaurant
    return run(_scored(spark, sf_dir))


def _like_u(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame]:
    t = _scored(spark, sf_dir).prepared()
    return t, S.like_users(t)


def _like_r(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame]:
    t = _scored(spark, sf_dir).prepared()
    return t, S.like_restaurants(t)


def _on_tables(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables(spark, sf_dir))


def _on_written(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(tables(spark, sf_dir, write_reviews=True))


def _on_user(f: Callable[[Exploration], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_explore(spark, sf_dir, "user"))


def _on_restaurant(f: Callable[[Exploration], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_explore(spark, sf_dir, "restaurant"))


def busiest_user(t: Tables) -> DataFrame:
    return M.busiest(t.review, "user_id")


def busiest_business(t: Tables) -> DataFrame:
    return M.busiest(t.review, "business_id")


def _competitors(t: Tables) -> DataFrame:
    seeds = busiest_business(t)
    found = M.attribute_competitors(t, seeds, M.own_categories(t, seeds))
    return found.select("seed_id", "business_id", "name")


def _selected(nodes: DataFrame, order: int) -> DataFrame:
    return nodes.where(F.col("order") == order).select("seed_id", F.col("id").alias("selected_id"))


def _clean(t: Tables) -> Tables:
    return t.with_tables(business=C.normalise_city(t.business))


def _matrix(t: Tables) -> DataFrame:
    return V.rating_matrix(t, busiest_business(t))


def _labelled(f: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, like = _like_u(spark, sf_dir)
        return f(V.labelled_classes(_matrix(t), like))
    return run


def _alike(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(V.user_pairs(*_like_u(spark, sf_dir)))


def _on_like_u(f: Callable[[Tables, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*_like_u(spark, sf_dir))


def _on_like_r(f: Callable[[Tables, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(*_like_r(spark, sf_dir))


def _on_scored(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_scored(spark, sf_dir))


def _on_prepared(f: Callable[[Tables], DataFrame]) -> Query:
    """For operators that read all ratings more than once."""
    return lambda spark, sf_dir: f(_scored(spark, sf_dir).prepared())


def messy_reviews(t: Tables) -> Tables:
    """The tables with second, later reviews of some pairs and reviews by and of missing ids."""
    again = t.review.where("useful = 3").withColumns({
        "id": F.concat("id", F.lit("-b")), "date": F.col("date") + F.expr("INTERVAL 1 DAY"),
        "stars": F.col("stars") % 5 + 1})
    ghosts = t.review.where("useful = 5").withColumns({
        "id": F.concat("id", F.lit("-g")), "user_id": F.concat(F.lit("ghost"), "user_id")})
    lost = t.review.where("useful = 2 AND funny = 1").withColumns({
        "id": F.concat("id", F.lit("-l")), "business_id": F.concat(F.lit("lost"), "business_id")})
    rows = t.review.unionByName(again).unionByName(ghosts).unionByName(lost)
    return replace(t.with_tables(review=rows), one_review_per_pair=False)


def _sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    return T.sentiment(base(spark, sf_dir, "documents"), lexicon, key="doc_id")


def _sentiment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(list(TOKEN_LEXICON.items()), "word string, valence double")
    return T.sentiment(base(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("/"), "turn").alias("key"), "text"), lexicon, key="key",
        token=T.TOKENS)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "conversations").select(
        F.concat("conv_id", F.lit("/"), "turn").alias("key"), "text")


def _ordered_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-aware sentiment of all turns with the fixed lexicon."""
    lexicon = spark.createDataFrame(list(TOKEN_LEXICON.items()), "word string, valence double")
    rules = spark.createDataFrame([*T.RULES, *PROSE_RULES],
                                  "word string, effect string, size double")
    return T.ordered_sentiment(_turns(spark, sf_dir), lexicon, rules, key="key")


def _learned_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valences of all words, from the quality labels of documents."""
    return T.learned_lexicon(base(spark, sf_dir, "documents"), base(spark, sf_dir, "labels"),
                             "doc_id", "quality")


def _learned_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of all documents with the lexicon learned from them."""
    lexicon = staged(_learned_lexicon(spark, sf_dir), "lexicon")
    return T.sentiment(base(spark, sf_dir, "documents"), lexicon, key="doc_id")


def _sentiment_by_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = base(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("stars"))
    return T.sentiment_by_stars(_sentiment(spark, sf_dir).join(stars, "doc_id"))


def _first_batch(t: Tables) -> DataFrame:
    """Reviews of the city's businesses numbered 1 to a thousand."""
    reviews = t.review.select("id", "business_id", "user_id", "stars")
    return C.rows_of_batch(reviews, "business_id", C.numbered_businesses(_clean(t)), 1, BATCH)


def _kept_up(t: Tables) -> DataFrame:
    """Momentum from stored sums to which two parts of the reviews, one of them late, are added."""
    parts = [t.review.where(f"cool % 3 = {k}") for k in (1, 0, 2)]
    state = staged(daily_sums(parts[0]), "momentum")
    for part in parts[1:]:
        state = staged(merged_sums(state, part), "momentum")
    return momentum_of(state)


def _price_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot numbers of groups with very many distinct values."""
    rows = base(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return V.quartiles(rows, "l_extendedprice", ("l_returnflag",))


def _detail(side: str, order: int, view: Callable, part: int) -> Query:
    """One of the three parts that a click on a node of this order brings up, for all nodes."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _scored(spark, sf_dir).prepared()
        explored = (explore_user if side == "user" else explore_restaurant)(t)
        return view(t, explored, _selected(explored.graph.nodes, order))[part]
    return run


def _details() -> dict[str, Query]:
    """Detail and look-alikes of the six kinds of nodes; comparisons have queries of their own."""
    views = {"rating_of_restaurant": ("user", 1, X.rating_of_restaurant),
             "rating_by_user": ("restaurant", 1, X.rating_by_user),
             "likeminded_user": ("user", 2, X.likeminded_user_similarity),
             "direct_competitor": ("restaurant", 2, X.direct_competitor_similarity),
             "recommended_restaurant": ("user", 3, X.recommended_restaurant_relevance),
             "customer_prospect": ("restaurant", 3, X.customer_prospect_relevance)}
    return {f"{name}_{part}": _detail(*view, i) for name, view in views.items()
            for part, i in (("detail", 0), ("like_nodes", 2))}


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories written as csv to the shared folder and read back."""
    rows = tables(spark, sf_dir).category
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(rows, path)
    return read_csv(spark, path, TABLES["category"])


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty clone of the friends table in a folder, to which the rows are appended."""
    friend = tables(spark, sf_dir).friend
    folder = f"{shared_folder(spark)}/append-{uuid.uuid4().hex}"
    empty_like(friend).write.parquet(f"{folder}/friend")
    append_rows(friend, folder, "friend")
    return spark.read.parquet(f"{folder}/friend")


def _reviews_by_id(t: Tables) -> DataFrame:
    """The busiest user's first review, by both keys."""
    user, review = (t.review.join(busiest_user(t), F.col("user_id") == F.col("seed_id"))
                    .orderBy("id").select("user_id", "id").first())
    return D.review_by_id(t, user, review).select("id", "user_id", "business_id", "stars", "text")


def _by_key(t: Tables) -> DataFrame:
    """The first row of a table with a key of two columns, found again by that key."""
    row = t.first("category").first()
    return t.get("category", row["business_id"], row["category"])


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sizes read as days since the epoch, in milliseconds."""
    return base(spark, sf_dir, "documents").select("doc_id", display.date_from_millis(
        F.col("n_chars") * 86_400_000).alias("day"))


def _path(x: Exploration) -> DataFrame:
    chosen = _selected(x.graph.nodes, 3).withColumn("order", F.lit(3))
    return G.path_to_root(x.graph.links, chosen)


def _topk_selected(x: Exploration) -> DataFrame:
    return G.comparison_topk(G.comparison(x.graph.nodes, 2), _selected(x.graph.nodes, 2))


def _comparison(order: int) -> Callable[[Exploration], DataFrame]:
    return lambda x: G.comparison(x.graph.nodes, order)


def _of_one_user(f: Callable[[Exploration], DataFrame]) -> Query:
    """The path for given seeds: only what the busiest user's graph touches is computed."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir, write_reviews=True)
        return f(explore_user(t, busiest_user(t)))
    return run


def _of_one_restaurant(f: Callable[[Exploration], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir, write_reviews=True)
        return f(explore_restaurant(t, busiest_business(t)))
    return run


def queries() -> dict[str, Query]:
    return {
        "search_prefix": _on_tables(lambda t: search(t.business, PREFIX)),
        "search_prefix_sorted": _on_tables(
            lambda t: search_folded(folded_names(t.business), PREFIX)),
        "full_list": _on_tables(lambda t: full_list(t.business)),
        "user_profile": _on_tables(P.user_profile),
        "candidate_influence": _on_tables(
            lambda t: P.with_influence(t).select("user_id", "influence_val")),
        "restaurant_profile": _on_tables(P.restaurant_profile),
        "user_restaurant_rating": _on_tables(P.user_restaurant_rating),
        "rating_card": _on_tables(lambda t: display.rating_card(P.user_restaurant_rating(t))),
        "like_users": _on_prepared(S.like_users),
        "like_restaurants": _on_prepared(S.like_restaurants),
        "recommended_restaurants": _on_user(lambda x: x.third),
        "customer_prospects": _on_restaurant(lambda x: x.third),
        "like_users_highest": _on_prepared(lambda t: S.like_users(t, first_order_by="highest")),
        "like_restaurants_exclusive": _on_prepared(
            lambda t: S.like_restaurants(t, limit=5, inclusive=False)),
        "like_users_uncut_of_busiest": _on_scored(lambda t: S.like_users(
            t, busiest_user(t), first_order=None, candidate_rows=None)),
        "like_restaurants_uncut_of_busiest": _on_scored(lambda t: S.like_restaurants(
            t, busiest_business(t), first_order=None, candidate_rows=None)),
        "like_users_uncut": _on_prepared(lambda t: N.like_users_uncut(t).like),
        "like_restaurants_uncut": _on_prepared(lambda t: N.like_restaurants_uncut(t).like),
        "recommended_new_restaurants": _on_like_u(
            lambda t, like: R.recommended_restaurants(t, like, exclude="all_reviewed")),
        "new_customer_prospects": _on_like_r(
            lambda t, like: R.customer_prospects(t, like, exclude="all_reviewed")),
        "recommended_by_hundred": _on_scored(lambda t: R.recommended_restaurants(
            t, S.like_users(t, busiest_user(t), limit=100), few=True)),
        "recommended_uncut_of_busiest": _on_scored(lambda t: R.recommended_restaurants(
            t, S.like_users(t, busiest_user(t)), considered_rows=None, few=True)),
        "messy_ratings": _on_tables(lambda t: messy_reviews(t).ratings()),
        "user_graph_nodes": _on_user(lambda x: x.graph.nodes),
        "user_graph_links": _on_user(lambda x: x.graph.links),
        "restaurant_graph_nodes": _on_restaurant(lambda x: x.graph.nodes),
        "restaurant_graph_links": _on_restaurant(lambda x: x.graph.links),
        "explore_like_nodes_user": _on_user(lambda x: x.like_nodes),
        "explore_like_nodes_restaurant": _on_restaurant(lambda x: x.like_nodes),
        "user_profile_of_busiest": _of_one_user(lambda x: x.profile),
        "restaurant_profile_of_busiest": _of_one_restaurant(lambda x: x.profile),
        "like_users_of_busiest": _of_one_user(lambda x: x.like),
        "like_restaurants_of_busiest": _of_one_restaurant(lambda x: x.like),
        "recommended_restaurants_of_busiest": _of_one_user(lambda x: x.third),
        "customer_prospects_of_busiest": _of_one_restaurant(lambda x: x.third),
        "user_graph_links_of_busiest": _of_one_user(lambda x: x.graph.links),
        "restaurant_graph_links_of_busiest": _of_one_restaurant(lambda x: x.graph.links),
        **_details(),
        **{f"comparison_order{k}": _on_user(_comparison(k)) for k in (1, 2, 3)},
        **{f"restaurant_comparison_order{k}": _on_restaurant(_comparison(k)) for k in (1, 2, 3)},
        "comparison_topk_selected": _on_user(_topk_selected),
        "restaurant_comparison_topk_selected": _on_restaurant(_topk_selected),
        "likeminded_user_similarity": _on_like_u(lambda t, like: S.user_similarity(like)),
        "direct_competitor_similarity": _on_like_r(
            lambda t, like: S.restaurant_similarity(like)),
        "similarity_card": _on_like_u(
            lambda t, like: display.similarity_card(S.user_similarity(like))),
        "competitor_card": _on_like_r(lambda t, like: display.similarity_card(
            S.restaurant_similarity(like), display.RESTAURANT_SIMILARITY_ROWS)),
        "relevance_card": _on_user(lambda x: display.relevance_card(
            R.restaurant_relevance(x.third), "user", "lmu_rating", "lmu_score")),
        "reco_relevance": _on_user(lambda x: R.restaurant_relevance(x.third)),
        "prospect_relevance": _on_restaurant(lambda x: R.prospect_relevance(x.third)),
        "relevance_totals": _on_user(
            lambda x: R.relevance_totals(R.restaurant_relevance(x.third), "lmu_score")),
        "prospect_relevance_totals": _on_restaurant(
            lambda x: R.relevance_totals(R.prospect_relevance(x.third), "compete_score")),
        "path_to_root": _on_user(_path),
        "restaurant_path_to_root": _on_restaurant(_path),
        "reduce_category_counts": _on_tables(lambda t: C.table_counts(t, C.reduce_to_category(t))),
        "reduce_city_counts": _on_tables(
            lambda t: C.table_counts(t, C.reduce_to_city(_clean(t)))),
        "reduce_city_users": _on_tables(
            lambda t: C.reduce_to_city(_clean(t)).users.select("id", "name", "review_count")),
        "reduce_city_friends": _on_tables(
            lambda t: C.reduce_to_city(_clean(t)).friend.select("user_id", "friend_id")),
        "normalise_city": _on_tables(
            lambda t: C.normalise_city(t.business).select("id", "postal_code", "city")),
        "inactive_users": _on_tables(C.inactive_users),
        "drop_inactive_counts": _on_tables(lambda t: C.table_counts(t, C.drop_inactive(t))),
        "key_duplicates": _on_tables(C.key_duplicates),
        "key_orphans": _on_tables(C.key_orphans),
        "category_stats": _on_tables(C.category_stats),
        "rows_per_restaurant": _on_tables(C.rows_per_restaurant),
        "city_zip_pairs": _on_tables(lambda t: C.city_zip_pairs(t.business)),
        "numbered_businesses": _on_tables(lambda t: C.numbered_businesses(_clean(t))),
        "numbered_reviewers": _on_tables(lambda t: C.numbered_reviewers(_clean(t))),
        "reviews_of_first_batch": _on_tables(_first_batch),
        "friends_by_batch": _on_tables(lambda t: C.rows_by_batch(
            t.friend.select("user_id", "friend_id"), "user_id",
            C.numbered_reviewers(_clean(t)), BATCH)),
        "price_quartiles": _price_quartiles,
        "attribute_competitors": _on_tables(_competitors),
        "new_prospects": _on_tables(lambda t: M.new_prospects(t, _competitors(t))),
        "third_order_users": _on_tables(lambda t: M.third_order_users(t, busiest_business(t))),
        "third_order_users_of_top": _on_tables(
            lambda t: M.third_order_users(t, busiest_business(t), followed=100)),
        "third_order_users_of_three": _on_tables(lambda t: M.third_order_users(
            t, M.busiest(t.review, "business_id", 3), followed=20)),
        "third_order_businesses": _on_tables(
            lambda t: M.third_order_businesses(t, busiest_user(t))),
        "third_order_user_sizes": _on_tables(E.third_order_user_sizes),
        "third_order_business_sizes": _on_tables(E.third_order_business_sizes),
        "third_order_user_sizes_of_three": _on_tables(lambda t: E.checked_sizes(
            t, M.busiest(t.review, "business_id", 3))),
        "third_order_business_sizes_of_three": _on_tables(lambda t: E.checked_sizes(
            t, M.busiest(t.review, "user_id", 3), "user_id")),
        "edge_sample": _on_tables(M.edge_sample),
        "named_reviewers": lambda spark, sf: M.named_reviewers(
            tables(spark, sf), C.CITY,
            base(spark, sf, "customer").select(F.upper("c_name").alias("name"))),
        "co_reviewers": _on_tables(lambda t: M.co_reviewers(t, busiest_user(t))),
        "co_reviewers_top_all": _on_written(H.co_reviewers_top),
        "co_reviewed_top_all": _on_written(H.co_reviewed_top),
        "same_rating_users": _on_tables(lambda t: M.same_rating_users(t, busiest_user(t))),
        "co_reviewed": _on_tables(lambda t: M.co_reviewed(t, busiest_business(t))),
        "same_rating_restaurants": _on_tables(
            lambda t: M.same_rating_restaurants(t, busiest_business(t))),
        "co_reviewers_of_three": _on_tables(
            lambda t: M.co_reviewers(t, M.busiest(t.review, "user_id", 3))),
        "rating_matrix_of_three": _on_tables(
            lambda t: V.rating_matrix(t, M.busiest(t.review, "business_id", 3))),
        "review_counts": _on_tables(lambda t: M.review_counts(
            t, t.business.where(F.col("city") == C.CITY).select(F.col("id").alias("business_id")))),
        "rating_matrix": _on_tables(_matrix),
        "pair_classes": _on_tables(lambda t: V.pair_classes(_matrix(t))),
        "pair_cross_classes": _on_tables(lambda t: V.pair_cross_classes(_matrix(t))),
        "pair_corr": _on_tables(lambda t: V.pair_corr(V.pair_cross_classes(_matrix(t)), "pairs")),
        "labelled_pairs": _labelled(lambda rows: rows),
        "pair_means": _labelled(lambda rows: V.pair_means(rows, "pairs")),
        "pair_anova": _labelled(lambda rows: V.pair_anova(rows, "pairs")),
        "pair_quartiles": _labelled(lambda rows: V.quartiles(rows, "match", weight="pairs")),
        "user_pairs": _alike(lambda pairs: pairs),
        "pair_cross": _alike(V.pair_cross),
        "pair_long": _alike(lambda pairs: V.pair_long(V.pair_cross(pairs))),
        "alike_pair_corr": _alike(lambda pairs: V.pair_corr(V.pair_cross(pairs))),
        "sentiment": _sentiment,
        "sentiment_by_stars": _sentiment_by_stars,
        "sentiment_tokens": _sentiment_tokens,
        "ordered_sentiment": _ordered_sentiment,
        "learned_lexicon": _learned_lexicon,
        "learned_sentiment": _learned_sentiment,
        "momentum_kept_up": _on_tables(_kept_up),
        "useful_by_stars_differences": _on_tables(lambda t: V.pairwise_differences(
            t.review, label="stars", value="useful")),
        "momentum": _on_tables(lambda t: momentum(t.review)),
        "nested_business_documents": _on_tables(D.nested_business_documents),
        "nested_user_documents": _on_tables(
            lambda t: D.nested_user_documents(t, reviews=True, tips=True)),
        "business_documents": _on_tables(D.business_documents),
        "user_documents": _on_tables(
            lambda t: D.user_documents(t, reviews=True, tips=True)),
        "review_by_id": _on_tables(_reviews_by_id),
        "row_by_key": _on_tables(_by_key),
        "csv_round_trip": _csv_round_trip,
        "appended_rows": _appended,
        "review_texts": _on_tables(lambda t: as_text(t.review)),
        "dates_from_millis": _dates,
        "reviewed_businesses": _on_tables(D.reviewed_businesses),
        "business_records": _on_tables(lambda t: records(
            t.business.select("id", "name", "city", "stars", "review_count"), keep=("id",))),
    }
