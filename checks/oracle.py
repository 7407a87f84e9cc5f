"""Plain SQL for every registered query, without the cuts and slices the Spark side uses.

``WITH`` parts are named; a query pulls in the parts it mentions.
"""

from __future__ import annotations

import re

from checks.lexicon import LEXICON, PROSE_RULES, TOKEN_LEXICON
from checks.views import VIEWS
from reviewgraph.operators.reduction import CITY_DISTRICTS, CITY_SPELLINGS
from reviewgraph.operators.sentiment import RULES, TOKENS


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def _log(x: str, divisor: int) -> str:
    return f"least(ln(({x}) + 1) / {divisor}, 1.0)"


def _names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_PARTS = {"total_reviews_score": _log("review_count", 6),
          "review_likes_score": _log("review_likes", 7),
          "fans_score": _log("fans", 5), "friends_score": _log("friends", 6),
          "avg_rating_score": "average_stars / 5"}

PARTS: dict[str, str] = {}

PARTS["people"] = f"""
  SELECT user_id, name, review_count AS total_reviews, average_stars AS avg_rating, yelping_since,
         review_likes, fans, friends,
         {", ".join(f"{r2(e)} AS {n}" for n, e in _PARTS.items())},
         {r2(" + ".join(r2(e) for e in _PARTS.values()))} AS influence,
         {r2(" + ".join(_PARTS[k] for k in ("review_likes_score", "friends_score",
             "total_reviews_score", "fans_score", "avg_rating_score")))} AS influence_val
  FROM (SELECT u.id AS user_id, u.*, u.useful + u.funny + u.cool AS review_likes,
               (SELECT count(*) FROM friend f WHERE f.user_id = u.id) AS friends FROM users u)"""

# --- look-alikes ---------------------------------------------------------------------------

PARTS["user_first"] = """
  SELECT seed_id, business_id, sel_rating FROM (
    SELECT user_id AS seed_id, business_id, stars AS sel_rating,
           row_number() OVER (PARTITION BY user_id ORDER BY stars, business_id) AS n FROM review)
  WHERE n <= 10"""
PARTS["user_rows"] = """
  SELECT * FROM (
    SELECT f.seed_id, f.business_id, f.sel_rating, r.user_id, r.stars, p.total_reviews,
           p.influence_val,
           row_number() OVER (PARTITION BY f.seed_id
                              ORDER BY p.review_likes DESC, r.user_id, r.business_id) AS n
    FROM user_first f JOIN review r ON r.business_id = f.business_id AND r.user_id <> f.seed_id
    JOIN people p ON p.user_id = r.user_id) WHERE n <= 2000"""
PARTS["user_pairs_scored"] = f"""
  SELECT *, {r2("overlap_score + rate_sim_score + shared_score + influence_score + influ_sim_score")}
            AS lmu_score
  FROM (
    SELECT g.seed_id, g.user_id, g.shared_val, g.influence_val,
           {r2("least(g.shared_val / 5, 1.0)")} AS shared_score,
           cast(g.shared_val AS string) || ' / ' || cast(g.total_reviews + s.total_reviews AS string)
             AS overlap_val,
           {r2("least(g.shared_val / ln(g.total_reviews + s.total_reviews), 1.0)")} AS overlap_score,
           cast(g.low AS string) || ' / ' || cast(g.high AS string) AS rate_sim_val,
           {r2("g.low / g.high")} AS rate_sim_score,
           {r2("g.influence_val / 5")} AS influence_score,
           cast(least(g.influence_val, s.influence) AS string) || ' / '
             || cast(greatest(g.influence_val, s.influence) AS string) AS influ_sim_val,
           {r2("least(g.influence_val, s.influence) / greatest(g.influence_val, s.influence)")}
             AS influ_sim_score
    FROM (SELECT seed_id, user_id, count(*) AS shared_val,
                 cast(sum(least(stars, sel_rating)) AS bigint) AS low,
                 cast(sum(greatest(stars, sel_rating)) AS bigint) AS high,
                 max(total_reviews) AS total_reviews, max(influence_val) AS influence_val
          FROM user_rows GROUP BY seed_id, user_id) g
    JOIN people s ON s.user_id = g.seed_id)"""
PARTS["user_clip"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id
                                              ORDER BY lmu_score DESC, user_id DESC) AS n
                 FROM user_pairs_scored) WHERE n <= 21"""
USER_SIM = ("shared_val, shared_score, overlap_val, overlap_score, rate_sim_val, rate_sim_score, "
            "influence_val, influence_score, influ_sim_val, influ_sim_score, lmu_score")
PARTS["like_u"] = f"""
  SELECT c.seed_id, b.name AS restaurant, x.business_id AS restaurant_id, u.name AS "user",
         c.user_id, x.sel_rating, {USER_SIM}, c.n AS position
  FROM user_clip c JOIN (SELECT seed_id, user_id, business_id, sel_rating FROM user_rows) x ON x.seed_id = c.seed_id AND x.user_id = c.user_id
  JOIN business b ON b.id = x.business_id JOIN users u ON u.id = c.user_id"""

PARTS["rest_first"] = """
  SELECT seed_id, user_id, sel_rating FROM (
    SELECT business_id AS seed_id, user_id, stars AS sel_rating,
           row_number() OVER (PARTITION BY business_id ORDER BY useful, user_id) AS n FROM review)
  WHERE n <= 10"""
PARTS["rest_rows"] = """
  SELECT * FROM (
    SELECT f.seed_id, f.user_id, f.sel_rating, r.business_id, r.stars,
           row_number() OVER (PARTITION BY f.seed_id
                              ORDER BY r.stars DESC, r.business_id, r.user_id) AS n
    FROM rest_first f JOIN review r ON r.user_id = f.user_id AND r.business_id <> f.seed_id)
  WHERE n <= 1000"""
PARTS["rest_pairs_scored"] = f"""
  SELECT *, {r2("rate_sim_score + shared_score + overlap_score + review_sim_score + zip_score")}
            AS compete_score
  FROM (
    SELECT g.seed_id, g.business_id, g.shared_val,
           {r2("least(g.shared_val / 10, 1.0)")} AS shared_score,
           cast(g.shared_val AS string) || ' / ' || cast(b.review_count + s.review_count AS string)
             AS overlap_val,
           {r2("least(g.shared_val / (ln(b.review_count + s.review_count) * 5), 1.0)")}
             AS overlap_score,
           cast(least(b.review_count, s.review_count) AS string) || ' / '
             || cast(greatest(b.review_count, s.review_count) AS string) AS review_sim_val,
           CASE WHEN greatest(b.review_count, s.review_count) <= 1 THEN 1.0
                ELSE {r2("ln(least(b.review_count, s.review_count)) / ln(greatest(b.review_count, s.review_count))")}
           END AS review_sim_score,
           cast(g.low AS string) || ' / ' || cast(g.high AS string) AS rate_sim_val,
           {r2("g.low / g.high")} AS rate_sim_score,
           CASE WHEN b.postal_code = s.postal_code THEN 'Yes' ELSE 'No' END AS zip_val,
           CASE WHEN b.postal_code = s.postal_code THEN 1 ELSE 0 END AS zip_score
    FROM (SELECT seed_id, business_id, count(*) AS shared_val,
                 cast(sum(least(stars, sel_rating)) AS bigint) AS low,
                 cast(sum(greatest(stars, sel_rating)) AS bigint) AS high
          FROM rest_rows GROUP BY seed_id, business_id) g
    JOIN business b ON b.id = g.business_id JOIN business s ON s.id = g.seed_id)"""
PARTS["rest_clip"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id
                                              ORDER BY compete_score DESC, business_id DESC) AS n
                 FROM rest_pairs_scored) WHERE n <= 21"""
REST_SIM = ("shared_val, shared_score, overlap_val, overlap_score, review_sim_val, "
            "review_sim_score, rate_sim_val, rate_sim_score, zip_val, zip_score, compete_score")
PARTS["like_r"] = f"""
  SELECT c.seed_id, u.name AS "user", x.user_id, b.name AS restaurant,
         c.business_id AS restaurant_id, x.sel_rating, {REST_SIM}, c.n AS position
  FROM rest_clip c JOIN rest_rows x ON x.seed_id = c.seed_id AND x.business_id = c.business_id
  JOIN business b ON b.id = c.business_id JOIN users u ON u.id = x.user_id"""

# --- third order ---------------------------------------------------------------------------

_RELEVANCY = r2("CASE WHEN votes > 1 THEN sum_contribution / sum_score "
                "ELSE (avg_rating * 5 + sum_contribution) / (sum_score + 5) END")


def _third(rows: str, item: str, score: str) -> str:
    return f"""
  SELECT x.*, k.votes, k.relevancy, k.m AS position FROM {rows} x JOIN (
    SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY relevancy DESC, {item} DESC) AS m
    FROM (SELECT seed_id, {item}, votes, {_RELEVANCY} AS relevancy
          FROM (SELECT seed_id, {item}, count(*) AS votes, max(avg_rating) AS avg_rating,
                       cast(sum(cast({score} AS decimal(18, 2))) AS double) AS sum_score,
                       cast(sum(cast(contribution AS decimal(18, 2))) AS double)
                         AS sum_contribution
                FROM {rows} GROUP BY seed_id, {item}))) k
  ON k.seed_id = x.seed_id AND k.{item} = x.{item} WHERE k.m <= 31"""


PARTS["reco_rows"] = f"""
  SELECT * FROM (
    SELECT l.seed_id, r.business_id AS restaurant_id, b.name AS restaurant, b.stars AS avg_rating,
           r.user_id, r.stars AS lmu_rating, l.lmu_score,
           {r2("r.stars * l.lmu_score")} AS contribution,
           row_number() OVER (PARTITION BY l.seed_id
                              ORDER BY b.stars DESC, r.business_id, r.user_id) AS n
    FROM (SELECT DISTINCT seed_id, user_id, lmu_score FROM like_u) l
    JOIN review r ON r.user_id = l.user_id JOIN business b ON b.id = r.business_id
    WHERE NOT EXISTS (SELECT 1 FROM like_u f
                      WHERE f.seed_id = l.seed_id AND f.restaurant_id = r.business_id))
  WHERE n <= 2000"""
PARTS["reco_kept"] = _third("reco_rows", "restaurant_id", "lmu_score")
PARTS["reco"] = """
  SELECT k.seed_id, k.restaurant, k.restaurant_id, k.avg_rating, u.name AS "user", k.user_id,
         k.lmu_rating, k.lmu_score, k.contribution, k.relevancy, k.position
  FROM reco_kept k JOIN users u ON u.id = k.user_id"""
PARTS["prospect_rows"] = f"""
  SELECT * FROM (
    SELECT l.seed_id, r.user_id, u.name AS "user", u.average_stars AS avg_rating,
           r.business_id AS restaurant_id, r.stars AS user_rating, l.compete_score,
           {r2("r.stars * l.compete_score")} AS contribution,
           row_number() OVER (PARTITION BY l.seed_id
                              ORDER BY u.useful DESC, r.user_id, r.business_id) AS n
    FROM (SELECT DISTINCT seed_id, restaurant_id, compete_score FROM like_r) l
    JOIN review r ON r.business_id = l.restaurant_id JOIN users u ON u.id = r.user_id
    WHERE NOT EXISTS (SELECT 1 FROM like_r f
                      WHERE f.seed_id = l.seed_id AND f.user_id = r.user_id))
  WHERE n <= 1000"""
PARTS["prospect_kept"] = _third("prospect_rows", "user_id", "compete_score")
PARTS["prospect"] = """
  SELECT k.seed_id, k."user", k.user_id, k.avg_rating, b.name AS restaurant, k.restaurant_id,
         k.user_rating, k.compete_score, k.contribution, k.votes AS reviewed, k.relevancy,
         k.position
  FROM prospect_kept k JOIN business b ON b.id = k.restaurant_id"""

# --- graphs --------------------------------------------------------------------------------

PARTS["user_nodes"] = """
  SELECT DISTINCT seed_id, restaurant_id AS id, restaurant AS name, 'restaurant' AS type,
         3 AS "order", cast(relevancy AS double) AS score FROM reco
  UNION ALL SELECT DISTINCT seed_id, user_id, "user", 'user', 2, cast(lmu_score AS double)
  FROM reco
  UNION ALL SELECT DISTINCT l.seed_id, l.restaurant_id, l.restaurant, 'restaurant', 1,
                   cast(r.stars AS double)
  FROM like_u l JOIN (SELECT DISTINCT seed_id, user_id FROM reco) k
    ON k.seed_id = l.seed_id AND k.user_id = l.user_id
  JOIN review r ON r.user_id = l.seed_id AND r.business_id = l.restaurant_id
  UNION ALL SELECT DISTINCT k.seed_id, k.seed_id, u.name, 'user', 0, cast(-1 AS double)
  FROM reco k JOIN users u ON u.id = k.seed_id"""
PARTS["user_links"] = """
  SELECT seed_id, user_id AS source, restaurant_id AS target, 2 AS src_order,
         cast(lmu_rating AS double) AS score FROM reco
  UNION ALL SELECT l.seed_id, l.restaurant_id, l.user_id, 1, cast(l.sel_rating AS double)
  FROM like_u l JOIN (SELECT DISTINCT seed_id, user_id FROM reco) k
    ON k.seed_id = l.seed_id AND k.user_id = l.user_id
  UNION ALL SELECT DISTINCT l.seed_id, l.seed_id, l.restaurant_id, 0, cast(r.stars AS double)
  FROM like_u l JOIN (SELECT DISTINCT seed_id, user_id FROM reco) k
    ON k.seed_id = l.seed_id AND k.user_id = l.user_id
  JOIN review r ON r.user_id = l.seed_id AND r.business_id = l.restaurant_id"""
PARTS["rest_nodes"] = """
  SELECT DISTINCT seed_id, user_id AS id, "user" AS name, 'user' AS type, 3 AS "order",
         cast(relevancy AS double) AS score FROM prospect
  UNION ALL SELECT DISTINCT seed_id, restaurant_id, restaurant, 'restaurant', 2,
                   cast(compete_score AS double) FROM prospect
  UNION ALL SELECT DISTINCT l.seed_id, l.user_id, l."user", 'user', 1, cast(r.stars AS double)
  FROM like_r l JOIN (SELECT DISTINCT seed_id, restaurant_id FROM prospect) k
    ON k.seed_id = l.seed_id AND k.restaurant_id = l.restaurant_id
  JOIN review r ON r.business_id = l.seed_id AND r.user_id = l.user_id
  UNION ALL SELECT DISTINCT k.seed_id, k.seed_id, b.name, 'restaurant', 0, cast(-1 AS double)
  FROM prospect k JOIN business b ON b.id = k.seed_id"""
PARTS["rest_links"] = """
  SELECT seed_id, restaurant_id AS source, user_id AS target, 2 AS src_order,
         cast(compete_score AS double) AS score FROM prospect
  UNION ALL SELECT l.seed_id, l.user_id, l.restaurant_id, 1, cast(l.sel_rating AS double)
  FROM like_r l JOIN (SELECT DISTINCT seed_id, restaurant_id FROM prospect) k
    ON k.seed_id = l.seed_id AND k.restaurant_id = l.restaurant_id
  UNION ALL SELECT DISTINCT l.seed_id, l.seed_id, l.user_id, 0, cast(r.stars AS double)
  FROM like_r l JOIN (SELECT DISTINCT seed_id, restaurant_id FROM prospect) k
    ON k.seed_id = l.seed_id AND k.restaurant_id = l.restaurant_id
  JOIN review r ON r.business_id = l.seed_id AND r.user_id = l.user_id"""


def _comparison(nodes: str, order: int) -> str:
    return (f'SELECT seed_id, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, name, id)'
            f' AS position, id, name, score FROM {nodes} WHERE "order" = {order}')


for _side in ("user", "rest"):
    for _order in (1, 2, 3):
        PARTS[f"{_side}_compared{_order}"] = _comparison(f"{_side}_nodes", _order)


def _topk(side: str) -> str:
    c = f"{side}_compared2"
    return f"""
  SELECT s.seed_id, s.id AS selected_id, t.position,
         CASE WHEN s.position > 10 AND t.position = 10 THEN s.id ELSE t.id END AS id,
         CASE WHEN s.position > 10 AND t.position = 10 THEN s.name ELSE t.name END AS name,
         CASE WHEN s.position > 10 AND t.position = 10 THEN s.score ELSE t.score END AS score
  FROM {c} s JOIN {c} t ON t.seed_id = s.seed_id AND t.position <= 10"""


def _paths(side: str) -> str:
    links = f"{side}_links"
    return f"""
  WITH p2 AS (SELECT l.seed_id, l.target AS selected_id, l.source, l.target, l.src_order, l.score
              FROM {links} l WHERE l.src_order = 2),
       p1 AS (SELECT DISTINCT l.seed_id, p.selected_id, l.source, l.target, l.src_order, l.score
              FROM p2 p JOIN {links} l
              ON l.seed_id = p.seed_id AND l.target = p.source AND l.src_order = 1),
       p0 AS (SELECT DISTINCT l.seed_id, p.selected_id, l.source, l.target, l.src_order, l.score
              FROM p1 p JOIN {links} l
              ON l.seed_id = p.seed_id AND l.target = p.source AND l.src_order = 0)
  SELECT * FROM p2 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p0"""


def _relevance(rows: str, item: str, who: str, rating: str, score: str, caption: str) -> str:
    return f"""
  SELECT seed_id, {item} AS selected_id, "{who}", cast({rating} AS double) AS {rating},
         cast({score} AS double) AS {score}, contribution, relevancy FROM {rows}
  UNION ALL
  SELECT seed_id, {item}, '{caption.replace("'", "''")}', max(avg_rating), cast(5 AS double),
         max(avg_rating) * 5, max(relevancy)
  FROM {rows} GROUP BY seed_id, {item} HAVING count(*) = 1"""


PARTS["reco_rel"] = _relevance("reco", "restaurant_id", "user", "lmu_rating", "lmu_score",
                               "Restaurant's Average Rating")
PARTS["prospect_rel"] = _relevance("prospect", "user_id", "restaurant", "user_rating",
                                   "compete_score", "User's Average Rating")


def _totals(rel: str, score: str) -> str:
    return f"""
  SELECT seed_id, selected_id, 'Totals' AS line,
         cast(sum(cast({score} AS decimal(18, 2))) AS double) AS similarity,
         round(cast(sum(cast(contribution AS decimal(28, 6))) AS double), 6) AS contribution
  FROM {rel} GROUP BY seed_id, selected_id
  UNION ALL
  SELECT seed_id, selected_id, 'Contribution / Similarity', NULL, max(relevancy)
  FROM {rel} GROUP BY seed_id, selected_id"""


# --- profiles and ratings ------------------------------------------------------------------

# The columns of a rating and of a restaurant's profile, in display order.
RATING_COLUMNS = ('restaurant, restaurant_id, "user", user_id, rating, date, review, useful, '
                  "funny, cool")
PROFILE_COLUMNS = ("name, restaurant_id, avg_rating, total_reviews, neighborhood, address, city, "
                   "state, zip, categories, attributes")

PARTS["rating"] = f"""
  WITH reviewed AS (SELECT id AS restaurant_id, name AS restaurant FROM business),
       reviewers AS (SELECT id AS user_id, name AS "user" FROM users),
       reviews AS (SELECT user_id, business_id AS restaurant_id, stars AS rating, date,
                          text AS review, useful, funny, cool FROM review)
  SELECT {RATING_COLUMNS} FROM reviews JOIN reviewers USING (user_id)
  JOIN reviewed USING (restaurant_id)"""

# --- mining seeds --------------------------------------------------------------------------

PARTS["busy_user"] = """
  SELECT user_id AS seed_id FROM review GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1"""
PARTS["busy_business"] = """
  SELECT business_id AS seed_id FROM review GROUP BY business_id
  ORDER BY count(*) DESC, business_id LIMIT 1"""
PARTS["rest_ids"] = "SELECT business_id FROM category WHERE category = 'Restaurants'"
PARTS["competitors"] = """
  SELECT s.seed_id, min(b.id) AS business_id, b.name
  FROM busy_business s JOIN business o ON o.id = s.seed_id
  JOIN business b ON b.postal_code = o.postal_code
  WHERE b.id IN (SELECT business_id FROM rest_ids)
    AND EXISTS (SELECT 1 FROM category c JOIN category d ON d.category = c.category
                WHERE c.business_id = b.id AND d.business_id = s.seed_id
                  AND c.category <> 'Restaurants')
  GROUP BY s.seed_id, b.name"""
PARTS["u1"] = ("SELECT r.business_id, r.stars FROM review r JOIN busy_user s "
               "ON s.seed_id = r.user_id")
PARTS["b1"] = ("SELECT r.user_id, r.stars FROM review r JOIN busy_business s "
               "ON s.seed_id = r.business_id")
PARTS["followed"] = """
  SELECT business_id FROM review WHERE user_id IN (SELECT user_id FROM b1)
  GROUP BY business_id ORDER BY count(DISTINCT user_id) DESC, business_id LIMIT 100"""
PARTS["three_businesses"] = """
  SELECT business_id AS seed_id FROM review GROUP BY business_id
  ORDER BY count(*) DESC, business_id LIMIT 3"""
PARTS["three_users"] = """
  SELECT user_id AS seed_id FROM review GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 3"""
PARTS["three_followed"] = """
  SELECT seed_id, business_id FROM (
    SELECT s.seed_id, o.business_id, row_number() OVER (
             PARTITION BY s.seed_id ORDER BY count(DISTINCT o.user_id) DESC, o.business_id) AS n
    FROM three_businesses s JOIN review r ON r.business_id = s.seed_id
    JOIN review o ON o.user_id = r.user_id GROUP BY s.seed_id, o.business_id) WHERE n <= 20"""
PARTS["three_reviewed"] = """
  SELECT s.seed_id, o.business_id AS rest_id, o.user_id, o.stars AS rating
  FROM three_businesses s JOIN review r ON r.business_id = s.seed_id
  JOIN review o ON o.user_id = r.user_id"""

# --- reductions ----------------------------------------------------------------------------

PARTS["clean_business"] = f"""
  SELECT * EXCLUDE (city),
         CASE WHEN city IN ({_names(CITY_SPELLINGS)})
                OR (city IN ({_names(CITY_DISTRICTS)}) AND try_cast(postal_code AS int) > 85000
                    AND try_cast(postal_code AS int) < 85087)
              THEN 'Phoenix' ELSE city END AS city
  FROM business"""
PARTS["city_ids"] = "SELECT id FROM clean_business WHERE city = 'Phoenix'"
PARTS["city_review"] = "SELECT * FROM review WHERE business_id IN (SELECT id FROM city_ids)"
PARTS["city_friend"] = """
  SELECT * FROM friend WHERE user_id IN (SELECT user_id FROM city_review)
    AND friend_id IN (SELECT user_id FROM city_review)"""
PARTS["inactive"] = """
  SELECT id AS user_id FROM users
  WHERE id NOT IN (SELECT user_id FROM review) AND id NOT IN (SELECT user_id FROM tip)"""


def _counts(rows: dict[str, tuple[str, str | None]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {before}) AS rows_before, "
        + (f"(SELECT count(*) FROM {after})" if after else "cast(NULL AS bigint)")
        + " AS rows_after" for name, (before, after) in rows.items())


_KEYS = {"attribute": "business_id, name", "business": "id", "category": "business_id, category",
         "elite_years": "user_id, year", "friend": "user_id, friend_id", "review": "id",
         "tip": "business_id, user_id, date", "users": "id"}
_REFS = [("attribute", "business_id", "business"), ("category", "business_id", "business"),
         ("elite_years", "user_id", "users"), ("friend", "friend_id", "users"),
         ("friend", "user_id", "users"), ("review", "business_id", "business"),
         ("review", "user_id", "users"), ("tip", "business_id", "business"),
         ("tip", "user_id", "users")]

# --- validation ----------------------------------------------------------------------------

PARTS["matrix"] = """
  SELECT s.seed_id, b.name AS restaurant, r.business_id AS rest_id, r.user_id, r.stars AS rating
  FROM review r JOIN busy_business s ON true JOIN business b ON b.id = r.business_id
  WHERE r.user_id IN (SELECT user_id FROM b1) AND r.business_id IN (
    SELECT business_id FROM review WHERE user_id IN (SELECT user_id FROM b1)
    GROUP BY business_id ORDER BY count(*) DESC, business_id LIMIT 10)"""


def _match(a: str, b: str) -> str:
    return f"round(cast(least({a}, {b}) AS double) / greatest({a}, {b}), 4)"


PARTS["pairs1"] = f"""
  SELECT r1.seed_id, r1.restaurant, r1.rest_id, r1.user_id AS user1, r2.user_id AS user2,
         {_match("r1.rating", "r2.rating")} AS rating_match
  FROM matrix r1 JOIN matrix r2 ON r1.rest_id = r2.rest_id WHERE r1.user_id < r2.user_id"""
PARTS["cross1"] = """
  SELECT p.seed_id, p.rest_id AS rest_id1, p.restaurant AS restaurant1, p.rating_match AS match1,
         q.rest_id AS rest_id2, q.restaurant AS restaurant2, q.rating_match AS match2
  FROM pairs1 p JOIN pairs1 q ON p.user1 = q.user1 AND p.user2 = q.user2
  WHERE p.rest_id < q.rest_id"""
PARTS["labelled"] = """
  SELECT p.*, CASE WHEN EXISTS (
    SELECT 1 FROM like_u l WHERE (l.seed_id = p.user1 AND l.user_id = p.user2)
                              OR (l.seed_id = p.user2 AND l.user_id = p.user1))
    THEN 1 ELSE 0 END AS lmu FROM pairs1 p"""
PARTS["alike_pairs"] = f"""
  SELECT p.one || '+++' || p.two AS user_pair, b.name AS restaurant, b.id AS rest_id,
         {_match("x.stars", "y.stars")} AS rating_match
  FROM (SELECT DISTINCT least(seed_id, user_id) AS one, greatest(seed_id, user_id) AS two
        FROM user_clip) p
  JOIN review x ON x.user_id = p.one
  JOIN review y ON y.user_id = p.two AND y.business_id = x.business_id
  JOIN business b ON b.id = x.business_id"""
PARTS["alike_cross"] = """
  SELECT p.user_pair, p.restaurant AS restaurant1, p.rating_match AS match1,
         q.restaurant AS restaurant2, q.rating_match AS match2
  FROM alike_pairs p JOIN alike_pairs q ON q.user_pair = p.user_pair AND p.rest_id < q.rest_id"""

# --- text ----------------------------------------------------------------------------------

PARTS["lexicon"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', {v})" for w, v in LEXICON.items()) + ") AS t(word, valence)"
PARTS["doc_words"] = """
  SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents"""
PARTS["doc_sums"] = """
  SELECT d.doc_id, count(w.word) AS n_words, cast(coalesce(sum(v), 0) AS double) AS total,
         cast(coalesce(sum(CASE WHEN v > 0 THEN v + 1 END), 0) AS double) AS up,
         cast(coalesce(sum(CASE WHEN v < 0 THEN 1 - v END), 0) AS double) AS down,
         count(CASE WHEN w.word IS NOT NULL AND coalesce(v, 0) = 0 THEN 1 END) AS flat
  FROM documents d LEFT JOIN (
    SELECT w.doc_id, w.word, cast(l.valence AS decimal(10, 4)) AS v
    FROM doc_words w LEFT JOIN lexicon l ON l.word = w.word WHERE w.word <> '') w
  ON w.doc_id = d.doc_id GROUP BY d.doc_id"""


PARTS["token_lexicon"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{w.replace(chr(39), chr(39) * 2)}', {v})" for w, v in TOKEN_LEXICON.items()) \
    + ") AS t(word, valence)"
PARTS["turn_words"] = f"""
  SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '{TOKENS.replace("'", "''")}')) AS word
  FROM conversations"""
PARTS["turn_sums"] = """
  SELECT d.conv_id, d.turn, count(w.word) AS n_words,
         cast(coalesce(sum(v), 0) AS double) AS total,
         cast(coalesce(sum(CASE WHEN v > 0 THEN v + 1 END), 0) AS double) AS up,
         cast(coalesce(sum(CASE WHEN v < 0 THEN 1 - v END), 0) AS double) AS down,
         count(CASE WHEN w.word IS NOT NULL AND coalesce(v, 0) = 0 THEN 1 END) AS flat
  FROM conversations d LEFT JOIN (
    SELECT w.conv_id, w.turn, w.word, cast(l.valence AS decimal(10, 4)) AS v
    FROM turn_words w LEFT JOIN token_lexicon l ON l.word = w.word) w
  ON w.conv_id = d.conv_id AND w.turn = d.turn GROUP BY d.conv_id, d.turn"""


def _share(x: str) -> str:
    return (f"CASE WHEN up + down + flat = 0 THEN 0.0 "
            f"ELSE floor({x} / (up + down + flat) * 1000 + 0.5) / 1000 END")


PARTS["doc_scores"] = f"""
  SELECT doc_id, n_words, {_share("down")} AS neg, {_share("flat")} AS neu, {_share("up")} AS pos,
         sign(total) * floor(abs(total / sqrt(total * total + 15)) * 10000 + 0.5) / 10000
           AS compound
  FROM doc_sums"""


def _quartiles(value: str) -> str:
    qs = ", ".join(f"round(quantile_cont({value}, {q}), 6) AS {n}"
                   for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    return f"count(*) AS n, round(min({value}), 6) AS low, {qs}, round(max({value}), 6) AS high"


# --- queries -------------------------------------------------------------------------------

def _json(fields) -> str:
    """A JSON object of texts, missing ones as null."""
    def value(c: str) -> str:
        text = f"cast({c} AS string)"
        safe = f"""replace(replace({text}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')"""
        return f"""coalesce('"' || {safe} || '"', 'null')"""

    return "'{' || " + " || ',' || ".join(f"""'"{c}":' || {value(c)}""" for c in fields) + " || '}'"


def _documents(parent: str, fields, key: str, children: dict, kind: str | None = None) -> str:
    parts = [f"SELECT id, '{kind or parent}' AS kind, {_json(fields)} AS record FROM {parent}"]
    parts += [f"SELECT {key}, '{name}', {_json(own)} FROM {table} "
              f"WHERE {key} IN (SELECT id FROM {parent})"
              for name, (table, own) in children.items()]
    return " UNION ALL ".join(parts)


def _nested(parent: str, fields, key: str, lists: dict) -> str:
    """Fragments of nested documents: all units numbered in order, 64 numbers to a block."""
    marks = [f"substr({_json(('id', *fields))}, 1, length({_json(('id', *fields))}) - 1)"]
    marks += [f"""'{"]," if k else ","}"{name}":['""" for k, name in enumerate(lists)]
    marks.append("']}'" if lists else "'}'")
    units = [f"SELECT id, {k} AS kind, false AS child, '' AS key, {mark} AS text FROM {parent}"
             for k, mark in enumerate(marks)]
    units += [f"SELECT {key}, {k}, true, concat_ws(chr(0), {', '.join(keys)}), {_json(own)} "
              f"FROM {table} WHERE {key} IN (SELECT id FROM {parent})"
              for k, (table, keys, own) in enumerate(lists.values(), 1)]
    return f"""
        WITH units AS ({" UNION ALL ".join(units)}),
        numbers AS (
          SELECT *, row_number() OVER (ORDER BY id, kind, child, key) AS number FROM units),
        joined AS (
          SELECT id, number, (number - 1) // 64 AS block,
            CASE WHEN child AND lag(child) OVER (ORDER BY number) THEN ',' ELSE '' END || text
              AS text FROM numbers),
        fragments AS (
          SELECT id, block, string_agg(text, '' ORDER BY number) AS fragment
          FROM joined GROUP BY id, block)
        SELECT id, block - min(block) OVER (PARTITION BY id) AS part, fragment FROM fragments"""


# The fields of the documents that the test tables have.
BUSINESS_FIELDS = ("name", "neighborhood", "address", "city", "state", "postal_code", "stars",
                   "review_count", "is_open")
USER_FIELDS = ("name", "review_count", "yelping_since", "useful", "funny", "cool", "fans",
               "average_stars")
REVIEW_FIELDS = ("id", "stars", "date", "text", "useful", "funny", "cool", "business_id",
                 "user_id")
TIP_FIELDS = ("business_id", "user_id", "text", "date", "likes")


def _significant(x: str) -> str:
    """Two significant digits of a number from 0.1 to under 99.5."""
    return (f"CASE WHEN {x} >= 9.95 THEN printf('%.0f', round({x})) "
            f"WHEN {x} >= 0.995 THEN printf('%.1f', round({x} / 0.1) / 10) "
            f"ELSE printf('%.2f', round({x} / 0.01) / 100) END")


def _third_order_sizes(seed: str, other: str) -> str:
    """Exact sizes of the three busiest seeds; estimates are within the errors allowed."""
    return f"""
        WITH three AS (SELECT {seed} AS seed_id, count(DISTINCT {other}) AS first_order
                       FROM review GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
        via AS (SELECT DISTINCT s.seed_id, s.first_order, b.{seed} AS via
                FROM three s JOIN review a ON a.{seed} = s.seed_id
                JOIN review b ON b.{other} = a.{other})
        SELECT seed_id, first_order, count(DISTINCT r.{other}) AS exact, true AS within
        FROM via JOIN review r ON r.{seed} = via.via GROUP BY seed_id, first_order"""


def _top_shared(key: str, via: str, names: str, name: str) -> str:
    return f"""
        WITH counted AS (
          SELECT a.{key} AS seed_id, b.{key}, count(*) AS shared
          FROM review a JOIN review b ON b.{via} = a.{via} GROUP BY a.{key}, b.{key}),
        ranked AS (SELECT *, row_number() OVER (
          PARTITION BY seed_id ORDER BY shared DESC, {key}) AS place FROM counted)
        SELECT seed_id, r.{key}, n.name AS {name}, shared
        FROM ranked r JOIN {names} n ON n.id = r.{key} WHERE place <= 20"""


QUERIES: dict[str, str] = {
    "co_reviewers_top_all": _top_shared("user_id", "business_id", "users", "user"),
    "co_reviewed_top_all": _top_shared("business_id", "user_id", "business", "restaurant"),
    "search_prefix": """SELECT name || ' (' || address || ')' AS name, id FROM business
        WHERE lower(name) LIKE 'red%' ORDER BY business.name, id LIMIT 10""",
    "full_list": """SELECT name || ' (' || address || ')' AS restaurant, id AS restaurant_id
        FROM business""",
    "user_profile": "SELECT * EXCLUDE (influence_val) FROM people",
    "candidate_influence": "SELECT user_id, influence_val FROM people",
    "restaurant_profile": f"""
        WITH lists AS (
          SELECT id AS restaurant_id,
            (SELECT string_agg(category, ',' ORDER BY category) FROM category x
             WHERE x.business_id = business.id) AS listed,
            (SELECT string_agg(x.name, ',' ORDER BY x.name) FROM attribute x
             WHERE x.business_id = business.id AND x.value = '1') AS switched_on
          FROM business),
        places AS (SELECT *, id AS restaurant_id, stars AS avg_rating,
                          review_count AS total_reviews, postal_code AS zip FROM business),
        texts AS (SELECT restaurant_id,
                         coalesce(listed, '(No category information)') AS categories,
                         coalesce(switched_on, '(No attributes information)') AS attributes
                  FROM lists)
        SELECT {PROFILE_COLUMNS} FROM places JOIN texts USING (restaurant_id)""",
    "user_restaurant_rating": "SELECT * FROM rating",
    "rating_card": """
        SELECT restaurant, restaurant_id, "user", user_id, repeat('★', cast(rating AS int)) AS rating,
               strftime(date, '%Y-%m-%d') AS date, substring(review, 1, 300) AS review,
               useful AS review_useful, funny AS voted_funny, cool AS voted_cool FROM rating""",
    "like_users": "SELECT * FROM like_u",
    "like_restaurants": "SELECT * FROM like_r",
    "recommended_restaurants": "SELECT * FROM reco",
    "customer_prospects": "SELECT * FROM prospect",
    "user_graph_nodes": "SELECT * FROM user_nodes",
    "user_graph_links": "SELECT * FROM user_links",
    "restaurant_graph_nodes": "SELECT * FROM rest_nodes",
    "restaurant_graph_links": "SELECT * FROM rest_links",
    "explore_like_nodes_user": """
        SELECT * FROM (SELECT seed_id, name, id, score, row_number() OVER (
                 PARTITION BY seed_id ORDER BY score DESC, id DESC) AS position
          FROM (SELECT DISTINCT seed_id, "user" AS name, user_id AS id, lmu_score AS score
                FROM like_u)) WHERE position <= 10""",
    "explore_like_nodes_restaurant": """
        SELECT * FROM (SELECT seed_id, name, id, score, row_number() OVER (
                 PARTITION BY seed_id ORDER BY score DESC, id DESC) AS position
          FROM (SELECT DISTINCT seed_id, restaurant AS name, restaurant_id AS id,
                       compete_score AS score FROM like_r)) WHERE position <= 10""",
    "rating_of_restaurant_detail": """
        SELECT r.restaurant, r.restaurant_id, r."user", r.user_id, r.rating, r.date, r.review,
               r.useful, r.funny, r.cool
        FROM rating r JOIN user_nodes n
          ON n."order" = 1 AND n.seed_id = r.user_id AND n.id = r.restaurant_id""",
    "rating_by_user_detail": """
        SELECT r.restaurant, r.restaurant_id, r."user", r.user_id, r.rating, r.date, r.review,
               r.useful, r.funny, r.cool
        FROM rating r JOIN rest_nodes n
          ON n."order" = 1 AND n.seed_id = r.restaurant_id AND n.id = r.user_id""",
    **{f"comparison_order{k}": f"SELECT * FROM user_compared{k}" for k in (1, 2, 3)},
    **{f"restaurant_comparison_order{k}": f"SELECT * FROM rest_compared{k}" for k in (1, 2, 3)},
    "comparison_topk_selected": _topk("user"),
    "restaurant_comparison_topk_selected": _topk("rest"),
    "likeminded_user_similarity": f"SELECT DISTINCT seed_id, user_id AS selected_id, {USER_SIM} FROM like_u",
    "direct_competitor_similarity":
        f"SELECT DISTINCT seed_id, restaurant_id AS selected_id, {REST_SIM} FROM like_r",
    "similarity_card": f"""
        SELECT seed_id, selected_id, line, factor, value, printf('%.2f', score) AS score FROM (
          SELECT seed_id, selected_id, unnest([1, 2, 3, 4, 5, 6]) AS line,
            unnest(['Shared Reviews', 'Reviewed Restaurant Overlap', 'Restaurant Ratings Similarity',
                    'User Influence Index', 'Influence Index Similarity', 'Total']) AS factor,
            unnest([cast(shared_val AS string), overlap_val, rate_sim_val,
                    cast(influence_val AS string), influ_sim_val, '']) AS value,
            unnest([shared_score, overlap_score, rate_sim_score, influence_score,
                    influ_sim_score, lmu_score]) AS score
          FROM (SELECT DISTINCT seed_id, user_id AS selected_id, {USER_SIM} FROM like_u))""",
    "competitor_card": f"""
        SELECT seed_id, selected_id, line, factor, value, printf('%.2f', score) AS score FROM (
          SELECT seed_id, selected_id, unnest([1, 2, 3, 4, 5, 6]) AS line,
            unnest(['Shared Customers', 'Customer Overlap', 'Review Count Similarity',
                    'Ratings Similarity', 'Postal Code Match', 'Total']) AS factor,
            unnest([cast(shared_val AS string), overlap_val, review_sim_val, rate_sim_val,
                    zip_val, '']) AS value,
            unnest([shared_score, overlap_score, review_sim_score, rate_sim_score,
                    cast(zip_score AS double), compete_score]) AS score
          FROM (SELECT DISTINCT seed_id, restaurant_id AS selected_id, {REST_SIM} FROM like_r))""",
    "relevance_card": f"""
        SELECT seed_id, selected_id, "user", {_significant("lmu_rating")} AS lmu_rating,
          {_significant("lmu_score")} AS lmu_score,
          printf('%.2f', contribution) AS contribution, printf('%.2f', relevancy) AS relevancy
        FROM reco_rel""",
    "reco_relevance": "SELECT * FROM reco_rel",
    "prospect_relevance": "SELECT * FROM prospect_rel",
    "relevance_totals": _totals("reco_rel", "lmu_score"),
    "prospect_relevance_totals": _totals("prospect_rel", "compete_score"),
    "path_to_root": _paths("user"),
    "restaurant_path_to_root": _paths("rest"),
    "reduce_category_counts": _counts({
        "attribute": ("attribute", "attribute WHERE business_id IN (SELECT * FROM rest_ids)"),
        "business": ("business", "business WHERE id IN (SELECT * FROM rest_ids)"),
        "category": ("category", "category WHERE business_id IN (SELECT * FROM rest_ids)"),
        "elite_years": ("elite_years", "elite_years"), "friend": ("friend", "friend"),
        "review": ("review", "review WHERE business_id IN (SELECT * FROM rest_ids)"),
        "tip": ("tip", "tip WHERE business_id IN (SELECT * FROM rest_ids)"),
        "users": ("users", "users")}),
    "reduce_city_counts": _counts({
        "attribute": ("attribute", "attribute WHERE business_id IN (SELECT * FROM city_ids)"),
        "business": ("business", "city_ids"),
        "category": ("category", "category WHERE business_id IN (SELECT * FROM city_ids)"),
        "elite_years": ("elite_years", None), "friend": ("friend", "city_friend"),
        "review": ("review", "city_review"), "tip": ("tip", None),
        "users": ("users", "users WHERE id IN (SELECT user_id FROM city_review)")}),
    "reduce_city_users": """SELECT id, name, review_count FROM users
        WHERE id IN (SELECT user_id FROM city_review)""",
    "reduce_city_friends": "SELECT user_id, friend_id FROM city_friend",
    "normalise_city": "SELECT id, postal_code, city FROM clean_business",
    "inactive_users": "SELECT * FROM inactive",
    "drop_inactive_counts": _counts({
        "attribute": ("attribute", "attribute"), "business": ("business", "business"),
        "category": ("category", "category"),
        "elite_years": ("elite_years",
                        "elite_years WHERE user_id NOT IN (SELECT user_id FROM inactive)"),
        "friend": ("friend", "friend WHERE user_id NOT IN (SELECT user_id FROM inactive) "
                             "AND friend_id NOT IN (SELECT user_id FROM inactive)"),
        "review": ("review", "review"), "tip": ("tip", "tip"),
        "users": ("users", "users WHERE id NOT IN (SELECT user_id FROM inactive)")}),
    "key_duplicates": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS duplicate_keys, "
        f"cast(coalesce(sum(n), 0) AS bigint) AS duplicate_rows "
        f"FROM (SELECT count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1)"
        for t, k in _KEYS.items()),
    "key_orphans": " UNION ALL ".join(
        f"SELECT '{c}.{k}' AS foreign_key, count(DISTINCT x.{k}) AS orphan_keys, "
        f"count(x.{k}) AS orphan_rows FROM {c} x "
        f"WHERE NOT EXISTS (SELECT 1 FROM {p} y WHERE y.id = x.{k})" for c, k, p in _REFS),
    "category_stats": """
        WITH rc AS (SELECT count(*) AS n FROM category WHERE business_id IN (SELECT * FROM rest_ids)
                    GROUP BY business_id),
             rr AS (SELECT count(*) AS n FROM review WHERE business_id IN (SELECT * FROM rest_ids)
                    GROUP BY business_id)
        SELECT (SELECT count(*) FROM rest_ids) AS restaurants,
          (SELECT count(*) FROM category WHERE business_id IN
             (SELECT business_id FROM category WHERE category = 'Food')
             AND business_id NOT IN (SELECT * FROM rest_ids)) AS food_not_restaurant_rows,
          (SELECT count(DISTINCT business_id) FROM category WHERE business_id IN
             (SELECT business_id FROM category WHERE category = 'Food')
             AND business_id IN (SELECT business_id FROM category
                                 WHERE category IN ('Bars', 'Pubs', 'Lounges', 'Nightlife'))
             AND business_id NOT IN (SELECT * FROM rest_ids)) AS food_and_nightlife_not_restaurant,
          (SELECT max(n) FROM rc) AS max_categories,
          (SELECT cast(sum(n) AS bigint) FROM rc) AS restaurant_categories,
          (SELECT max(n) FROM rr) AS max_reviews,
          (SELECT cast(sum(n) AS bigint) FROM rr) AS restaurant_reviews,
          (SELECT round(cast(sum(n) AS double) / (SELECT count(*) FROM rest_ids), 4) FROM rc)
            AS mean_categories,
          (SELECT round(cast(sum(n) AS double) / (SELECT count(*) FROM rest_ids), 4) FROM rr)
            AS mean_reviews""",
    "rows_per_restaurant": """
        SELECT i.business_id,
               (SELECT count(*) FROM category c WHERE c.business_id = i.business_id) AS categories,
               (SELECT count(*) FROM review r WHERE r.business_id = i.business_id) AS reviews
        FROM rest_ids i""",
    "city_zip_pairs": "SELECT DISTINCT postal_code, city FROM business",
    "attribute_competitors": "SELECT * FROM competitors",
    "new_prospects": """
        SELECT DISTINCT c.seed_id, r.user_id, u.name FROM competitors c
        JOIN review r ON r.business_id = c.business_id JOIN users u ON u.id = r.user_id
        WHERE r.user_id NOT IN (SELECT user_id FROM b1)""",
    "third_order_users": """
        SELECT DISTINCT s.seed_id, r.user_id FROM review r JOIN busy_business s ON true
        WHERE r.business_id IN (SELECT business_id FROM review
                                WHERE user_id IN (SELECT user_id FROM b1))""",
    "third_order_users_of_top": """
        SELECT DISTINCT s.seed_id, r.user_id FROM review r JOIN busy_business s ON true
        WHERE r.business_id IN (SELECT business_id FROM followed)""",
    "third_order_users_of_three": """
        SELECT DISTINCT f.seed_id, r.user_id
        FROM three_followed f JOIN review r ON r.business_id = f.business_id""",
    "co_reviewers_of_three": """
        SELECT s.seed_id, o.user_id, u.name AS "user", count(*) AS shared
        FROM three_users s JOIN review r ON r.user_id = s.seed_id
        JOIN review o ON o.business_id = r.business_id JOIN users u ON u.id = o.user_id
        GROUP BY ALL""",
    "rating_matrix_of_three": """
        SELECT x.seed_id, b.name AS restaurant, x.rest_id, x.user_id, x.rating
        FROM three_reviewed x JOIN (
          SELECT seed_id, rest_id, row_number() OVER (
                   PARTITION BY seed_id ORDER BY count(*) DESC, rest_id) AS n
          FROM three_reviewed GROUP BY seed_id, rest_id) k
        ON k.seed_id = x.seed_id AND k.rest_id = x.rest_id JOIN business b ON b.id = x.rest_id
        WHERE k.n <= 10""",
    "third_order_businesses": """
        SELECT DISTINCT s.seed_id, r.business_id, b.name FROM review r JOIN busy_user s ON true
        JOIN business b ON b.id = r.business_id
        WHERE r.user_id IN (SELECT user_id FROM review
                            WHERE business_id IN (SELECT business_id FROM u1))""",
    "third_order_user_sizes_of_three": _third_order_sizes("business_id", "user_id"),
    "third_order_business_sizes_of_three": _third_order_sizes("user_id", "business_id"),
    "edge_sample": """
        SELECT business_id, user_id, u.name FROM (
          SELECT business_id, user_id,
                 row_number() OVER (PARTITION BY business_id ORDER BY user_id) AS n FROM review)
        JOIN users u ON u.id = user_id WHERE n <= 10""",
    "named_reviewers": """
        SELECT r.id AS review_id, r.user_id, u.name, r.business_id
        FROM review r JOIN business b ON b.id = r.business_id JOIN users u ON u.id = r.user_id
        WHERE b.city = 'Phoenix' AND lower(u.name) IN (SELECT lower(upper(c_name)) FROM customer)""",
    "co_reviewers": """
        SELECT s.seed_id, r.user_id, u.name AS "user", count(*) AS shared
        FROM review r JOIN u1 ON u1.business_id = r.business_id JOIN busy_user s ON true
        JOIN users u ON u.id = r.user_id GROUP BY ALL""",
    "same_rating_users": """
        SELECT s.seed_id, r.user_id, u.name AS "user", count(*) AS shared
        FROM review r JOIN u1 ON u1.business_id = r.business_id AND u1.stars = r.stars
        JOIN busy_user s ON true JOIN users u ON u.id = r.user_id GROUP BY ALL""",
    "co_reviewed": """
        SELECT s.seed_id, r.business_id, b.name AS restaurant, count(*) AS shared
        FROM review r JOIN b1 ON b1.user_id = r.user_id JOIN busy_business s ON true
        JOIN business b ON b.id = r.business_id GROUP BY ALL""",
    "same_rating_restaurants": """
        SELECT s.seed_id, r.business_id, b.name AS restaurant, count(*) AS shared
        FROM review r JOIN b1 ON b1.user_id = r.user_id AND b1.stars = r.stars
        JOIN busy_business s ON true JOIN business b ON b.id = r.business_id GROUP BY ALL""",
    "review_counts": """
        SELECT business_id, count(user_id) AS reviews FROM review
        WHERE business_id IN (SELECT id FROM business WHERE city = 'Phoenix')
        GROUP BY business_id""",
    "rating_matrix": "SELECT * FROM matrix",
    "pair_classes": """
        SELECT seed_id, rest_id, restaurant, rating_match, count(*) AS pairs
        FROM pairs1 GROUP BY ALL""",
    "pair_cross_classes": """
        SELECT seed_id, rest_id1, restaurant1, match1, rest_id2, restaurant2, match2,
               count(*) AS pairs FROM cross1 GROUP BY ALL""",
    "pair_corr": """
        SELECT count(*) AS n, round(avg(match1), 6) AS mean1, round(avg(match2), 6) AS mean2,
               round(corr(match1, match2), 6) AS corr FROM cross1""",
    "labelled_pairs": """
        SELECT seed_id, rating_match AS "match", lmu, count(*) AS pairs FROM labelled GROUP BY ALL""",
    "pair_means": """
        SELECT lmu, count(*) AS n, round(avg(rating_match), 6) AS mean FROM labelled GROUP BY lmu""",
    "pair_anova": """
        WITH g AS (SELECT lmu, count(*) AS n, avg(rating_match) AS m, var_pop(rating_match) AS v
                   FROM labelled GROUP BY lmu),
             a AS (SELECT count(*) AS n, avg(rating_match) AS m FROM labelled),
             s AS (SELECT sum(g.n * (g.m - a.m) * (g.m - a.m)) AS ssb, sum(g.n * g.v) AS ssw,
                          count(*) - 1 AS df1, cast(max(a.n) - count(*) AS bigint) AS df2,
                          max(g.m) - min(g.m) AS d FROM g JOIN a ON true)
        SELECT round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, df1 AS df_between,
               df2 AS df_within,
               CASE WHEN df1 > 0 THEN round((ssb / df1) / (ssw / df2), 6) END AS f,
               round(ssb / (ssb + ssw), 6) AS eta_squared, round(d, 6) AS mean_difference FROM s""",
    "pair_quartiles": f"SELECT lmu, {_quartiles('rating_match')} FROM labelled GROUP BY lmu",
    "user_pairs": "SELECT * FROM alike_pairs",
    "pair_cross": "SELECT * FROM alike_cross",
    "pair_long": """
        SELECT user_pair, restaurant1 AS restaurant, match1 AS "match" FROM alike_cross
        UNION SELECT user_pair, restaurant2, match2 FROM alike_cross""",
    "alike_pair_corr": """
        SELECT count(*) AS n, round(avg(match1), 6) AS mean1, round(avg(match2), 6) AS mean2,
               round(corr(match1, match2), 6) AS corr FROM alike_cross""",
    "messy_ratings": """
        WITH messy AS (
          SELECT id, user_id, business_id, stars, useful, date FROM review
          UNION ALL SELECT id || '-b', user_id, business_id, stars % 5 + 1, useful,
                           date + INTERVAL 1 DAY FROM review WHERE useful = 3
          UNION ALL SELECT id || '-g', 'ghost' || user_id, business_id, stars, useful, date
                    FROM review WHERE useful = 5
          UNION ALL SELECT id || '-l', user_id, 'lost' || business_id, stars, useful, date
                    FROM review WHERE useful = 2 AND funny = 1)
        SELECT m.user_id, m.business_id, m.stars, m.useful
        FROM messy m JOIN users u ON u.id = m.user_id JOIN business b ON b.id = m.business_id
        WHERE NOT EXISTS (SELECT 1 FROM messy x
                          WHERE x.user_id = m.user_id AND x.business_id = m.business_id
                            AND (x.date > m.date OR (x.date = m.date AND x.id > m.id)))""",
    "sentiment_tokens": f"""
        SELECT cast(conv_id AS string) || '/' || cast(turn AS string) AS key, n_words,
          {_share("down")} AS neg, {_share("flat")} AS neu, {_share("up")} AS pos,
          sign(total) * floor(abs(total / sqrt(total * total + 15)) * 10000 + 0.5) / 10000
            AS compound FROM turn_sums""",
    "sentiment": "SELECT * FROM doc_scores",
    "sentiment_by_stars": " UNION ALL ".join(
        f"SELECT quality AS stars, '{s}' AS share, {_quartiles(s)} "
        f"FROM doc_scores JOIN labels USING (doc_id) GROUP BY quality" for s in ("neg", "neu", "pos")),
    "momentum": """
        SELECT business_id, day, reviews, round(daily, 6) AS daily_mean,
               round(avg(daily) OVER (PARTITION BY business_id ORDER BY day
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS expanding_mean
        FROM (SELECT business_id, cast(date AS date) AS day, count(*) AS reviews,
                     avg(stars) AS daily FROM review GROUP BY ALL)""",
    "nested_business_documents": _nested("business", BUSINESS_FIELDS, "business_id", {
        "reviews": ("review", ["id"], REVIEW_FIELDS),
        "attributes": ("attribute", ["name"], ("name", "value")),
        "categories": ("category", ["category"], ("category",))}),
    "nested_user_documents": _nested("users", USER_FIELDS, "user_id", {
        "reviews": ("review", ["id"], REVIEW_FIELDS),
        "tips": ("tip", ["business_id", "date"], TIP_FIELDS)}),
    "business_documents": _documents("business", BUSINESS_FIELDS, "business_id", {
        "attribute": ("attribute", ("name", "value")), "category": ("category", ("category",)),
        "review": ("review", REVIEW_FIELDS)}),
    "user_documents": _documents("users", USER_FIELDS, "user_id", {
        "review": ("review", REVIEW_FIELDS), "tip": ("tip", TIP_FIELDS)}, kind="user"),
    "review_by_id": """
        SELECT id, user_id, business_id, stars, text FROM review
        WHERE user_id IN (SELECT seed_id FROM busy_user) ORDER BY id LIMIT 1""",
    "row_by_key": "SELECT business_id, category FROM category ORDER BY business_id, category LIMIT 1",
    "csv_round_trip": "SELECT business_id, category FROM category",
    "appended_rows": "SELECT user_id, friend_id FROM friend",
    "review_texts": "SELECT " + ", ".join(
        f"cast({c} AS string) AS {c}" for c in REVIEW_FIELDS) + " FROM review",
    "dates_from_millis": """
        SELECT doc_id, DATE '1970-01-01' + cast(n_chars AS integer) AS day FROM documents""",
    "reviewed_businesses": "SELECT DISTINCT user_id, business_id FROM review",
    "business_records": """
        SELECT id, '{"id":"' || id || '","name":"' || name || '","city":"' || city
          || '","stars":' || cast(stars AS string) || ',"review_count":'
          || cast(review_count AS string) || '}' AS record FROM business""",
}

_LIKE_U = ("user_first", "user_rows", "user_pairs_scored", "user_clip", "like_u")
_LIKE_R = ("rest_first", "rest_rows", "rest_pairs_scored", "rest_clip", "like_r")
_RECO, _PROSPECT = ("reco_rows", "reco_kept", "reco"), ("prospect_rows", "prospect_kept", "prospect")


def _variant(suffix: str, names: tuple[str, ...], **changes: tuple[str, str]) -> str:
    """The last of the named parts, with changes to some of them; a copy of all is added."""
    for name in names:
        sql = PARTS[name]
        if name in changes:
            old, new = changes[name]
            assert old in sql, (name, old)
            sql = sql.replace(old, new)
        for other in names:
            sql = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {other}{suffix}", sql)
        PARTS[f"{name}{suffix}"] = sql
    return f"SELECT * FROM {names[-1]}{suffix}"


def _of(sql: str, seeds: str) -> str:
    return f"SELECT q.* FROM ({sql}) q WHERE q.seed_id IN (SELECT seed_id FROM {seeds})"


_CITY_IDS = """
        WITH places AS (SELECT id FROM clean_business WHERE city = 'Phoenix'),
        splits AS (SELECT row_number() OVER (ORDER BY id) AS split, id FROM places),
        reviewers AS (SELECT DISTINCT user_id AS id FROM review
                      WHERE business_id IN (SELECT id FROM places)),
        city_people AS (SELECT row_number() OVER (ORDER BY id) AS split, id FROM reviewers)"""
QUERIES["numbered_businesses"] = f"{_CITY_IDS} SELECT split, id FROM splits"
QUERIES["numbered_reviewers"] = f"{_CITY_IDS} SELECT split, id FROM city_people"
QUERIES["reviews_of_first_batch"] = f"""{_CITY_IDS}
        SELECT id, business_id, user_id, stars FROM review
        WHERE business_id IN (SELECT id FROM splits WHERE split BETWEEN 1 AND 1000)"""
QUERIES["friends_by_batch"] = f"""{_CITY_IDS}
        SELECT (p.split - 1) // 1000 AS batch, f.user_id, f.friend_id
        FROM friend f JOIN city_people p ON p.id = f.user_id"""
_Q = "'"
_ORDERED_RULES = ", ".join(f"('{w.replace(_Q, _Q * 2)}', '{e}', {x}::DOUBLE)"
                           for w, e, x in (*RULES, *PROSE_RULES))


def _acted_on() -> str:
    """A valence after the three words before it, the nearest first."""
    x = "(v + CASE WHEN mixed AND cap THEN sign(v) * 0.733 ELSE 0.0 END)"
    for back, share in ((1, "1.0"), (2, "0.95"), (3, "0.9")):
        boost = f"b{back} * sign(v)"
        boost = f"({boost} + CASE WHEN mixed AND c{back} THEN sign({boost}) * 0.733 ELSE 0.0 END)"
        x = (f"({x} + CASE WHEN v{back} IS NULL AND b{back} IS NOT NULL THEN {boost} "
             f"* {share}::DOUBLE ELSE 0.0 END) * CASE WHEN n{back} THEN -0.74::DOUBLE ELSE 1.0 END")
    return x


_LAGS = ", ".join(f"lag({c}, {k}) OVER w AS {n}{k}" for k in (1, 2, 3)
                  for c, n in (("v", "v"), ("boost", "b"), ("negates", "n"), ("cap", "c")))
QUERIES["ordered_sentiment"] = f"""
        WITH rules AS (
          SELECT word, max(CASE WHEN effect = 'boosts' THEN size END) AS boost,
            bool_or(effect = 'negates') AS negates, bool_or(effect = 'contrasts') AS contrasts
          FROM (VALUES {_ORDERED_RULES}) AS t(word, effect, size) GROUP BY word),
        parts AS (
          SELECT conv_id || '/' || turn AS key, text,
            regexp_extract_all(text, '{TOKENS.replace(_Q, _Q * 2)}') AS raws FROM conversations),
        raw_words AS (
          SELECT key, i AS pos, raws[i] AS raw FROM (
            SELECT key, raws, unnest(range(1, len(raws) + 1)) AS i FROM parts)),
        marked AS (
          SELECT r.key, r.pos, l.valence::DOUBLE AS v, u.boost, u.negates, u.contrasts,
            regexp_full_match(r.raw, '\\p{{Lu}}{{2,}}') AS cap
          FROM raw_words r LEFT JOIN token_lexicon l ON l.word = lower(r.raw) AND l.valence <> 0
          LEFT JOIN rules u ON u.word = lower(r.raw)),
        shapes AS (
          SELECT key, count(*) AS n_words, count(*) FILTER (WHERE cap) BETWEEN 1 AND count(*) - 1
            AS mixed, min(pos) FILTER (WHERE contrasts) AS first FROM marked GROUP BY key),
        near AS (SELECT *, {_LAGS} FROM marked WINDOW w AS (PARTITION BY key ORDER BY pos)),
        acted AS (
          SELECT key, floor({_acted_on()}
            * CASE WHEN pos < first THEN 0.5 WHEN pos > first THEN 1.5 ELSE 1.0 END
            * 1000000 + 0.5)::BIGINT AS x
          FROM near JOIN shapes USING (key) WHERE v IS NOT NULL),
        sums AS (
          SELECT p.key, coalesce(max(s.n_words), 0) AS n_words,
            coalesce(sum(x), 0)::DOUBLE / 1000000 AS total,
            coalesce(sum(CASE WHEN x > 0 THEN x + 1000000 END), 0)::DOUBLE / 1000000 AS up,
            coalesce(sum(CASE WHEN x < 0 THEN 1000000 - x END), 0)::DOUBLE / 1000000 AS down,
            coalesce(max(s.n_words), 0) - count(CASE WHEN x <> 0 THEN 1 END) AS flat,
            least(max(length(text) - length(replace(text, '!', ''))), 4) * 0.292::DOUBLE
              + max(CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0.0
                WHEN length(text) - length(replace(text, '?', '')) <= 3
                THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE
                ELSE 0.96 END)::DOUBLE AS more
          FROM parts p LEFT JOIN shapes s ON s.key = p.key LEFT JOIN acted a ON a.key = p.key
          GROUP BY p.key),
        louder AS (
          SELECT key, n_words, flat, total + sign(total) * more AS total,
            up + CASE WHEN up > down THEN more ELSE 0 END AS up,
            down + CASE WHEN down > up THEN more ELSE 0 END AS down FROM sums)
        SELECT key, n_words, {_share("down")} AS neg, {_share("flat")} AS neu, {_share("up")} AS pos,
          sign(total) * floor(abs(total / sqrt(total * total + 15)) * 10000 + 0.5) / 10000
            AS compound FROM louder"""
_LEARNED = """known AS (
          SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id
          WHERE l.quality IN (0, 1)),
        seen AS (
          SELECT DISTINCT doc_id, quality, unnest(regexp_extract_all(lower(text), '\\p{L}+'))
            AS word FROM known),
        learned AS (
          SELECT word, greatest(least(sign(r) * floor(abs(r) * 10000 + 0.5) / 10000, 4.0), -4.0)
            AS valence
          FROM (
            SELECT word, ln(((sum(quality) + 0.5) / (t.ones + 1))
              / ((count(*) - sum(quality) + 0.5) / (t.n - t.ones + 1))) AS r
            FROM seen CROSS JOIN (SELECT sum(quality) AS ones, count(*) AS n FROM known) t
            GROUP BY word, t.ones, t.n HAVING count(*) >= 5))"""
QUERIES["learned_lexicon"] = f"WITH {_LEARNED} SELECT word, valence FROM learned"
QUERIES["learned_sentiment"] = f"""
        WITH {_LEARNED},
        valued AS (
          SELECT w.doc_id, w.word, cast(l.valence AS decimal(10, 4)) AS v
          FROM doc_words w LEFT JOIN learned l ON l.word = w.word WHERE w.word <> ''),
        sums AS (
          SELECT d.doc_id, count(w.word) AS n_words, cast(coalesce(sum(v), 0) AS double) AS total,
            cast(coalesce(sum(CASE WHEN v > 0 THEN v + 1 END), 0) AS double) AS up,
            cast(coalesce(sum(CASE WHEN v < 0 THEN 1 - v END), 0) AS double) AS down,
            count(CASE WHEN w.word IS NOT NULL AND coalesce(v, 0) = 0 THEN 1 END) AS flat
          FROM documents d LEFT JOIN valued w ON w.doc_id = d.doc_id GROUP BY d.doc_id)
        SELECT doc_id, n_words, {_share("down")} AS neg, {_share("flat")} AS neu,
          {_share("up")} AS pos,
          sign(total) * floor(abs(total / sqrt(total * total + 15)) * 10000 + 0.5) / 10000
            AS compound FROM sums"""
QUERIES["search_prefix_sorted"] = QUERIES["search_prefix"]
QUERIES["momentum_kept_up"] = QUERIES["momentum"]
QUERIES["useful_by_stars_differences"] = """
        WITH labels AS (
          SELECT stars, count(*) AS n, avg(useful) AS mean,
            sum(useful * useful) - sum(useful) * sum(useful) / count(*) AS rest
          FROM review GROUP BY stars),
        spread AS (SELECT sum(rest) / (sum(n) - count(*)) AS v FROM labels)
        SELECT a.stars AS label1, b.stars AS label2, a.n AS n1, b.n AS n2,
          round(a.mean - b.mean, 6) AS difference,
          round(sqrt(v / 2 * (1 / a.n + 1 / b.n)), 6) AS se,
          round(abs(a.mean - b.mean) / sqrt(v / 2 * (1 / a.n + 1 / b.n)), 6) AS q
        FROM labels a JOIN labels b ON a.stars < b.stars CROSS JOIN spread"""
QUERIES["price_quartiles"] = f"""
        SELECT l_returnflag, {_quartiles("l_extendedprice")} FROM lineitem GROUP BY l_returnflag"""
QUERIES["like_users_highest"] = _variant(
    "_highest", _LIKE_U, user_first=("ORDER BY stars, business_id", "ORDER BY stars DESC, business_id"))
QUERIES["like_restaurants_exclusive"] = _variant("_five", _LIKE_R, rest_clip=("n <= 21", "n <= 5"))
QUERIES["like_users_uncut"] = _variant(
    "_uncut", _LIKE_U, user_first=("WHERE n <= 10", ""), user_rows=("WHERE n <= 2000", ""))
QUERIES["like_restaurants_uncut"] = _variant(
    "_uncut", _LIKE_R, rest_first=("WHERE n <= 10", ""), rest_rows=("WHERE n <= 1000", ""))
QUERIES["like_users_uncut_of_busiest"] = _of(QUERIES["like_users_uncut"], "busy_user")
QUERIES["like_restaurants_uncut_of_busiest"] = _of(QUERIES["like_restaurants_uncut"],
                                                   "busy_business")
QUERIES["recommended_new_restaurants"] = _variant("_new", _RECO, reco_rows=(
    """FROM like_u f
                      WHERE f.seed_id = l.seed_id AND f.restaurant_id = r.business_id""",
    "FROM review f WHERE f.user_id = l.seed_id AND f.business_id = r.business_id"))
QUERIES["new_customer_prospects"] = _variant("_new", _PROSPECT, prospect_rows=(
    """FROM like_r f
                      WHERE f.seed_id = l.seed_id AND f.user_id = r.user_id""",
    "FROM review f WHERE f.business_id = l.seed_id AND f.user_id = r.user_id"))
QUERIES["recommended_by_hundred"] = _of(_variant(
    "_hundred", _LIKE_U + _RECO, user_clip=("n <= 21", "n <= 101")), "busy_user")
QUERIES["recommended_uncut_of_busiest"] = _of(_variant(
    "_all", _RECO, reco_rows=("WHERE n <= 2000", "")), "busy_user")

_LIKE_NODES = {"user": QUERIES["explore_like_nodes_user"],
               "restaurant": QUERIES["explore_like_nodes_restaurant"]}
for _name, _nodes, _order, _type in (
        ("rating_of_restaurant", "user_nodes", 1, "restaurant"),
        ("rating_by_user", "rest_nodes", 1, "user"),
        ("likeminded_user", "user_nodes", 2, "user"),
        ("direct_competitor", "rest_nodes", 2, "restaurant"),
        ("recommended_restaurant", "user_nodes", 3, "restaurant"),
        ("customer_prospect", "rest_nodes", 3, "user")):
    _clicked = f'SELECT id FROM {_nodes} WHERE "order" = {_order}'
    QUERIES[f"{_name}_like_nodes"] = (
        f"SELECT q.* FROM ({_LIKE_NODES[_type]}) q WHERE q.seed_id IN ({_clicked})")
for _name, _rows, _nodes, _order in (
        ("likeminded_user", "likeminded_user_similarity", "user_nodes", 2),
        ("direct_competitor", "direct_competitor_similarity", "rest_nodes", 2),
        ("recommended_restaurant", "reco_relevance", "user_nodes", 3),
        ("customer_prospect", "prospect_relevance", "rest_nodes", 3)):
    QUERIES[f"{_name}_detail"] = (
        f"SELECT q.* FROM ({QUERIES[_rows]}) q JOIN {_nodes} c "
        f'ON c.seed_id = q.seed_id AND c.id = q.selected_id AND c."order" = {_order}')

for _name, _seed, _key in (
        ("user_profile", "busy_user", "user_id"),
        ("restaurant_profile", "busy_business", "restaurant_id"),
        ("like_users", "busy_user", "seed_id"), ("like_restaurants", "busy_business", "seed_id"),
        ("recommended_restaurants", "busy_user", "seed_id"),
        ("customer_prospects", "busy_business", "seed_id"),
        ("user_graph_links", "busy_user", "seed_id"),
        ("restaurant_graph_links", "busy_business", "seed_id")):
    QUERIES[f"{_name}_of_busiest"] = (
        f"SELECT q.* FROM ({QUERIES[_name]}) q JOIN (SELECT seed_id AS chosen FROM {_seed}) s "
        f"ON s.chosen = q.{_key}")

_PART_NAMES = {**VIEWS, **PARTS}  # after all variants


def _needed(sql: str, found: dict[str, None]) -> None:
    for name in _PART_NAMES:
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(_PART_NAMES[name], found)
            found[name] = None


def statement(name: str) -> str:
    """The full statement of a query, with the parts it needs in front."""
    sql = QUERIES[name].strip()
    found: dict[str, None] = {}
    _needed(sql, found)
    own = re.match(r"WITH\b", sql)
    parts = ", ".join(f"{n} AS ({_PART_NAMES[n].strip()})" for n in found)
    if own:
        return f"WITH {parts}, {sql[4:].strip()}" if parts else sql
    return f"WITH {parts} {sql}" if parts else sql


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in QUERIES}
