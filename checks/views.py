"""The review tables as views over the test tables.

The same text runs on Spark and on DuckDB. Customers and suppliers are the users, parts are
the businesses and a customer's line items of one part are a review. Friends are customers of
consecutive orders (and customers a supplier delivered to), so that their number grows with the
orders and not with the square of a group.
"""

BASE_TABLES = ("lineitem", "orders", "customer", "supplier", "part", "documents", "labels",
               "conversations")

VIEWS = {
    "review": """
  SELECT cast(o_custkey AS string) || '-' || cast(l_partkey AS string) AS id,
         cast(o_custkey AS string) AS user_id, cast(l_partkey AS string) AS business_id,
         1 + cast(sum(l_quantity) AS bigint) % 5 AS stars, max(o_orderdate) AS date,
         cast(sum(l_linenumber) AS bigint) % 8 AS useful,
         cast(sum(l_quantity) AS bigint) % 3 AS funny, cast(sum(l_quantity) AS bigint) % 4 AS cool,
         repeat('review of ' || cast(l_partkey AS string) || ' ', 30) AS text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "business": """
  SELECT cast(p_partkey AS string) AS id, p_name AS name, p_type AS neighborhood,
         'Lot ' || cast(p_partkey AS string) AS address,
         CASE p_size % 7 WHEN 1 THEN 'Pheonix' WHEN 2 THEN 'Phx' WHEN 3 THEN 'Anthem'
                         WHEN 4 THEN 'Mesa' WHEN 5 THEN 'Glendale' ELSE 'Phoenix' END AS city,
         'AZ' AS state, cast(85000 + p_partkey % 120 AS string) AS postal_code,
         floor(coalesce(r.s, 0) * 2 + 0.5) / 2 AS stars, coalesce(r.n, 0) AS review_count,
         CASE WHEN p_size % 11 = 0 THEN 0 ELSE 1 END AS is_open
  FROM part LEFT JOIN (SELECT business_id, avg(stars) AS s, count(*) AS n
                       FROM review GROUP BY business_id) r
    ON cast(p_partkey AS string) = r.business_id""",
    "users": """
  SELECT u.id, u.name, coalesce(r.n, 0) AS review_count, r.since AS yelping_since,
         coalesce(r.useful, 0) AS useful, coalesce(r.funny, 0) AS funny,
         coalesce(r.cool, 0) AS cool, u.fans, coalesce(r.s, 0) AS average_stars
  FROM (SELECT cast(c_custkey AS string) AS id, c_name AS name,
               cast(floor(abs(c_acctbal)) AS bigint) % 50 AS fans FROM customer
        UNION ALL
        SELECT 's' || cast(s_suppkey AS string), s_name,
               cast(floor(abs(s_acctbal)) AS bigint) % 50 FROM supplier) u
  LEFT JOIN (SELECT user_id, count(*) AS n, min(date) AS since, avg(stars) AS s,
                    cast(sum(useful) AS bigint) AS useful, cast(sum(funny) AS bigint) AS funny,
                    cast(sum(cool) AS bigint) AS cool
             FROM review GROUP BY user_id) r ON u.id = r.user_id""",
    "friend": """
  SELECT cast(a.o_custkey AS string) AS user_id, cast(b.o_custkey AS string) AS friend_id
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  WHERE a.o_custkey <> b.o_custkey
  UNION
  SELECT 's' || cast(l_suppkey AS string), cast(o_custkey AS string)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_linenumber = 1 AND l_returnflag = 'R'""",
    "category": """
  SELECT cast(p_partkey AS string) AS business_id, p_type AS category FROM part
  UNION SELECT cast(p_partkey AS string), p_brand FROM part
  UNION SELECT cast(p_partkey AS string), 'Restaurants' FROM part WHERE p_size % 3 = 0
  UNION SELECT cast(p_partkey AS string), 'Food' FROM part WHERE p_size % 4 = 0
  UNION SELECT cast(p_partkey AS string), 'Bars' FROM part WHERE p_size % 5 = 0""",
    "attribute": """
  SELECT cast(p_partkey AS string) AS business_id, 'Parking' AS name,
         cast(p_size % 2 AS string) AS value FROM part
  UNION ALL SELECT cast(p_partkey AS string), 'WiFi',
                   CASE WHEN p_size % 3 = 0 THEN '1' ELSE '0' END FROM part
  UNION ALL SELECT cast(p_partkey AS string), 'Ambience', '{"casual": true}'
            FROM part WHERE p_size % 4 = 0""",
    "tip": """
  SELECT cast(l_partkey AS string) AS business_id, cast(o_custkey AS string) AS user_id,
         max(o_orderdate) AS date, 'tip' AS text, count(*) AS likes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' GROUP BY l_partkey, o_custkey""",
    "elite_years": """
  SELECT DISTINCT cast(o_custkey AS string) AS user_id, cast(year(o_orderdate) AS string) AS year
  FROM orders WHERE o_orderpriority LIKE '1%'""",
}
