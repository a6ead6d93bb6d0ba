-- name: sql_row_counts
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM lineitem) AS lines

-- name: sql_null_counts
SELECT sum(CASE WHEN nullif(o_custkey % 10, 0) IS NULL THEN 1 ELSE 0 END) AS null_a, sum(CASE WHEN nullif(o_orderkey % 4, 0) IS NULL THEN 1 ELSE 0 END) AS null_b FROM orders

-- name: sql_complete_rows
SELECT o_orderstatus, count(*) AS n FROM orders WHERE nullif(o_custkey % 10, 0) IS NOT NULL AND nullif(o_orderkey % 4, 0) IS NOT NULL GROUP BY o_orderstatus

-- name: sql_hour_zero
SELECT count(*) AS n, sum(CASE WHEN extract(HOUR FROM ts) = 0 THEN 1 ELSE 0 END) AS true_zero, sum(CASE WHEN extract(HOUR FROM ts) = 0 OR event_id % 3 = 0 THEN 1 ELSE 0 END) AS naive_zero FROM events

-- name: sql_mean_by_group
SELECT event_type, count(value) AS known, round(avg(value), 6) AS mean FROM events GROUP BY event_type

-- name: sql_per_day_by_month
WITH m AS (SELECT extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(y AS INT) AS y, CAST(m AS INT) AS m, n, round(n / CASE WHEN m IN (4, 6, 9, 11) THEN 30.0 WHEN m <> 2 THEN 31.0 WHEN y % 4 = 0 THEN 29.0 ELSE 28.0 END, 4) AS per_day FROM m

-- name: sql_top_by_mean
SELECT user_id, known, mean, CAST(rank() OVER (ORDER BY mean DESC) AS INT) AS place FROM (SELECT user_id, count(value) AS known, round(avg(value), 6) AS mean FROM events GROUP BY user_id HAVING count(value) >= 5) AS u ORDER BY mean DESC, user_id LIMIT 5

-- name: sql_several_types
SELECT count(*) AS users FROM (SELECT user_id FROM (SELECT DISTINCT user_id, event_type FROM events) AS d GROUP BY user_id HAVING count(*) > 1) AS u
