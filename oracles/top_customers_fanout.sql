-- Each settled order line once per ticket of its buyer, and once for a buyer without tickets.
WITH repeats AS (
  SELECT customer_id, count(*) AS times, CAST(sum(csat_tenths) AS DOUBLE) / 10 / count(*) AS mean_rating
  FROM ops_tickets WHERE created_date >= DATE '2000-01-01' AND created_date < DATE '2001-01-01' GROUP BY ALL
),
lines AS (
  SELECT customer_id AS buyer, order_id, final_amount AS paid, coalesce(times, 1) AS times, coalesce(mean_rating, 0) AS rating
  FROM ops_orders LEFT JOIN repeats USING (customer_id)
  WHERE year(order_date) = 2000 AND order_status IN ('Delivered', 'Shipped', 'Returned')
),
copies AS (SELECT buyer, order_id, paid, rating, unnest(range(times)) FROM lines),
best AS (
  SELECT buyer, count(DISTINCT order_id) AS n, sum(paid) AS total, any_value(rating) AS rating
  FROM copies GROUP BY buyer ORDER BY total DESC, buyer LIMIT 20
),
once AS (SELECT buyer, CAST(sum(paid) AS DOUBLE) / count(paid) AS mean_paid FROM lines GROUP BY buyer)
SELECT p.full_name, p.city, p.state, p.tier, p.segment, p.age_group, best.n AS orders,
       CAST(best.total AS DOUBLE) AS lifetime_value, once.mean_paid AS aov, best.rating AS csat_avg
FROM best JOIN once USING (buyer) JOIN ops_customers p ON p.customer_id = best.buyer
