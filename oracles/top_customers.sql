WITH bought AS (
  SELECT o.customer_id, count(DISTINCT o.order_id) AS orders, sum(o.final_amount) AS lifetime_value, CAST(sum(o.final_amount) AS DOUBLE) / count(o.final_amount) AS aov
  FROM ops_orders o WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing') GROUP BY o.customer_id
),
rated AS (
  SELECT customer_id, CAST(sum(csat_tenths) AS DOUBLE) / 10 / count(*) AS csat FROM ops_tickets
  WHERE created_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY customer_id
),
merged AS (
  SELECT c.*, b.orders, b.lifetime_value, b.aov, coalesce(r.csat, 0) AS csat_avg
  FROM ops_customers c JOIN bought b ON b.customer_id = c.customer_id LEFT JOIN rated r ON r.customer_id = c.customer_id
)
SELECT full_name, city, state, tier, segment, age_group, orders, CAST(lifetime_value AS DOUBLE) AS lifetime_value, aov, csat_avg
FROM merged ORDER BY merged.lifetime_value DESC, customer_id LIMIT 20
