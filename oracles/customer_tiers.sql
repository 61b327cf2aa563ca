WITH tiers AS (
  SELECT c.tier, c.segment, c.zone, c.age_group, c.status,
         count(DISTINCT c.customer_id) AS customers, coalesce(sum(o.final_amount), 0) AS revenue,
         coalesce(CAST(sum(o.final_amount) AS DOUBLE) / nullif(count(o.final_amount), 0), 0) AS aov,
         count(o.order_id) AS orders
  FROM ops_customers c
  LEFT JOIN ops_orders o ON c.customer_id = o.customer_id AND o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY c.tier, c.segment, c.zone, c.age_group, c.status
)
SELECT * REPLACE (CAST(revenue AS DOUBLE) AS revenue) FROM tiers
