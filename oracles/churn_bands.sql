WITH history AS (
  SELECT c.customer_id, c.full_name, c.city, c.state, c.tier, c.segment, c.status,
         coalesce(sum(o.final_amount), 0) AS lifetime_value,
         count(o.order_id) AS total_orders,
         CAST(coalesce(date_diff('day', max(o.order_date), DATE '2000-12-31'), 999) AS INTEGER) AS days_since_order,
         coalesce(CAST(sum(o.final_amount) AS DOUBLE) / nullif(count(o.final_amount), 0), 0) AS avg_order_value
  FROM ops_customers c
  LEFT JOIN ops_orders o ON c.customer_id = o.customer_id AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY ALL
),
churn AS (
  SELECT *,
         least(greatest(
           CAST(least(greatest(days_since_order, 0), 180) AS DOUBLE) / 180 * CAST(0.45 AS DOUBLE)
           + CASE WHEN status = 'Churned' THEN CAST(0.40 AS DOUBLE) ELSE 0 END
           + CASE WHEN status = 'At-Risk' THEN CAST(0.25 AS DOUBLE) ELSE 0 END
           + (1 - CAST(least(greatest(total_orders, 0), 10) AS DOUBLE) / 10) * CAST(0.10 AS DOUBLE),
         0), 1) AS churn_score
  FROM history
),
bands AS (
  SELECT *, CASE WHEN churn_score > CAST(0.7 AS DOUBLE) THEN 'high' WHEN churn_score > CAST(0.4 AS DOUBLE) THEN 'medium' ELSE 'low' END AS band
  FROM churn
)
SELECT d.band, count(b.customer_id) AS customers,
       coalesce(CAST(sum(b.lifetime_value) AS DOUBLE) / nullif(count(b.customer_id), 0), 0) AS avg_lifetime_value,
       coalesce(CAST(sum(b.days_since_order) AS DOUBLE) / nullif(count(b.customer_id), 0), 0) AS avg_days_since_order
FROM (VALUES ('high'), ('medium'), ('low')) d(band) LEFT JOIN bands b ON b.band = d.band
GROUP BY d.band
