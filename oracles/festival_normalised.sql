WITH monthly AS (
  SELECT CAST(date_trunc('month', o.order_date) AS DATE) AS month, CAST(sum(o.final_amount) AS DOUBLE) AS revenue
  FROM ops_orders o WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing') GROUP BY 1
),
weighted AS (
  SELECT *, CAST(CASE month(month) WHEN 10 THEN 2.8 WHEN 11 THEN 2.2 WHEN 1 THEN 1.8 WHEN 8 THEN 1.5 WHEN 3 THEN 1.3 WHEN 7 THEN 1.2
                 ELSE 1.0 END AS DOUBLE) AS weight FROM monthly
)
SELECT month, revenue, weight, revenue / weight AS normalised_revenue FROM weighted
