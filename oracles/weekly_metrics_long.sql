WITH weekly AS (
  SELECT strftime(o.order_date, '%Y-W%W') AS week, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders,
         CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate, CAST(sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS cancel_rate,
         max(o.order_date) AS last_day
  FROM ops_orders o GROUP BY 1
),
last8 AS (SELECT * EXCLUDE (last_day) FROM weekly ORDER BY week DESC LIMIT 8)
SELECT week, 'revenue' AS metric, CAST(revenue AS DOUBLE) AS value FROM last8
UNION ALL
SELECT week, 'orders' AS metric, CAST(orders AS DOUBLE) AS value FROM last8
UNION ALL
SELECT week, 'return_rate' AS metric, CAST(return_rate AS DOUBLE) AS value FROM last8
UNION ALL
SELECT week, 'cancel_rate' AS metric, CAST(cancel_rate AS DOUBLE) AS value FROM last8
