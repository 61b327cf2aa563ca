WITH weekly AS (
  SELECT strftime(o.order_date, '%Y-W%W') AS week, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders,
         CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate, CAST(sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS cancel_rate,
         max(o.order_date) AS last_day
  FROM ops_orders o GROUP BY 1
),
complete AS (
  SELECT * FROM weekly
  WHERE date_trunc('week', last_day) + INTERVAL 6 DAY <= (SELECT max(order_date) FROM ops_orders)
)
SELECT * EXCLUDE (last_day) FROM complete ORDER BY week DESC LIMIT 8
