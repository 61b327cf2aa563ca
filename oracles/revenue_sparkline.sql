WITH weekly AS (
  SELECT strftime(o.order_date, '%Y-W%W') AS week, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders,
         CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate, CAST(sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS cancel_rate,
         max(o.order_date) AS last_day
  FROM ops_orders o GROUP BY 1
),
last8 AS (SELECT * EXCLUDE (last_day) FROM weekly ORDER BY week DESC LIMIT 8),
last6 AS (SELECT week, revenue FROM last8 ORDER BY week DESC LIMIT 6)
SELECT week, revenue,
       CAST(greatest(2, CASE WHEN (SELECT max(revenue) FROM last6) > 0
            THEN trunc(revenue / (SELECT max(revenue) FROM last6) * 24) ELSE 4 END) AS INTEGER) AS height
FROM last6 WHERE (SELECT count(*) FROM last6) > 1
