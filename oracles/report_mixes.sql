WITH chosen AS (
  SELECT * FROM ops_orders WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
),
stacked AS (
  SELECT 'order_date' AS mix, CAST(order_date AS VARCHAR) AS label, final_amount, NULL AS buyer, NULL AS days
  FROM chosen WHERE order_status NOT IN ('Cancelled','Processing') AND zone = 'ASIA' AND category = 'ECONOMY'
  UNION ALL
  SELECT 'state', state, final_amount, customer_id, delivery_days
  FROM chosen WHERE order_status <> 'Processing' AND category = 'ECONOMY'
  UNION ALL
  SELECT 'category', category, final_amount, NULL, delivery_days
  FROM chosen WHERE order_status NOT IN ('Cancelled','Processing') AND zone = 'ASIA'
  UNION ALL
  SELECT 'payment_method', payment_method, final_amount, NULL, NULL FROM chosen
)
SELECT mix, label, count(*) AS orders, CAST(sum(final_amount) AS DOUBLE) AS revenue,
       CASE WHEN mix = 'state' THEN count(DISTINCT buyer) END AS customers,
       CAST(sum(days) AS DOUBLE) / count(days) AS avg_delivery
FROM stacked
GROUP BY mix, label
