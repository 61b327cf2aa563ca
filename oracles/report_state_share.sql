WITH states AS (
SELECT o.state, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders, CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery,
       count(DISTINCT o.customer_id) AS customers, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate
FROM ops_orders o
WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing'
GROUP BY o.state
)
SELECT state, revenue, revenue / (SELECT max(revenue) FROM states) * 100 AS bar_share
FROM states ORDER BY revenue DESC, state LIMIT 8
