
SELECT o.payment_method, count(*) AS orders, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, CAST(sum(o.final_amount) AS DOUBLE) / count(o.final_amount) AS aov,
       CAST(sum(CASE WHEN o.order_status = 'Cancelled' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS cancel_rate
FROM ops_orders o
WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
GROUP BY o.payment_method
