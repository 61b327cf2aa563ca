WITH best AS (
SELECT o.product_name, o.category, count(*) AS orders, CAST(sum(o.final_amount) AS DOUBLE) AS revenue,
       CAST(sum(o.final_amount) AS DOUBLE) / count(o.final_amount) AS aov, CAST(sum(o.discount) AS DOUBLE) / count(o.discount) AS avg_discount, CAST(sum(CASE WHEN o.order_status = 'Returned' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*) AS return_rate
FROM ops_orders o
WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status <> 'Processing'
GROUP BY o.product_name, o.category
ORDER BY revenue DESC, o.product_name, o.category LIMIT 30
)
SELECT * FROM best WHERE return_rate > 0
ORDER BY return_rate DESC, product_name, category LIMIT 15
