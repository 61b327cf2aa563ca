
SELECT o.category, CAST(sum(o.final_amount) AS DOUBLE) AS revenue, count(*) AS orders, CAST(sum(o.final_amount) AS DOUBLE) / count(o.final_amount) AS aov,
       CAST(sum(o.discount) AS DOUBLE) AS discount, CAST(sum(o.delivery_days) AS DOUBLE) / count(o.delivery_days) AS avg_delivery
FROM ops_orders o
WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
GROUP BY o.category
