
SELECT CAST(year(o.order_date) AS INTEGER) AS year, CAST(month(o.order_date) AS INTEGER) AS month_num,
       strftime(min(o.order_date), '%b') AS month, CAST(sum(o.final_amount) AS DOUBLE) AS revenue,
       count(*) AS orders, CAST(sum(o.final_amount) AS DOUBLE) / count(o.final_amount) AS aov
FROM ops_orders o
WHERE o.order_status NOT IN ('Cancelled','Processing')
GROUP BY 1, 2
