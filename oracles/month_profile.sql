WITH temporal AS (
  SELECT o.order_date, CAST(month(o.order_date) AS INTEGER) AS month, CAST(dayofweek(o.order_date) AS INTEGER) AS dow,
         sum(o.final_amount) AS revenue, count(*) AS orders,
         strftime(o.order_date, '%a') AS dow_name, strftime(o.order_date, '%b') AS month_name
  FROM ops_orders o
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY o.order_date
)
SELECT month_name, CAST(sum(revenue) AS DOUBLE) / count(*) AS revenue,
       CASE WHEN month_name IN ('Oct', 'Nov', 'Jan', 'Aug') THEN 1 ELSE 0 END AS festival
FROM temporal GROUP BY month_name
