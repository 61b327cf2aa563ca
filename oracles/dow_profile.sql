WITH temporal AS (
  SELECT o.order_date, CAST(month(o.order_date) AS INTEGER) AS month, CAST(dayofweek(o.order_date) AS INTEGER) AS dow,
         sum(o.final_amount) AS revenue, count(*) AS orders,
         strftime(o.order_date, '%a') AS dow_name, strftime(o.order_date, '%b') AS month_name
  FROM ops_orders o
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY o.order_date
)
SELECT d.dow_name, CAST(sum(t.revenue) AS DOUBLE) / nullif(count(t.revenue), 0) AS revenue,
       CAST(sum(t.orders) AS DOUBLE) / nullif(count(t.orders), 0) AS orders
FROM (VALUES ('Mon'), ('Tue'), ('Wed'), ('Thu'), ('Fri'), ('Sat'), ('Sun')) d(dow_name)
LEFT JOIN temporal t ON t.dow_name = d.dow_name
GROUP BY d.dow_name
