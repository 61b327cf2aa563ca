WITH daily AS (
  SELECT o.order_date AS date, sum(o.final_amount) AS revenue, sum(o.discount) AS discount,
         count(*) AS orders, sum(o.gst_amount) AS gst
  FROM ops_orders o
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY o.order_date
)
SELECT date, CAST(revenue AS DOUBLE) AS revenue, CAST(discount AS DOUBLE) AS discount, orders, CAST(gst AS DOUBLE) AS gst
FROM daily
