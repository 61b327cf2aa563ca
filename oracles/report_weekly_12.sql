WITH daily AS (
  SELECT o.order_date AS date, sum(o.final_amount) AS revenue, sum(o.discount) AS discount,
         count(*) AS orders, sum(o.gst_amount) AS gst
  FROM ops_orders o
  WHERE o.order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND o.order_status NOT IN ('Cancelled','Processing')
  GROUP BY o.order_date
),
buckets AS (
  SELECT CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS bucket, sum(revenue) AS revenue, sum(discount) AS discount, sum(orders) AS orders, sum(gst) AS gst
  FROM daily GROUP BY 1
),
calendar AS (
  SELECT CAST(s + INTERVAL 6 DAY AS DATE) AS bucket
  FROM (SELECT unnest(generate_series((SELECT min(date_trunc('week', date)) FROM daily),
                                      (SELECT max(date_trunc('week', date)) FROM daily), INTERVAL 1 week)) AS s)
)
SELECT c.bucket AS date, coalesce(CAST(b.revenue AS DOUBLE), 0) AS revenue, CAST(coalesce(b.orders, 0) AS BIGINT) AS orders
FROM calendar c LEFT JOIN buckets b ON b.bucket = c.bucket
ORDER BY c.bucket DESC LIMIT 12
