WITH priced AS (
  SELECT o.state, o.customer_id, o.order_id, o.order_date, o.category, o.amount, o.discount, o.order_status,
         o.delivery_days, c.segment, o.zone, o.delivery_date, o.is_returned,
         CASE o.category WHEN 'ECONOMY' THEN o.amount BETWEEN 900 AND 20000 WHEN 'LARGE' THEN o.amount BETWEEN 1500 AND 90000
              WHEN 'MEDIUM' THEN o.amount BETWEEN 1200 AND 60000 WHEN 'PROMO' THEN o.amount BETWEEN 2000 AND 105000
              WHEN 'SMALL' THEN o.amount BETWEEN 950 AND 10000 WHEN 'STANDARD' THEN o.amount BETWEEN 1000 AND 50000 END AS in_range,
         CAST(round(o.amount * CASE c.segment WHEN 'AUTOMOBILE' THEN CAST(1.5 AS DECIMAL(3,1)) WHEN 'BUILDING' THEN CAST(1.3 AS DECIMAL(3,1))
              WHEN 'FURNITURE' THEN CAST(1.1 AS DECIMAL(3,1)) ELSE CAST(1.0 AS DECIMAL(3,1)) END, 2) AS DECIMAL(12,2)) AS price
  FROM ops_orders o JOIN ops_customers c ON c.customer_id = o.customer_id
),
taxed AS (
  SELECT *, CAST(round(price * CASE category WHEN 'ECONOMY' THEN CAST(0.05 AS DECIMAL(4,2)) WHEN 'LARGE' THEN CAST(0.12 AS DECIMAL(4,2))
              WHEN 'MEDIUM' THEN CAST(0.12 AS DECIMAL(4,2)) WHEN 'PROMO' THEN CAST(0.18 AS DECIMAL(4,2))
              WHEN 'STANDARD' THEN CAST(0.18 AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END, 2) AS DECIMAL(12,2)) AS gst
  FROM priced
)
SELECT state, customer_id, order_id, order_date, category, CAST(amount AS DOUBLE) AS amount, CAST(discount AS DOUBLE) AS discount,
       order_status, delivery_days, segment, zone, CAST(in_range AS INTEGER) AS in_price_range, CAST(price AS DOUBLE) AS price,
       CAST(gst AS DOUBLE) AS gst, CAST(price + gst - discount AS DOUBLE) AS final, delivery_date, is_returned,
       CAST(CASE month(order_date) WHEN 10 THEN 2.8 WHEN 11 THEN 2.2 WHEN 1 THEN 1.8 WHEN 8 THEN 1.5 WHEN 3 THEN 1.3 WHEN 7 THEN 1.2
            ELSE 1.0 END AS DOUBLE) AS festival_weight,
       printf('ORD%06d', order_id) AS order_code
FROM taxed
