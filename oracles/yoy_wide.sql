WITH monthly AS (
  SELECT year(order_date) AS y, month(order_date) AS month_num, CAST(sum(final_amount) AS DOUBLE) AS revenue
  FROM ops_orders WHERE order_status NOT IN ('Cancelled','Processing') GROUP BY ALL
),
years AS (
  SELECT CAST(unnest(generate_series(min(year(order_date)), max(year(order_date)))) AS VARCHAR) AS label FROM ops_orders
),
cells AS (
  SELECT CAST(m.month_num AS INTEGER) AS month_num, strftime(make_date(2000, m.month_num, 1), '%b') AS month,
         years.label, max(monthly.revenue) AS revenue
  FROM (SELECT DISTINCT month_num FROM monthly) m CROSS JOIN years
  LEFT JOIN monthly ON monthly.month_num = m.month_num AND CAST(monthly.y AS VARCHAR) = years.label
  GROUP BY ALL
)
SELECT * FROM (PIVOT cells ON label IN ({years}) USING max(revenue) GROUP BY month_num, month)
