WITH activity AS (
  SELECT c.customer_id, date_trunc('month', c.join_date) AS cohort_month, date_trunc('month', o.order_date) AS order_month
  FROM ops_customers c JOIN ops_orders o ON c.customer_id = o.customer_id
  WHERE o.order_status NOT IN ('Cancelled','Processing')
),
periods AS (
  SELECT *, CAST((year(order_month) - year(cohort_month)) * 12 + month(order_month) - month(cohort_month) AS INTEGER) AS period
  FROM activity
),
sizes AS (
  SELECT cohort_month, count(DISTINCT customer_id) AS cohort_size FROM periods GROUP BY cohort_month
),
retained AS (
  SELECT cohort_month, period, count(DISTINCT customer_id) AS customers FROM periods GROUP BY cohort_month, period
),
cohorts AS (
  SELECT CAST(r.cohort_month AS DATE) AS cohort_month, r.period, r.customers, s.cohort_size,
         CAST(r.customers AS DOUBLE) / s.cohort_size * 100 AS retention
  FROM retained r JOIN sizes s ON s.cohort_month = r.cohort_month
),
-- A column for each period that a join month and an order month can give.
span AS (
  SELECT (SELECT CAST(min(year(order_date) * 12 + month(order_date)) AS INTEGER) FROM ops_orders WHERE order_status NOT IN ('Cancelled','Processing'))
         - (SELECT CAST(max(year(join_date) * 12 + month(join_date)) AS INTEGER) FROM ops_customers) AS lowest,
         (SELECT CAST(max(year(order_date) * 12 + month(order_date)) AS INTEGER) FROM ops_orders WHERE order_status NOT IN ('Cancelled','Processing'))
         - (SELECT CAST(min(year(join_date) * 12 + month(join_date)) AS INTEGER) FROM ops_customers) AS highest
),
grid AS (
  SELECT s.cohort_month, CAST(g.period AS INTEGER) AS period
  FROM (SELECT DISTINCT cohort_month FROM cohorts) s, (SELECT unnest(generate_series(lowest, highest)) AS period FROM span) g
),
scaled AS (
  SELECT g.cohort_month, g.period, coalesce(c.retention, 0) * 10 AS y
  FROM grid g LEFT JOIN cohorts c ON c.cohort_month = g.cohort_month AND c.period = g.period
),
cells AS (
  SELECT strftime(cohort_month, '%b %Y') AS cohort, 'M+' || CAST(period AS VARCHAR) AS label,
         -- half-even rounding to one decimal
         CASE WHEN y - floor(y) > 0.5 THEN floor(y) + 1 WHEN y - floor(y) < 0.5 THEN floor(y)
              WHEN CAST(floor(y) AS BIGINT) % 2 = 0 THEN floor(y) ELSE floor(y) + 1 END / CAST(10 AS DOUBLE) AS shown
  FROM scaled
)
SELECT * FROM (PIVOT cells ON label IN ({periods}) USING max(shown) GROUP BY cohort)
