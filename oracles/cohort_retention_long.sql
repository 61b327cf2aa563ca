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
)
SELECT * FROM cohorts
