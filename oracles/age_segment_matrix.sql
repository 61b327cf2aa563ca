WITH cells AS (
  SELECT a.age_group, s.segment, count(c.customer_id) AS customers
  FROM (SELECT DISTINCT age_group FROM ops_customers) a
  CROSS JOIN (SELECT DISTINCT segment FROM ops_customers) s
  LEFT JOIN ops_customers c ON c.age_group = a.age_group AND c.segment = s.segment
  GROUP BY ALL
)
SELECT * FROM (PIVOT cells ON segment IN ({segments}) USING max(customers) GROUP BY age_group)
