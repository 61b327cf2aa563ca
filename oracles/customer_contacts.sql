
SELECT c_custkey AS customer_id, printf('CUST%05d', c_custkey) AS customer_code,
       replace(lower(c_name), ' ', '.') || '@example.com' AS email
FROM customer
