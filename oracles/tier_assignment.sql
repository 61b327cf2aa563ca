
SELECT customer_id, CAST(spent AS DOUBLE) AS spent,
       CASE WHEN spent >= 500000 THEN 'Platinum' WHEN spent >= 200000 THEN 'Gold' WHEN spent >= 80000 THEN 'Silver' ELSE 'Bronze' END AS tier
FROM ops_spend
