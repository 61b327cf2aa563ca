
SELECT * REPLACE (CAST(refund_amount AS DOUBLE) AS refund_amount) FROM ops_returns
