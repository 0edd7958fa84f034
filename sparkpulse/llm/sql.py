"""DuckDB SQL for the queries that SQL can express over whole tables."""

#: The full payload's size and SHA-1 of each page, and which response it revisits.
OP2 = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to,
       coalesce(url, 'urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')) AS uri, true AS has_request
FROM g
"""

ORACLES = {"op2_warc": OP2}
