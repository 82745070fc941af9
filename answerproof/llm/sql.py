"""SQL of the registered queries of this folder, where SQL can express them."""

OP12_LEXICAL_SEARCH = r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
),
lengths AS (SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS (
    SELECT item_id, text, term, count(*) AS repeats
    FROM (
        SELECT item_id, text, unnest(
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    )
    GROUP BY ALL
),
held AS (
    SELECT doc, doc_id, n, term, count(*) AS tf
    FROM (SELECT doc, doc_id, n, unnest(w) AS term FROM lengths)
    WHERE term IN (SELECT term FROM asked)
    GROUP BY ALL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM held, corpus GROUP BY term, docs
),
scores AS (
    SELECT item_id, asked.text, doc, doc_id,
           CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
    FROM held JOIN asked USING (term) JOIN weights USING (term), corpus
    GROUP BY ALL
),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (
        PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST, doc) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op12_lexical_search": OP12_LEXICAL_SEARCH}
