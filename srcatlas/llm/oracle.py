"""The queries that SQL can express, over the given tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAREST = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), n AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) / (q.norm * c.norm) AS score
    FROM n q JOIN n c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0 AND q.norm > 0 AND c.norm > 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

DECONTAMINATION = f"""
WITH items AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
), docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), parts AS (
    SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win
    FROM (SELECT rid, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i FROM docs, (SELECT DISTINCT size FROM windows))
), found AS (
    SELECT DISTINCT p.rid, p.i, p.size, x.item_id FROM parts p JOIN windows x ON p.win = x.win AND p.size = x.size
), hits AS (
    SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM found) GROUP BY rid
), named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

SUBSTRINGS = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
    SELECT rid, doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS win
    FROM (SELECT rid, doc_id, w, unnest(range(greatest(0, len(w) - 19))) AS i FROM docs)
), later AS (
    SELECT rid, i FROM windows QUALIFY rank() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, i) > 1
), gone AS (
    SELECT DISTINCT rid, unnest(range(i, i + 20)) AS pos FROM later
), words AS (
    SELECT rid, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM docs
), left_over AS (
    SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (rid)
"""

LEXICAL_SEARCH = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), lengths AS (
    SELECT rid, doc_id, t, len(t) AS n FROM docs WHERE len(t) > 0
), totals AS (
    SELECT count(*) AS d, sum(n)::BIGINT AS l FROM lengths
), counts AS (
    SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM lengths) GROUP BY rid, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(d) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
    SELECT item_id, rid, any_value(doc_id) AS doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * d) // l)))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (rid), totals GROUP BY item_id, rid
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

EXACT_DEDUP = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
    row_number() OVER best = 1 AS kept, sha256(plain) AS text_sha256
FROM docs WINDOW best AS (PARTITION BY plain ORDER BY length(text) DESC, doc_id NULLS LAST, rid)
"""

SQL = {
    "op2_nearest": NEAREST,
    "op3_decontamination": DECONTAMINATION,
    "op4_substring_dedup": SUBSTRINGS,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_exact_dedup": EXACT_DEDUP,
}
