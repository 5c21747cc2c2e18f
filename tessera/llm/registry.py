"""The operators' queries and their SQL."""

from . import bpe, curves, flac, language, lexical, licenses, line_dedup, mixing, ngram_join, parts, prefix_trie, quality, secrets, toxicity

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_line_dedup": line_dedup.query,
    "op3_byte_bpe": bpe.query,
    "op4_toxicity": toxicity.query,
    "op5_flac_media": flac.query,
    "op6_hilbert_neighbours": curves.query,
    "op7_secret_scan": secrets.query,
    "op8_license_scan": licenses.query,
    "op9_source_mixing": mixing.query,
    "op10_language_id": language.query,
    "op11_lexical_search": lexical.query,
    "op12_quality": quality.query,
    "op13_prefix_trie": prefix_trie.query,
    **parts.QUERIES,
}

#: Where SQL can express the whole result in reasonable time; parts.py has columns of the others. The join is exact there: shingles as texts, classes by recursion.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM docs WHERE len(w) > 0),
same AS (SELECT min(doc_id) AS rep, count(*) AS copies, s FROM sets GROUP BY s),
member AS (SELECT d.doc_id, c.rep, c.copies FROM sets d JOIN same c ON d.s = c.s),
shingle AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM same),
pair AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, min(a.n) AS na, min(b.n) AS nb FROM shingle a JOIN shingle b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM pair WHERE k * 10 >= (na + nb - k) * 8),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (SELECT rep, rep FROM same UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node),
class AS (SELECT node, min(root) AS class_id FROM reach GROUP BY 1),
far AS (SELECT e.a, sum(c.copies) AS n FROM edge e JOIN same c ON c.rep = e.b GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(m.copies - 1 + coalesce(f.n, 0), 0)::BIGINT AS n_links, coalesce(m.copies, 1)::BIGINT AS copies
FROM docs d LEFT JOIN member m ON m.doc_id = d.doc_id LEFT JOIN class c ON c.node = m.rep LEFT JOIN far f ON f.a = m.rep""",
    "op11_lexical_search": lexical.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    **parts.ORACLE_SQL,
}
