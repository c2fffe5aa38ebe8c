"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express.

Hashes of shingles, kernels, randomness tests, images and tokenizers are beyond DuckDB: those queries are held against
brute force in tests.
"""

from __future__ import annotations

import importlib

#: Query name, module, function.
_NAMED = [
    ("op1_language_id", "langid", "op1"),
    ("op2_secret_scan", "secret_scan", "op2"),
    ("op3_embedding_dedup", "embedding_dedup", "op3"),
    ("op4_media_copies", "media", "op4"),
    ("op5_simhash_dedup", "simhash", "op5"),
    ("op6_packing", "packing", "op6"),
    ("op7_token_files", "token_files", "op7"),
    ("op8_line_dedup", "line_dedup", "op8"),
    ("op9_substring_dedup", "substring_dedup", "op9"),
    ("op10_byte_bpe", "byte_bpe", "op10"),
]

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_EMBEDDINGS = """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(owner < doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

_SUBSTRINGS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM d),
hashed AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win FROM windows),
firsts AS (SELECT win, min(doc_id) AS owner FROM hashed GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM hashed JOIN firsts USING (win) WHERE owner < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT words.doc_id, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (gone.k IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"helixframe.llm.{module}"), function) for name, module, function in _NAMED}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": _EMBEDDINGS, "op8_line_dedup": _LINES, "op9_substring_dedup": _SUBSTRINGS}
