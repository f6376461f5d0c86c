"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op5_multiprobe_ann
from .infill import op12_fill_in_middle
from .jaccard_join import op6_ngram_jaccard_join
from .mixing import op2_source_mixing
from .order_minhash import op4_order_minhash
from .packing import op3_packing
from .pieces import op13_sentencepiece
from .quality import op7_quality_cotraining
from .secret_scan import op1_secret_scan
from .token_files import op8_bit_plane_output
from .toxicity import op9_toxicity_chain
from .url_filter import op10_url_filter
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, op11_vector_codes

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_packing": op3_packing,
    "op4_order_minhash": op4_order_minhash,
    "op5_multiprobe_ann": op5_multiprobe_ann,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_bit_plane_output": op8_bit_plane_output,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_sentencepiece": op13_sentencepiece,
}

#: Shingle sets, exact Jaccard of all pairs that share one, and reachability. The other
#: operators train models, draw pseudo-random orders or use tokenizers, which SQL can't;
#: their tests compare with brute force.
_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id
"""

_INFILL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
parts AS (
  SELECT *, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 : n], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def _vector_codes() -> str:
    """Each round is a pair of tables: nearest entries, then the entries' new means (floored)."""
    nearest = "SELECT vec_id, p, min(d * 256 + k) % 256 AS k, min(d * 256 + k) // 256 AS d FROM (SELECT vec_id, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM items JOIN b{n} USING (p, j) GROUP BY vec_id, p, k) GROUP BY vec_id, p"
    mean = "SELECT p, k, j, CASE WHEN m IS NULL THEN c ELSE (s - ((s % m) + m) % m) // m END AS c FROM b{n} LEFT JOIN (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM items JOIN a{n} USING (vec_id, p) GROUP BY p, k, j) USING (p, k, j)"
    rounds = ", ".join(f"a{n} AS MATERIALIZED ({nearest.format(n=n)}), b{n + 1} AS MATERIALIZED ({mean.format(n=n)})" for n in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
items AS MATERIALIZED (
  SELECT vec_id, i // (n // {PARTS}) AS p, i % (n // {PARTS}) AS j, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT p, k, j, x AS c FROM items JOIN first USING (vec_id)),
{rounds},
last AS MATERIALIZED ({nearest.format(n=ROUNDS)}),
codes AS (SELECT vec_id, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id) CROSS JOIN books
"""


ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard_join": _JACCARD, "op11_vector_codes": _vector_codes(), "op12_fill_in_middle": _INFILL}
