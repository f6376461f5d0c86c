"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

import uuid

from ..functions.text import BACK_MATTER, CHUNK_NAMESPACE


def _tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _hex(s: str) -> str:
    return f"('0x' || {s})::BIGINT"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _embed(source: str, key: str) -> str:
    """Hashed embedding of ``source(key, terms)``."""
    return f"""
    SELECT {key}, list(coalesce(w, 0) / n ORDER BY i) AS dense FROM (
      SELECT k.{key}, k.n, r.i FROM (SELECT {key}, sqrt(sum(w * w)::DOUBLE) AS n FROM {source}_sums GROUP BY {key}) k, (SELECT unnest(range(64)) AS i) r WHERE k.n > 0
    ) g LEFT JOIN {source}_sums s USING ({key}, i) GROUP BY {key}"""


def _sums(source: str, key: str) -> str:
    return f"""
    SELECT {key}, {_hex("substr(md5(term), 1, 8)")} % 64 AS i, sum(CASE WHEN {_hex("substr(md5(term), 9, 2)")} % 2 = 0 THEN 1 ELSE -1 END) AS w
    FROM (SELECT {key}, unnest(terms) AS term FROM {source}) GROUP BY ALL"""


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {id}) AS rank"

# Shared steps; a statement only pays for those it names.
_STEPS = {
    "titled": "SELECT doc_id::VARCHAR AS doc_id, source || '/' || lang AS title, text, source, lang FROM documents",
    "hashed": "SELECT doc_id, sha256(title || chr(10) || text) AS content_hash FROM titled",
    "stored": rf"SELECT doc_id, sha256(title || chr(10) || {_strip(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS content_hash FROM titled UNION ALL SELECT 'item:' || item_id, sha256('item' || chr(10) || text) FROM benchmark",
    "changed": "SELECT h.* FROM hashed h ANTI JOIN stored s ON h.doc_id = s.doc_id AND h.content_hash = s.content_hash",
    "doc_terms": f"SELECT doc_id, {_tokens('text')} AS terms FROM documents",
    "item_terms": f"SELECT item_id AS query_id, {_tokens('text')} AS terms FROM benchmark",
    "post": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY ALL",
    "doc_terms_sums": _sums("doc_terms", "doc_id"),
    "item_terms_sums": _sums("item_terms", "query_id"),
    "doc_vec": _embed("doc_terms", "doc_id"),
    "item_vec": _embed("item_terms", "query_id"),
    "lens": "SELECT doc_id, len(terms) AS dl FROM doc_terms",
    "whole": "SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens",
    "freq": "SELECT term, count(*) AS df FROM post GROUP BY term",
    "bm": f"""SELECT *, {_TOP.format(id="doc_id")} FROM (
      SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM (SELECT query_id, unnest(list_distinct(terms)) AS term FROM item_terms) q JOIN post p USING (term) JOIN freq USING (term) JOIN lens USING (doc_id), whole GROUP BY ALL)""",
    "vecs": "SELECT vec_id, embedding::DOUBLE[] AS dense, label AS cluster_id FROM embeddings",
    "units": "SELECT vec_id, cluster_id, list_transform(dense, lambda x: x / sqrt(list_dot_product(dense, dense))) AS u FROM vecs",
    "label_first": "SELECT cluster_id, arg_min(u, vec_id) AS c FROM units GROUP BY 1",
    "near_first": """SELECT vec_id, u, cluster_id FROM (SELECT v.vec_id, v.u, f.cluster_id, row_number() OVER (
      PARTITION BY vec_id ORDER BY round(list_dot_product(u, u) + list_dot_product(c, c) - 2 * list_dot_product(u, c), 12), f.cluster_id) AS r FROM units v, label_first f) WHERE r = 1""",
    "topic_sums": "SELECT cluster_id, i, sum(u[i]) AS s, count(*) AS n FROM units, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL",
    "topic": "SELECT cluster_id, list(s / l ORDER BY i) AS centroid FROM topic_sums JOIN (SELECT cluster_id, sqrt(sum(s * s)) AS l FROM topic_sums GROUP BY 1) USING (cluster_id) GROUP BY 1",
    "near_vec": f"SELECT *, {_TOP.format(id='vec_id')} FROM (SELECT query_id, vec_id, list_cosine_similarity(q.dense, v.dense) AS score FROM item_vec q, vecs v)",
    "routes": f"SELECT *, {_TOP.format(id='cluster_id')} FROM (SELECT query_id, cluster_id, list_cosine_similarity(dense, centroid) AS score FROM item_vec, topic)",
    "doc_cluster": "SELECT doc_id, cluster_id FROM (SELECT doc_id, cluster_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(dense, centroid), 12) DESC, cluster_id) AS r FROM doc_vec, topic) WHERE r = 1",
    "dn": f"SELECT *, {_TOP.format(id='doc_id')} FROM (SELECT query_id, doc_id, list_cosine_similarity(q.dense, d.dense) AS score FROM item_vec q, doc_vec d)",
    "dn_routed": f"SELECT *, {_TOP.format(id='doc_id')} FROM (SELECT d.query_id, d.doc_id, d.score FROM dn d JOIN doc_cluster c USING (doc_id) JOIN routes r ON r.query_id = d.query_id AND r.cluster_id = c.cluster_id AND r.rank <= 1)",
    "fused": f"""SELECT *, {_TOP.format(id="doc_id")} FROM (SELECT query_id, doc_id, sum(1 / (60.0::DOUBLE + rank)) AS score
      FROM (SELECT query_id, doc_id, rank FROM dn WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank FROM bm WHERE rank <= 100) GROUP BY ALL)""",
    "fused_routed": f"""SELECT *, {_TOP.format(id="doc_id")} FROM (SELECT query_id, doc_id, sum(1 / (60.0::DOUBLE + rank)) AS score
      FROM (SELECT query_id, doc_id, rank FROM dn_routed WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, rank FROM bm WHERE rank <= 100) GROUP BY ALL)""",
    "rel": "SELECT item_id AS query_id, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "results": "SELECT 'dense' AS config, query_id, rank, doc_id FROM dn WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, rank, doc_id FROM bm WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, rank, doc_id FROM fused WHERE rank <= 10",
    "scores": "SELECT * FROM ({scores_of_results})",
    "sectioned": "SELECT conv_id, string_agg('== ' || role || ' ==' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "lines": rf"SELECT doc_id, i - 1 AS line, l AS raw, {_strip('l')} AS body, list_sum(list_transform(ls[1 : i - 1], lambda x: len(x) + 1)) AS begins FROM (SELECT doc_id, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
}


def _scored(results: str) -> str:
    return f"""
    SELECT config, query_id, min(CASE WHEN gain = 1 THEN rank END) AS first_relevant_rank,
      sum(CASE WHEN rank <= 5 THEN gain END) / max(n_rel) AS recall_at_5, sum(gain) / max(n_rel) AS recall_at_k,
      CASE WHEN max(n_rel) IS NULL THEN 0.0 ELSE sum(gain / log2(rank + 1)) / list_sum(list_transform(range(1, least(max(n_rel), 10) + 1), lambda r: 1 / log2(r + 1))) END AS ndcg_at_k,
      coalesce(1.0::DOUBLE / min(CASE WHEN gain = 1 THEN rank END), 0) AS mrr_at_k, count(DISTINCT doc_id) AS distinct_docs
    FROM (SELECT r.*, n_rel, (e.doc_id IS NOT NULL)::INT::DOUBLE AS gain FROM {results} r LEFT JOIN rel e ON e.query_id = r.query_id AND e.doc_id = r.doc_id
          LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1) c ON c.query_id = r.query_id) GROUP BY ALL"""


_STEPS["scores"] = _scored("results")
_STEPS["routed_results"] = "SELECT 'hybrid' AS config, query_id, rank, doc_id FROM fused WHERE rank <= 10 UNION ALL SELECT 'routed', query_id, rank, doc_id FROM fused_routed WHERE rank <= 10"
_STEPS["routed_scores"] = _scored("routed_results")
_STEPS["dn_routed3"] = _STEPS["dn_routed"].replace("r.rank <= 1", "r.rank <= 3")
_STEPS["fused_routed3"] = _STEPS["fused_routed"].replace("dn_routed", "dn_routed3")
_STEPS["diagnosis"] = """SELECT query_id, routed, relevant_clusters FROM (SELECT query_id, list(cluster_id ORDER BY rank) AS routed FROM routes WHERE rank <= 3 GROUP BY 1)
    JOIN (SELECT query_id, list_sort(list(DISTINCT cluster_id)) AS relevant_clusters FROM rel JOIN doc_cluster USING (doc_id) GROUP BY 1) USING (query_id)"""


def _with(body: str) -> str:
    """The statement with the steps it needs, in order."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name, step in _STEPS.items():
            if name not in need and f" {name} " in f" {sql.replace(chr(10), ' ').replace(',', ' , ').replace('(', ' ( ').replace(')', ' ) ')} ":
                visit(step)
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    return f"WITH {'RECURSIVE ' if 'RECURSIVE_STEP' in body else ''}" + ", ".join(f"{n} AS MATERIALIZED ({_STEPS[n]})" for n in need) + (", " + body.split("RECURSIVE_STEP", 1)[1] if "RECURSIVE_STEP" in body else " " + body)


def _uuid5(name: str) -> str:
    ns = uuid.UUID(str(CHUNK_NAMESPACE)).hex
    h = f"sha1(unhex('{ns}') || encode({name}))"
    variant = f"printf('%02x', ({_hex(f'substr({h}, 17, 2)')} & 63) | 128)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


def _chunks(source: str, key: str, markdown: bool = False, limit: int = 512, overlap: int = 64) -> str:
    """The steps to ``chunk(key, index, char_start, char_end, token_count, section, text)`` of the texts of ``source``.

    Lines, sentences of long lines and word runs of long sentences are the pieces. What a
    run from piece ``t`` ends before depends on ``t`` alone, and so does the piece that the
    next one starts with: only that chain of starts is walked.
    """
    words = lambda x: rf"len(regexp_extract_all({x}, '\S+'))"
    named = rf"nullif(regexp_extract(body, '^={{2,6}}\s*(.+?)\s*={{2,6}}$', 1), '')"
    if markdown:
        named = rf"coalesce({named}, nullif(regexp_extract(body, '^#{{1,6}}\s+(.+?)$', 1), ''))"
    return rf"""RECURSIVE_STEP
    para AS MATERIALIZED (SELECT {key}, line, body, begins, section FROM (
      SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM (
        SELECT {key}, i AS line, {_strip("l")} AS body, {named} AS opened, before + len(l) - len(regexp_replace(l, '^\s+', '')) AS begins FROM (
          SELECT *, sum(len(l) + 1) OVER (PARTITION BY {key} ORDER BY i) - len(l) - 1 AS before FROM (
            SELECT {key}, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM {source} )))) WHERE body <> '') WHERE opened IS NULL),
    sentence AS MATERIALIZED (SELECT {key}, line, section, i AS part, rtrim(l, ' ' || chr(9) || chr(13)) AS own, begins + sum(len(l)) OVER (PARTITION BY {key}, line ORDER BY i) - len(l) AS begins FROM (
      SELECT {key}, line, section, begins, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
        SELECT *, string_split(regexp_replace(body, '([.!?]\s+)([A-Z0-9"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ls FROM para WHERE {words("body")} > {limit}))),
    piece AS MATERIALIZED (
      SELECT {key}, line, 0 AS part, 0 AS run, section, begins AS a, begins + len(body) AS b, {words("body")} AS cost FROM para WHERE {words("body")} <= {limit}
      UNION ALL SELECT {key}, line, part, 0, section, begins, begins + len(own), {words("own")} FROM sentence WHERE {words("own")} <= {limit}
      UNION ALL SELECT {key}, line, part, (i - 1) // {limit}, any_value(section), min(spot), max(spot + len(rtrim(w, ' ' || chr(9) || chr(13)))), count(*) FROM (
        SELECT *, begins + sum(len(w)) OVER (PARTITION BY {key}, line, part ORDER BY i) - len(w) AS spot FROM (
          SELECT {key}, line, part, section, begins, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(own, '\S+\s*') AS ws FROM sentence WHERE {words("own")} > {limit})))
        GROUP BY {key}, line, part, (i - 1) // {limit}),
    placed AS MATERIALIZED (SELECT *, lag(u, 1, -1) OVER o >= 0 AND section IS DISTINCT FROM lag(section) OVER o AS fresh, sum(cost + gap) OVER o - cost - gap AS paid FROM (
        SELECT p.{key}, a, b, cost, section, row_number() OVER q - 1 AS u, coalesce({words("substring(text, (lag(b) OVER q + 1)::BIGINT, (a - lag(b) OVER q)::BIGINT)")}, 0) AS gap
        FROM piece p JOIN {source} d ON d.{key} = p.{key} WINDOW q AS (PARTITION BY p.{key} ORDER BY a))
      WINDOW o AS (PARTITION BY {key} ORDER BY u)),
    ends AS MATERIALIZED (SELECT t.{key}, t.u, any_value(t.section) AS section, min(e.u) AS e FROM placed t JOIN placed e ON e.{key} = t.{key} AND e.u > t.u
      WHERE e.paid - t.paid - t.gap + e.gap + e.cost > {limit} OR (e.fresh AND e.paid - t.paid - t.gap >= {limit // 2}) GROUP BY ALL),
    onward AS MATERIALIZED (SELECT n.{key}, n.u, n.e, coalesce(min(v.u), n.e) AS next FROM ends n JOIN placed e ON e.{key} = n.{key} AND e.u = n.e
      LEFT JOIN placed v ON v.{key} = n.{key} AND v.u > n.u AND v.u < n.e AND NOT e.fresh AND n.section IS NOT DISTINCT FROM e.section
        AND e.paid - v.paid - v.gap <= least({overlap}, {limit} - e.gap - e.cost) GROUP BY n.{key}, n.u, n.e),
    run AS (SELECT DISTINCT {key}, 0::BIGINT AS index, 0::BIGINT AS u FROM placed
      UNION ALL SELECT r.{key}, r.index + 1, n.next FROM run r JOIN onward n ON n.{key} = r.{key} AND n.u = r.u),
    closed AS MATERIALIZED (SELECT r.*, coalesce(n.e, last + 1) - 1 AS z FROM run r JOIN (SELECT {key}, max(u) AS last FROM placed GROUP BY 1) m ON m.{key} = r.{key}
      LEFT JOIN onward n ON n.{key} = r.{key} AND n.u = r.u),
    chunk AS MATERIALIZED (SELECT c.{key}, c.index, f.a::INT AS char_start, g.b::INT AS char_end, (g.paid + g.gap + g.cost - f.paid - f.gap)::INT AS token_count, f.section, substring(text, f.a::BIGINT + 1, (g.b - f.a)::BIGINT) AS text
      FROM closed c JOIN placed f ON f.{key} = c.{key} AND f.u = c.u JOIN placed g ON g.{key} = c.{key} AND g.u = c.z JOIN {source} d ON d.{key} = c.{key})"""


def _picks(pool: str, vec: str, key: str, name: str) -> str:
    """The steps to ``name(query_id, rank, key, score)``: ten recursive picks from the first 40 of ``pool``."""
    return f"""
    {name}_pool AS MATERIALIZED (SELECT query_id, rank AS idx, {key}, score, CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel
      FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {pool} WHERE rank <= 40)),
    {name}_sims AS MATERIALIZED (SELECT a.query_id, a.idx AS i, b.idx AS j, list_cosine_similarity(x.dense, y.dense) AS sim
      FROM {name}_pool a JOIN {name}_pool b USING (query_id) JOIN {vec} x ON x.{key} = a.{key} JOIN {vec} y ON y.{key} = b.{key}),
    {name}_picks AS (
      SELECT query_id, 1 AS n, [arg_min(idx, (-round(rel, 12), idx))] AS chosen FROM {name}_pool GROUP BY query_id
      UNION ALL
      SELECT p.query_id, p.n + 1, list_append(p.chosen, c.idx) FROM {name}_picks p JOIN LATERAL (
        SELECT c.idx FROM {name}_pool c WHERE c.query_id = p.query_id AND NOT list_contains(p.chosen, c.idx)
        ORDER BY round(0.7 * c.rel - (1 - 0.7) * (SELECT max(s.sim) FROM {name}_sims s WHERE s.query_id = c.query_id AND s.i = c.idx AND list_contains(p.chosen, s.j)), 12) DESC, c.idx LIMIT 1
      ) c ON true WHERE p.n < 10),
    {name} AS (SELECT k.query_id, k.rank, o.{key}, o.score
      FROM (SELECT query_id, unnest(chosen) AS idx, generate_subscripts(chosen, 1) AS rank FROM {name}_picks WHERE n = (SELECT max(m.n) FROM {name}_picks m WHERE m.query_id = {name}_picks.query_id)) k
      JOIN {name}_pool o ON o.query_id = k.query_id AND o.idx = k.idx)"""


def _mmr(pool: str, vec: str, key: str) -> str:
    return f"RECURSIVE_STEP {_picks(pool, vec, key, 'chosen')} SELECT query_id, rank, {key}, round(score, 6) AS score FROM chosen"


_SQUASHED = _strip(r"regexp_replace(text, '\s+', ' ', 'g')")
_METRIC_COLUMNS = "round(recall_at_5, 6) AS recall_at_5, round(recall_at_k, 6) AS recall_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, round(mrr_at_k, 6) AS mrr_at_k"
_MEANS = "round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(mrr_at_k), 6) AS mrr_at_k"
_SHOWN = "SELECT query_id, rank, {id}, round(score, 6) AS score FROM {of} WHERE rank <= {k}"
_MIRROR_DICE = f"{_hex("substr(md5('7:' || doc_id || ':' || (i - 1)), 1, 8)")}::DOUBLE / 4294967296.0"
_PASSAGES = "SELECT doc_id, line, body AS passage FROM lines WHERE len(body) >= 300 AND body NOT LIKE '=%'"



def _pairs(documents: str) -> str:
    """The steps to ``chosen(topic, first, second)``: five pairs of ``documents(topic, doc_id)`` a topic, drawn by number."""
    return f"""
    ids AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS i FROM ({documents})),
    sizes AS (SELECT topic, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM ids GROUP BY topic HAVING count(*) >= 2),
    draws AS (SELECT topic, n, pairs, d, CASE WHEN pairs <= 20 THEN d ELSE ('0x' || substr(md5('13:' || topic || ':' || d), 1, 12))::BIGINT % pairs END AS p
      FROM (SELECT *, unnest(range(CASE WHEN pairs <= 20 THEN pairs ELSE 40 END)) AS d FROM sizes)),
    drawn AS (SELECT topic, p, min(d) AS d, any_value(pairs) AS pairs FROM draws GROUP BY topic, p),
    best AS (SELECT topic, p, floor((1 + sqrt(1 + 8 * p::DOUBLE)) / 2)::BIGINT AS b FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN pairs <= 20 THEN md5('13:' || topic || ':' || p) ELSE lpad(d::VARCHAR, 20, '0') END, p) AS r FROM drawn) WHERE r <= 5),
    chosen AS (SELECT best.topic, x.doc_id AS first, y.doc_id AS second FROM best JOIN ids x ON x.topic = best.topic AND x.i = p - b * (b - 1) // 2 JOIN ids y ON y.topic = best.topic AND y.i = b)"""


#: The list that each configuration of the ablation gives.
_ABLATION = {
    "Dense only": "dn", "BM25 only": "bm", "Hybrid (RRF)": "fused", "Hybrid + routing (m=1)": "fused_routed", "Hybrid + routing (m=3)": "fused_routed3",
    "Hybrid + MMR": "mmr_all", "Hybrid + routing (m=3) + MMR": "mmr_routed",
}
_BODIES = {
    "doc_hash": "SELECT * FROM hashed",
    "chunk_ids": f"SELECT doc_id, {_uuid5("doc_id || ':' || content_hash || ':0'")} AS chunk_id FROM hashed",
    "doc_dedup_first": "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)",
    "doc_duplicates": "SELECT doc_id, first::VARCHAR AS canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1",
    "squash_text": f"SELECT doc_id, md5({_SQUASHED}) AS digest, len({_SQUASHED}) AS chars FROM documents",
    "embedding_text": "SELECT conv_id, turn, md5('conversation ' || conv_id || CASE WHEN role = 'system' THEN '' ELSE ' — ' || role END || chr(10) || chr(10) || text) AS digest FROM conversations",
    "without_back_matter": rf"SELECT conv_id, md5({_strip(rf"regexp_replace(replace(text, '== assistant ==', '== References =='), '(?mi)^==\s*(?:{'|'.join(BACK_MATTER)})\s*==\s*$(?s:.*)', '')")}) AS digest FROM sectioned",
    "capped_sections": rf"""SELECT conv_id, md5(t) AS digest, len(t) AS chars FROM (SELECT conv_id, {_strip("string_agg(p, '' ORDER BY i)")} AS t FROM (
      SELECT conv_id, i, p, sum(len(p)) OVER (PARTITION BY conv_id ORDER BY i) AS total FROM (
        SELECT conv_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
          SELECT conv_id, list_filter(string_split(regexp_replace(text, '(?m)^(==[^=].*==\s*)$', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS ps FROM sectioned)))
      WHERE total <= 600 GROUP BY conv_id
      UNION ALL SELECT conv_id, '' FROM (SELECT conv_id, string_split(regexp_replace(text, '(?m)^(==[^=].*==\s*)$', chr(1) || '\1', 'g'), chr(1))[2] AS p FROM sectioned) WHERE len(p) > 600)""",
    "ingest_changed_docs": "SELECT * FROM changed",
    "ingest_counts": "SELECT (SELECT count(*) FROM hashed) AS seen, (SELECT count(*) FROM hashed) - (SELECT count(*) FROM changed) AS unchanged, (SELECT count(*) FROM changed) AS indexed, 0::BIGINT AS failed",
    "replace_document": "SELECT * FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM changed) UNION ALL SELECT * FROM changed",
    "stored_replace": "SELECT * FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM changed) UNION ALL SELECT * FROM changed",
    "posting_blocks": "SELECT term, count(*) AS n, max(tf) AS max_tf, min(dl)::BIGINT AS min_dl, count(*) AS entries FROM post JOIN lens USING (doc_id) GROUP BY term",
    "bm25_pruned_topk": f"SELECT query_id, place AS rank, doc_id, round(score, 6) AS score FROM (SELECT query_id, doc_id::VARCHAR AS doc_id, score, {_TOP.format(id='doc_id::VARCHAR').replace('AS rank', 'AS place')} FROM bm) WHERE place <= 10",
    "routed_lists_topk": f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT query_id, vec_id::VARCHAR AS vec_id, score, {_TOP.format(id='vec_id::VARCHAR')} FROM (SELECT n.query_id, n.vec_id, n.score FROM near_vec n JOIN vecs v USING (vec_id) JOIN routes r ON r.query_id = n.query_id AND r.cluster_id = v.cluster_id AND r.rank <= 3)) WHERE rank <= 10",
    "paragraphs": r"""SELECT doc_id, line, (coalesce(begins, 0) + len(raw) - len(regexp_replace(raw, '^\s+', '')))::BIGINT AS "start", (coalesce(begins, 0) + len(raw) - len(regexp_replace(raw, '^\s+', '')) + len(body))::BIGINT AS "end" FROM lines WHERE body <> ''""",
    "section_lines": rf"""SELECT conv_id, line, section, md5(body) AS digest FROM (
      SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM (
        SELECT conv_id, i - 1 AS line, {_strip("l")} AS body, nullif(regexp_extract({_strip("l")}, '^={{2,6}}\s*(.+?)\s*={{2,6}}$', 1), '') AS opened
        FROM (SELECT conv_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, string_split(text, chr(10)) AS ls FROM sectioned))) WHERE body <> '') WHERE opened IS NULL""",
    "postings": "SELECT * FROM post",
    "doc_freq": "SELECT * FROM freq",
    "doc_length": "SELECT doc_id, dl FROM lens",
    "corpus_statistics": "SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM whole",
    "bm25_weights": "SELECT doc_id, term, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS weight FROM post JOIN lens USING (doc_id) , whole",
    "hash_embed": "SELECT doc_id, i, round(w / n, 9) AS x FROM doc_terms_sums JOIN (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS n FROM doc_terms_sums GROUP BY 1) USING (doc_id) WHERE w <> 0",
    "bm25_topk": _SHOWN.format(id="doc_id", of="bm", k=10),
    "dense_topk": _SHOWN.format(id="vec_id", of="near_vec", k=10),
    "route_clusters": _SHOWN.format(id="cluster_id", of="routes", k=3),
    "dense_topk_filtered": f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT query_id, vec_id, score, {_TOP.format(id='vec_id')} FROM (SELECT n.query_id, n.vec_id, n.score FROM near_vec n JOIN vecs v USING (vec_id) JOIN routes r ON r.query_id = n.query_id AND r.cluster_id = v.cluster_id AND r.rank <= 3)) WHERE rank <= 10",
    "hybrid_rrf": "SELECT query_id, rank, doc_id, round(score, 9) AS score FROM fused WHERE rank <= 40",
    "hybrid_minmax": "SELECT query_id, doc_id, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS relevance FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM fused WHERE rank <= 40)",
    "hybrid_mmr": _mmr("fused", "doc_vec", "doc_id"),
    "dense_mmr": _mmr("near_vec", "vecs", "vec_id"),
    "retrieve_default": _mmr("fused", "doc_vec", "doc_id"),
    "lloyd_step": "SELECT cluster_id, i - 1 AS i, round(centroid[i], 6) AS x FROM topic, (SELECT unnest(range(1, 65)) AS i)",
    "minibatch_step": """SELECT cluster_id, met, i - 1 AS i, round(c + coalesce(s - n * c, 0) / met, 6) AS x FROM (
      SELECT cluster_id, i, any_value(label_first.c[i]) AS c, sum(near_first.u[i]) AS s, count(near_first.vec_id) AS n, 10 + count(near_first.vec_id) AS met
      FROM label_first CROSS JOIN (SELECT unnest(range(1, 65)) AS i) LEFT JOIN near_first USING (cluster_id) GROUP BY cluster_id, i)""",
    "normalized_vectors": "SELECT vec_id, i - 1 AS i, round(u[i], 6) AS x FROM units, (SELECT unnest(range(1, 65)) AS i)",
    "assign_clusters": "SELECT vec_id, cluster_id, round(s, 6) AS similarity FROM (SELECT vec_id, t.cluster_id, round(list_cosine_similarity(dense, centroid), 12) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(dense, centroid), 12) DESC, t.cluster_id) AS r FROM vecs , topic t) WHERE r = 1",
    "cluster_sizes": "SELECT cluster_id, count(vec_id) AS size FROM topic LEFT JOIN (SELECT vec_id, t.cluster_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(dense, centroid), 12) DESC, t.cluster_id) AS r FROM vecs , topic t) a USING (cluster_id) WHERE r = 1 OR r IS NULL GROUP BY cluster_id",
    "purity": "SELECT round(sum(most) / sum(n_all), 4) AS purity FROM (SELECT c, max(n) AS most, sum(n) AS n_all FROM (SELECT c, topic, count(*) AS n FROM (SELECT vec_id, v.cluster_id AS topic, t.cluster_id AS c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(dense, centroid), 12) DESC, t.cluster_id) AS r FROM vecs v , topic t) WHERE r = 1 GROUP BY ALL) GROUP BY c)",
    "silhouette_fixed": """SELECT vec_id, cluster_id, round(CASE WHEN n_own = 0 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM (
      SELECT vec_id, cluster_id, max(CASE WHEN c = cluster_id THEN d END) AS a, min(CASE WHEN c <> cluster_id THEN d END) AS b, coalesce(max(CASE WHEN c = cluster_id THEN n END), 0) AS n_own FROM (
        SELECT x.vec_id, x.cluster_id, y.cluster_id AS c, avg(1 - list_dot_product(x.u, y.u)) AS d, count(*) AS n FROM units x , units y WHERE x.vec_id <> y.vec_id GROUP BY ALL) GROUP BY ALL)""",
    "relevant_documents": "SELECT * FROM rel",
    "rank_metrics": f"SELECT config, query_id, first_relevant_rank, {_METRIC_COLUMNS}, distinct_docs FROM scores",
    "ils": """SELECT config, query_id, round(avg(sim), 6) AS ils FROM (
      SELECT a.config, a.query_id, list_dot_product(x.dense, y.dense) AS sim FROM results a JOIN results b ON a.config = b.config AND a.query_id = b.query_id AND a.rank < b.rank JOIN doc_vec x ON x.doc_id = a.doc_id JOIN doc_vec y ON y.doc_id = b.doc_id) GROUP BY ALL""",
    "metric_summary": f"SELECT config, count(*) AS n_queries, {_MEANS}, round(avg(distinct_docs), 6) AS distinct_docs FROM scores GROUP BY config",
    "summary_by_source": "SELECT config, source, count(*) AS n_queries, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(recall_at_k), 6) AS recall_at_k FROM scores JOIN (SELECT query_id, arg_min(lang, doc_id) AS source FROM rel JOIN documents USING (doc_id) GROUP BY 1) USING (query_id) GROUP BY ALL",
    "best_row": "SELECT config, round(m, 6) AS ndcg_at_k FROM (SELECT config, round(avg(ndcg_at_k), 9) AS m, max(round(avg(ndcg_at_k), 9)) OVER () AS best FROM scores GROUP BY config) WHERE m = best",
    "paired_delta": "SELECT s.config, query_id, round(s.ndcg_at_k - b.ndcg_at_k, 6) AS delta FROM scores s JOIN (SELECT query_id, ndcg_at_k FROM scores WHERE config = 'hybrid') b USING (query_id)",
    "bootstrap_ci": f"""SELECT config, round(mean, 6) AS mean, round(p[1], 6) AS lo, round(p[2], 6) AS hi FROM (SELECT config, avg(ndcg_at_k) AS mean FROM scores GROUP BY 1) JOIN (
      SELECT config, quantile_cont(m, [0.025, 0.975]) AS p FROM (
        SELECT config, draw, avg(v) AS m FROM (
          SELECT draw, {_hex("substr(md5(draw || ':' || place), 1, 8)")} % n AS i FROM (SELECT id // n AS draw, id % n AS place, n FROM (SELECT unnest(range(2000 * n)) AS id, n FROM (SELECT count(DISTINCT query_id) AS n FROM scores )))) d
        JOIN (SELECT config, ndcg_at_k AS v, dense_rank() OVER (ORDER BY query_id) - 1 AS i FROM scores ) s USING (i) GROUP BY ALL) GROUP BY ALL) USING (config)""",
    "median_chars": "SELECT source, median(n_chars) AS median_chars FROM documents GROUP BY source",
    "topic_counts": "SELECT source, count(*) AS documents, string_agg(DISTINCT lang, ',' ORDER BY lang) AS topics FROM documents GROUP BY source",
    "routing_diag": "SELECT query_id, array_to_string(routed, ',') AS routed, array_to_string(relevant_clusters, ',') AS relevant_clusters FROM diagnosis",
    "routing_loss": """SELECT count(*) AS queries, count_if(lost) AS lost, count_if(o) AS outside, count_if(lost AND o) AS lost_outside,
      round(CASE WHEN count_if(o) > 0 THEN count_if(lost AND o) / count_if(o) END, 6) AS loss_rate_outside, round(CASE WHEN count_if(NOT o) > 0 THEN count_if(lost AND NOT o) / count_if(NOT o) END, 6) AS loss_rate_inside
      FROM (SELECT r.n < h.n - 1e-9 AS lost, len(list_filter(relevant_clusters, lambda c: c <> routed[1])) > 0 AS o FROM diagnosis d
        JOIN (SELECT query_id, ndcg_at_k AS n FROM routed_scores WHERE config = 'hybrid') h USING (query_id) JOIN (SELECT query_id, ndcg_at_k AS n FROM routed_scores WHERE config = 'routed') r USING (query_id))""",
    "embedding_batches": """RECURSIVE_STEP
    texts AS MATERIALIZED (SELECT source, doc_id, len(terms) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM doc_terms JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
    filled AS (
      SELECT source, doc_id, tokens, i, 0::BIGINT AS batch, 1 AS held, tokens AS size FROM texts WHERE i = 1
      UNION ALL
      SELECT t.source, t.doc_id, t.tokens, t.i, f.batch + fresh::INT, CASE WHEN fresh THEN 1 ELSE f.held + 1 END, CASE WHEN fresh THEN t.tokens ELSE f.size + t.tokens END
      FROM (SELECT *, i + 1 AS next FROM filled) f JOIN texts t ON t.source = f.source AND t.i = f.next, LATERAL (SELECT f.held = 128 OR f.size + t.tokens > 20000 AS fresh))
    SELECT doc_id, source, tokens, batch FROM filled""",
    "chunk_pack": f"""{_chunks("titled", "doc_id")}
    SELECT c.doc_id, index, char_start, char_end, token_count, {_uuid5("c.doc_id || ':' || content_hash || ':' || index")} AS chunk_id, md5(text) AS digest FROM chunk c JOIN hashed h ON h.doc_id = c.doc_id""",
    "chunk_sections": f"{_chunks('sectioned', 'conv_id', markdown=True)} SELECT conv_id::VARCHAR AS doc_id, index, section, token_count, md5(text) AS digest FROM chunk",
    "multihop_pairs": f"RECURSIVE_STEP {_pairs('SELECT DISTINCT lang AS topic, doc_id FROM documents')} SELECT topic, first, second FROM chosen",
    "evaluation_set": f"""RECURSIVE_STEP
    picked AS MATERIALIZED (SELECT p.doc_id::VARCHAR AS doc_id, line, passage, source, lang AS topic FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('13:' || doc_id || ':' || line), line) AS r FROM ({_PASSAGES})) p JOIN documents d ON d.doc_id = p.doc_id WHERE r <= 2),
    one AS MATERIALIZED (SELECT doc_id, arg_min(passage, line) AS passage, any_value(topic) AS topic FROM picked GROUP BY doc_id),
    {_pairs('SELECT topic, doc_id FROM one')}
    SELECT doc_id || '#' || line AS query_id, md5('What is said about: ' || substr(passage, 1, 80) || '?') AS digest, doc_id AS relevant, source, topic FROM picked
    UNION ALL SELECT first || '+' || second, md5('What is said about: ' || substr(x.passage, 1, 80) || ' / ' || substr(y.passage, 1, 80) || '?'), first || ',' || second, 'multihop', c.topic
      FROM chosen c JOIN one x ON x.doc_id = first JOIN one y ON y.doc_id = second""",
    "ablation_summary": f"""RECURSIVE_STEP {_picks("fused", "doc_vec", "doc_id", "mmr_all")}, {_picks("fused_routed3", "doc_vec", "doc_id", "mmr_routed")},
    lists AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{name}' AS config, query_id, rank, doc_id FROM {of} WHERE rank <= 10" for name, of in _ABLATION.items())}),
    judged AS MATERIALIZED ({_scored("lists")})
    SELECT config, count(*) AS n_queries, {_MEANS}, round(avg(distinct_docs), 6) AS distinct_docs FROM judged GROUP BY config""",
    "passage_candidates": f"SELECT doc_id, line, md5(passage) AS digest FROM ({_PASSAGES})",
    "sample_passages": f"SELECT doc_id, line, md5(passage) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('13:' || doc_id || ':' || line), line) AS r FROM ({_PASSAGES})) WHERE r <= 2",
    "mirrors": f"""SELECT 'mirror:' || doc_id AS doc_id, md5(text) AS digest, doc_id AS duplicate_of, lang AS topic FROM (
      SELECT doc_id, lang, string_agg(l, chr(10) ORDER BY i) AS text FROM (
        SELECT doc_id, lang, l, i, coalesce(list_position(list_transform(ls, lambda x: starts_with(x, '==')), true) - 1, len(ls)) AS lead FROM (
          SELECT doc_id, lang, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
            SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM titled WHERE source = 'src0') WHERE r <= 5)))
      WHERE i - 1 < lead OR starts_with(l, '==') OR {_strip("l")} = '' OR {_MIRROR_DICE} >= 0.2 GROUP BY ALL)""",
}
ORACLE_SQL = {name: _with(body) for name, body in _BODIES.items()}
