"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lithos.llm.bpe import bpe_digests
from lithos.llm.common import documents
from lithos.llm.exact_dedup import exact_dedup
from lithos.llm.exact_search import exact_top_k
from lithos.llm.filter_audit import filter_audit
from lithos.llm.html_text import html_text
from lithos.llm.language_id import language_id
from lithos.llm.mixing import mix_query
from lithos.llm.near_dedup import near_dedup
from lithos.llm.packing import pack
from lithos.llm.quotation import link_quotations, with_planted_quotes
from lithos.llm.token_counts import falls_back, token_counts, vocabulary
from lithos.llm.vector_codes import ENTRIES, PARTS, ROUNDS, vector_codes
from lithos.llm.warc import audit_pages

#: The tokenizer file of the encoding queries.
WORD_BPE = "word_bpe_49k.json"
#: The file whose pieces and scores are the unigram vocabulary of the counting query.
PIECES = "piece_bpe_32k.model"


def op1_quotation_linking(spark, sf_dir):
    return link_quotations(with_planted_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op2_token_counts(spark, sf_dir):
    path = public_tokenizers.path(PIECES)
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary(path), byte_fallback=falls_back(path), keep_text=False)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op4_bpe_round_trip(spark, sf_dir):
    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op5_exact_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0)


def op6_near_dedup(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir), size=2)


def op7_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_merkle_audit(spark, sf_dir):
    return audit_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_mix_to_weights(spark, sf_dir):
    return mix_query(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    return language_id(documents(spark, sf_dir))


def op11_filter_audit(spark, sf_dir):
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(WORD_BPE))


def op13_vector_codes(spark, sf_dir):
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_token_counts": op2_token_counts,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_near_dedup": op6_near_dedup,
    "op7_html_text": op7_html_text,
    "op8_merkle_audit": op8_merkle_audit,
    "op9_mix_to_weights": op9_mix_to_weights,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_vector_codes": op13_vector_codes,
}


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The SQL of the coding query: one block of WITH for each round, every part held against every entry."""
    nearest = "SELECT id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT x.id, x.p, c.entry, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - c.x[i]) * (x.x[i] - c.x[i]))) AS d FROM x JOIN c{k} c USING (p)) GROUP BY id, p"
    blocks = []
    for k in range(rounds + 1):
        blocks.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k).replace('SELECT id,', 'SELECT id, p,', 1)})")
        if k < rounds:
            mean = f"SELECT p, entry, list(m ORDER BY i) AS x FROM (SELECT p, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM (SELECT x.p, a.entry, unnest(x.x) AS v, unnest(range(len(x.x))) AS i FROM x JOIN a{k} a USING (id, p)) GROUP BY p, entry, i) GROUP BY p, entry"
            blocks.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN ({mean}) m USING (p, entry))")
    return f"""
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) r(p)),
        c0 AS MATERIALIZED (SELECT p, id - 1 AS entry, x FROM x WHERE id <= {entries}),
        {", ".join(blocks)},
        e AS (SELECT id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
        s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (id), s"""


ORACLES = {
    "op1_quotation_linking": r"""
        WITH RECURSIVE base AS (SELECT conv_id, turn, min(text) AS said FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
        planted AS (
            SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 4
                     WHEN 1 THEN '> ' || split_part(a.said, chr(10), 1)
                     WHEN 2 THEN 'On the turn before, the other one wrote:' || chr(10) || '> ' || replace(replace(a.said, chr(10), ' '), ', ', ',' || chr(10) || '> ')
                     WHEN 3 THEN '>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(a.said, chr(10), chr(10) || '> ') END
                     || chr(10) || c.text, c.text) AS text
            FROM conversations c LEFT JOIN base a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.turn = c.turn - 1
            LEFT JOIN base b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.turn = c.turn - 2),
        m AS (SELECT *, coalesce(text, '') AS raw, row_number() OVER () AS rid FROM planted),
        x AS (SELECT rid, regexp_split_to_array(raw, '\r\n|\n|\r') AS lines FROM m),
        y AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM x),
        l AS (
            SELECT rid, pos, length(regexp_replace(regexp_extract(line, '^[\t ]*((?:>[\t ]*)*)', 1), '[^>]', '', 'g')) AS level,
                   regexp_replace(line, '^[\t ]*((?:>[\t ]*)*)', '') AS content FROM y),
        n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY pos), 0) AS below FROM l),
        own AS (
            SELECT rid, trim(coalesce(string_agg(content, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (below > 0 AND regexp_matches(
                   lower(content), '^(?:on|le|am|el) .* (?:wrote|écrit|schrieb|escribió)[\t ]*:$'))), ''), E' \t\r\n') AS own FROM n GROUP BY rid),
        deep AS (SELECT rid, level, string_agg(content, ' ' ORDER BY pos) AS body FROM l WHERE level > 0 GROUP BY rid, level),
        cut AS (
            SELECT rid, level, trim(unnest(regexp_extract_all(lower(regexp_replace(body, '[\t\n\v\f\r ]+', ' ', 'g')), '[^.!?]+[.!?]*')), ' ') AS passage
            FROM (SELECT rid, 0 AS level, own AS body FROM own UNION ALL SELECT rid, level, body FROM deep)),
        p AS (SELECT DISTINCT rid, level, passage, conv_id, turn FROM cut JOIN m USING (rid) WHERE passage <> ''),
        first AS (SELECT conv_id, passage, min(turn) AS first FROM p WHERE level = 0 AND turn IS NOT NULL GROUP BY ALL),
        found AS (SELECT rid, p.conv_id, turn, level, first FROM p JOIN first f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.passage = f.passage AND first < turn AND level > 0),
        counts AS (SELECT rid, count(*) AS n_linked FROM found GROUP BY rid),
        up AS (SELECT conv_id, turn, arg_max(first, -level * 1000000000 + first) AS parent FROM found GROUP BY conv_id, turn),
        walk AS (
            SELECT conv_id, turn, parent AS root, 1 AS depth FROM up UNION ALL
            SELECT w.conv_id, w.turn, u.parent, depth + 1 FROM walk w JOIN up u ON u.conv_id IS NOT DISTINCT FROM w.conv_id AND u.turn = w.root),
        roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM walk GROUP BY conv_id, turn)
        SELECT m.conv_id, m.turn, m.role, own.own AS text, (SELECT count(*) FROM p WHERE p.rid = m.rid AND level > 0) AS n_quoted,
               coalesce(n_linked, 0) AS n_linked, parent AS parent_turn, coalesce(root, m.turn) AS root_turn, coalesce(depth, 0) AS depth,
               CASE WHEN m.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, m.turn) NULLS LAST, m.turn NULLS LAST) END AS position
        FROM m JOIN own USING (rid) LEFT JOIN counts USING (rid)
        LEFT JOIN up ON up.conv_id IS NOT DISTINCT FROM m.conv_id AND up.turn = m.turn
        LEFT JOIN roots ON roots.conv_id IS NOT DISTINCT FROM m.conv_id AND roots.turn = m.turn""",
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.v) = len(q.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS n FROM p)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op11_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS original FROM t),
        l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)) AS good, max(coalesce(toxic = 1, FALSE)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        f AS (
            SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
                   regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > original, FALSE) AS e, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
            FROM w LEFT JOIN l USING (doc_id)),
        m AS (
            SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, a::INT + b::INT + c::INT + d::INT + e::INT AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t
            WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
        g AS (
            SELECT part, o, step, o[step] AS own, f[o[step]] AS fails, failed, n, good, toxic,
                   len(list_filter(range(1, step), lambda i: f[o[i]])) > 0 AS gone
            FROM m, o, range(1, 6) r(step)),
        h AS (
            SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
                   coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
            FROM g GROUP BY part, o, step, own)
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM h""",
    "op13_vector_codes": codes_sql(),
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON a = doc_id""",
    "op8_merkle_audit": """
        WITH t AS (
            SELECT page_id, page_id // 1000 AS archive, url, html,
                   CASE WHEN page_id % 50 = 7 THEN replace(html, '<p>', '<P>') ELSE html END AS other FROM pages),
        h AS (
            SELECT *, E'WARC/1.0\\r\\nWARC-Type: resource\\r\\nWARC-Target-URI: ' || coalesce(url, '') || E'\\r\\nWARC-Date: 2024-01-01T00:00:00Z\\r\\nWARC-Record-ID: <urn:page:'
                   || page_id || E'>\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ' AS head FROM t),
        r AS (
            SELECT page_id, archive, head || strlen(html) || E'\\r\\n\\r\\n' || html AS a, head || strlen(other) || E'\\r\\n\\r\\n' || other AS b FROM h),
        o AS (
            SELECT page_id, archive, sha256(a) AS a, CASE WHEN page_id % 50 = 13 THEN NULL ELSE sha256(b) END AS b,
                   coalesce(sum(strlen(a) + 4) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r)
        SELECT archive, CAST(place AS BIGINT) AS "offset", sha256(a || ':1') AS left_digest, sha256(b || ':1') AS right_digest,
               CASE WHEN b IS NULL THEN 'missing' ELSE 'changed' END AS status
        FROM o WHERE b IS DISTINCT FROM a""",
}
