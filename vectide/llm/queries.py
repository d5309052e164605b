"""Registered queries of the text operators, over whole tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.llm import (
    bpe, crosstok, decontaminate, licenses, linededup, merkle, nndescent, pii, quality, secretscan, simhash, substrings, warc,
)
from vectide.llm.shared import table
from vectide.plans.registry import query as _register
from vectide.session import new_folder

TEXT_QUERIES, TEXT_ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Registers in tables of its own, so that a module that cannot be imported leaves no query behind."""
    return _register(name, sql, TEXT_QUERIES, TEXT_ORACLE)


TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_simhash")
def op1(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_quality")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.grade(docs, quality.train(docs, table(spark, folder, "labels"))).drop("text_key")


@query("op3_secrets")
def op3(spark, folder):
    return secretscan.scan(table(spark, folder, "documents"))


@query("op4_substrings", r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM split WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS t FROM places),
marked AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM marked) GROUP BY doc_id)
SELECT split.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ps, k::BIGINT)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone ON split.doc_id = gone.doc_id""")
def op4(spark, folder):
    return substrings.repeat_digests(table(spark, folder, "documents"))


@query("op5_licenses")
def op5(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op6_pii")
def op6(spark, folder):
    return pii.scan(table(spark, folder, "documents"))


@query("op7_decontamination", r"""
WITH split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x{1}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM documents),
items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x{1}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t
    FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)),
places AS (
    SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM split, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n),
windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM places),
hits AS (SELECT doc_id, w.n, i, item_id FROM windows w JOIN item_windows v ON w.t = v.t AND w.n = v.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hits GROUP BY doc_id)
SELECT split.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN covered ON split.doc_id = covered.doc_id LEFT JOIN listed ON split.doc_id = listed.doc_id""")
def op7(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_lines", r"""
WITH lines AS (
    SELECT doc_id, i, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS f FROM (
        SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
units AS (SELECT *, sum(f::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM lines),
pieces AS (SELECT doc_id, u, f, min(i) AS i, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS p FROM units GROUP BY doc_id, u, f),
keys AS (
    SELECT doc_id, i, n, p, CASE WHEN f THEN 'line' || p WHEN u > 0 THEN 'tail' || lag(p) OVER w || chr(10) || p
        WHEN lead(p) OVER w IS NOT NULL THEN 'head' || p || chr(10) || lead(p) OVER w END AS k
    FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
marked AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS gone FROM keys)
SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(p, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op8(spark, folder):
    lines = linededup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_removed",
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_bpe")
def op9(spark, folder):
    return bpe.encode_digests(table(spark, folder, "documents"), tokenizer_path())


@query("op10_embeddings", """
WITH RECURSIVE links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, y FROM reach JOIN links ON r = x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(max(n), 0)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN degree ON vec_id = x GROUP BY vec_id""")
def op10(spark, folder):
    return nndescent.near_duplicates(table(spark, folder, "embeddings"))


@query("op11_crosstok")
def op11(spark, folder):
    return crosstok.align_documents(table(spark, folder, "documents"), tokenizer_path(BYTE_TOKENIZER),
                                    tokenizer_path(PIECE_TOKENIZER))


@query("op12_merkle", r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, n_chars,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END ||
           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
           CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM documents),
summed AS (  -- CRC-32 of the decimal doc_id, bit by bit; -1 stands for one shift
    SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
               string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x & 1) * 3988292384) END)) AS crc FROM fields),
leaves AS (
    SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS h,
           CASE WHEN n_chars IS NOT NULL AND crc % 7 = 0
                THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM summed),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
    SELECT 0 AS level, lang, p, n, h, lead(h) OVER (PARTITION BY lang ORDER BY p) AS nxt FROM placed
    UNION ALL
    SELECT level, lang, p, n, h, lead(h) OVER (PARTITION BY lang ORDER BY p)
    FROM (SELECT level + 1 AS level, lang, p // 2 AS p, (n + 1) // 2 AS n, sha256(h || coalesce(nxt, '')) AS h
          FROM nodes WHERE n > 1 AND p % 2 = 0)),
langs AS (
    SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
    SELECT 0 AS level, p, n, h, lead(h) OVER (ORDER BY p) AS nxt FROM langs
    UNION ALL
    SELECT level, p, n, h, lead(h) OVER (ORDER BY p)
    FROM (SELECT level + 1 AS level, p // 2 AS p, (n + 1) // 2 AS n, sha256(h || coalesce(nxt, '')) AS h
          FROM upper WHERE n > 1 AND p % 2 = 0)),
low AS (
    SELECT 0 AS level, lang, p AS leaf_p, p, n, '' AS proof, coalesce(changed, h) AS cur FROM placed
    UNION ALL
    SELECT low.level + 1, low.lang, leaf_p, low.p // 2, (low.n + 1) // 2, proof || coalesce(s.h, ''),
           CASE WHEN low.p % 2 = 1 THEN sha256(s.h || cur) ELSE sha256(cur || coalesce(s.h, '')) END
    FROM low LEFT JOIN nodes s ON s.level = low.level AND s.lang IS NOT DISTINCT FROM low.lang AND s.p = xor(low.p, 1)
    WHERE low.n > 1),
high AS (
    SELECT 0 AS level, low.lang, leaf_p, langs.p, langs.n, proof, cur FROM low JOIN langs ON langs.lang IS NOT DISTINCT FROM low.lang
    WHERE low.n = 1
    UNION ALL
    SELECT high.level + 1, lang, leaf_p, high.p // 2, (high.n + 1) // 2, proof || coalesce(s.h, ''),
           CASE WHEN high.p % 2 = 1 THEN sha256(s.h || cur) ELSE sha256(cur || coalesce(s.h, '')) END
    FROM high LEFT JOIN upper s ON s.level = high.level AND s.p = xor(high.p, 1) WHERE high.n > 1)
SELECT doc_id, placed.h AS leaf, langs.h AS subroot, upper.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
       cur = upper.h AS verified
FROM placed JOIN high ON high.lang IS NOT DISTINCT FROM placed.lang AND leaf_p = placed.p AND high.n = 1
JOIN langs ON langs.lang IS NOT DISTINCT FROM placed.lang, upper WHERE upper.n = 1""")
def op12(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


@query("op13_warc", r"""
WITH rows AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
held AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS holder FROM rows)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')
           AS payload_digest,
       CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < holder THEN holder END AS refers_to
FROM held""")
def op13(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"), new_folder(spark, "warc"))


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
