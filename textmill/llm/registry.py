"""Queries of the training-data operators: thin wrappers over whole tables, with production parameters."""

from __future__ import annotations

from .common import table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .line_dedup import BREAKS, HOST, RATIO, REPEATED, TAGS, dedup_page_lines
from .packing import pack
from .quality import quality
from .quotation import link_quotations
from .sharding import shards
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of a public tokenizer is; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quotation(spark, sf_dir):
    """Conversations without quotes; reply_to is -1 where a message answers none."""
    return link_quotations(table(spark, sf_dir, "conversations")).fillna(-1, ["reply_to"])


def op2_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), width=13)


def op4_line_dedup(spark, sf_dir):
    return dedup_page_lines(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"), n_shards=16)


def op10_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quotation": op1_quotation,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    # the tables quote nothing, so SQL says positions, default replies and copies; tests/llm has quotations by brute force
    "op1_quotation": r"""
        WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, count(*) AS copies FROM conversations GROUP BY ALL)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn, role, trim(t, chr(10)) AS text,
            coalesce(max(turn) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reply_to,
            CAST(0 AS BIGINT) AS n_passages, CAST(0 AS BIGINT) AS n_linked, 0 AS max_depth, copies FROM m""",
    "op2_decontamination": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM starts),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        grams AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM places, sizes WHERE i + n - 1 <= len(w)),
        found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM places WHERE i + 12 <= len(w)),
        firsts AS (SELECT g, min(doc_id) AS m FROM windows GROUP BY g HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (g) WHERE m < doc_id),
        kept AS (SELECT p.doc_id, string_agg(w[p.i], ' ' ORDER BY p.i) AS t, count(*) AS n FROM places p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_line_dedup": rf"""
        WITH parts AS (SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), '[\x20\x09\x0B\x0C]+', ' ', 'g') AS p FROM pages),
        rows AS (SELECT page_id, host, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM parts),
        seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(l)) AS line FROM rows WHERE host IS NOT NULL) GROUP BY host, line),
        sites AS (SELECT host, count(*) AS n_pages FROM rows WHERE host IS NOT NULL GROUP BY host),
        bad AS (SELECT host, list(line) AS lines FROM seen JOIN sites USING (host) WHERE n >= {REPEATED} AND n / n_pages > {RATIO} GROUP BY host),
        kept AS (SELECT page_id, rows.host, l, list_filter(l, lambda x: NOT list_contains(coalesce(bad.lines, []), x)) AS k FROM rows LEFT JOIN bad ON rows.host = bad.host)
        SELECT page_id, host, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(k) AS BIGINT) AS n_dropped, array_to_string(k, chr(10)) AS text FROM kept""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
}
