"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, html_text, language_id, line_dedup, mixing, near_dedup, secrets, suffix_dedup, token_output
from lectern.llm.common import documents, read, work_path
from lectern.llm.exact_dedup import exact_dedup


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op5_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents")).drop("key")


def op6_line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "tokens")
    shards = token_output.write_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), folder, end_id=0)
    return token_output.read_tokens(spark, folder, shards)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learners(docs))
    found = language_id.identify(documents(docs, "doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "langs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCH_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op2_decontaminate": f"""
        WITH b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
        runs AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win)),
        occ AS (SELECT r.doc_id, r.p, r.m, win.item_id FROM runs r
                JOIN win ON win.m = r.m AND win.g = array_to_string(r.w[r.p:r.p + r.m - 1], ' ')),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM occ) GROUP BY 1),
        it AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
               FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
               sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_chosen_paths": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
               d.doc_id <= coalesce(c.m, d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id""",
    "op6_line_sites": f"""
        WITH l AS (SELECT doc_id, coalesce('s' || source, 'null') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        gone AS (SELECT line FROM l WHERE length(trim(line)) > 0 GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.SITES}),
        m AS (SELECT doc_id, line, pos, line IN (SELECT line FROM gone) AS g FROM l)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (g)::BIGINT AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT g), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
