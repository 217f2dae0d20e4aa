"""The operators as queries over the given tables, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import decontamination, exact_dedup, merkle, near_dedup, packing, pii, prefix_trie, substring_dedup, suffix_dedup, token_rollup, tool_calls, toxicity, url_rules
from gavelflow.llm.scratch import Scratch


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over whole documents: all texts are inserted as they are, those with outer
    blanks are revised to their trimmed counts, and those of fewer than 200 characters left are
    deleted. The totals are those of the trimmed texts that stay."""
    version, path = "word_bpe_49k", tokenizer_file()
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("trimmed", F.trim("text"))
    count = lambda rows, text: token_rollup.token_counts(rows, path, version, text_col=text)
    ledger = token_rollup.TokenLedger(spark, Scratch(spark, "token-counts").root)
    everything = token_rollup.inserted(count(docs, "text"))
    ledger.commit("documents", everything)
    ledger.commit("documents", everything)  # sent again, as after a failure: counts once
    blank = docs.filter("text <> trimmed")
    # A revision is the old count taken away and the new one added, of the same documents.
    out, back = token_rollup.deleted(count(blank, "text")), token_rollup.inserted(count(blank, "trimmed"))
    ledger.commit("trimmed", out.unionByName(back))
    ledger.commit("too-short", token_rollup.deleted(count(docs.filter("length(trimmed) < 200"), "trimmed")))
    ledger.compact()
    return ledger.totals()


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(table(spark, sf_dir, "documents"), merkle.tampered_by_id()).proofs()


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OPERATORS = [op1_exact_dedup, op2_near_dedup, op3_pii, op4_decontamination, op5_suffix_dedup, op6_substring_dedup, op7_toxicity, op8_token_counts, op9_tool_calls, op10_packing, op11_url_filters, op12_merkle_manifest, op13_prefix_trie]
QUERIES = {f.__name__: f for f in OPERATORS}

#: CRC-32 of texts by its table of 256 entries; SQL begins with it and applies crc(x).
CRC_SQL = """
        crc_table AS (
            SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tbl FROM range(256) r(b)),"""


def crc_sql(ascii_text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({ascii_text}, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_decontamination": r"""
        WITH item_words AS (
            SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS win
            FROM item_words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
        doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
        spots AS (
            SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM doc_words, sizes,
            LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n),
        found AS (SELECT s.doc_id, s.i, s.n, x.item FROM spots s JOIN windows x ON s.win = x.win),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        spots AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 400)) AS k FROM t, LATERAL (SELECT unnest(generate_series(0, length(h) // 2 - 200)) AS i) WHERE length(h) >= 400),
        again AS (SELECT k FROM spots GROUP BY k HAVING count(*) > 1),
        hits AS (SELECT doc_id, i FROM spots SEMI JOIN again USING (k)),
        opened AS (SELECT doc_id, i, i > lag(i) OVER w + 200 OR lag(i) OVER w IS NULL AS opens FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM opened),
        spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, g),
        edges AS (SELECT doc_id, b AS kept_from, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS kept_to FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(substring(h, 2 * kept_from + 1, 2 * (coalesce(kept_to, length(h) // 2) - kept_from)), '' ORDER BY kept_from) AS h FROM edges JOIN t USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        spots AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS k FROM t, LATERAL (SELECT unnest(generate_series(1, len(w) - 49)) AS i) WHERE len(w) >= 50),
        firsts AS (SELECT k, min(doc_id) AS first_id FROM spots GROUP BY k HAVING min(doc_id) <> max(doc_id)),
        hits AS (SELECT doc_id, i FROM spots JOIN firsts USING (k) WHERE doc_id > first_id),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM hits),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        sums AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(sums.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op9_tool_calls": """
        WITH opening AS (SELECT conv_id, min(turn) AS opened FROM conversations WHERE role = 'user' GROUP BY conv_id),
        calls AS (
            SELECT c.conv_id, turn, c.conv_id || ':' || turn AS call_id, ['search', 'summarise', 'translate'][length(text) % 3 + 1] AS name, text, length(text) AS size,
                   length(text) % 200 AS lim, CASE WHEN turn > opened THEN 1 ELSE 0 END AS level
            FROM conversations c JOIN opening USING (conv_id) WHERE role = 'user'),
        results AS (SELECT conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results, min({'turn': turn, 'said': text}) AS f FROM conversations WHERE role = 'assistant' GROUP BY 1),
        told AS (
            SELECT calls.*, coalesce(n_results, 0) AS n_results, f.turn AS result_turn, f.said AS said, concat_ws('; ',
                CASE WHEN (name = 'search' AND lim > 150) OR (name = 'summarise' AND lim < 20) THEN 'limit is out of bounds' END,
                CASE WHEN (name = 'search' AND size < 1) OR (name = 'summarise' AND size > 1000) OR (name = 'translate' AND (size < 1 OR size > 4000)) THEN 'text is out of bounds' END) AS errors
            FROM calls LEFT JOIN results USING (call_id))
        SELECT conv_id, turn, call_id, name, level, n_results, result_turn, errors = '' AS valid, errors,
               to_json({'arguments': {'limit': lim, 'text': text}, 'call_id': call_id, 'level': level, 'name': name, 'result': said, 'turn': turn})::VARCHAR AS message
        FROM told""",
    "op11_url_filters": r"""
        WITH rules(rule_host, rule_path, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        parts AS (
            SELECT page_id, row_number() OVER () AS r, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        best AS (
            SELECT r, arg_max({'rule': rule_host || rule_path, 'act': act}, length(rule_host || rule_path)) AS b
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.act, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE {CRC_SQL}
        docs AS (
            SELECT doc_id, lang, n_chars, concat(
                     CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                     CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
                   CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS own, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS forged,
                   CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail, coalesce({crc_sql("doc_id::VARCHAR")} % 7 = 0, false) AS tampered
            FROM documents, crc_table),
        leaves AS MATERIALIZED (
            SELECT doc_id, lang, sha256(head || own || tail) AS leaf, CASE WHEN tampered THEN sha256(head || forged || tail) ELSE sha256(head || own || tail) END AS claimed,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || own || tail)) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM docs),
        below(tree, level, pos, h, n) AS (
            SELECT tree, 0, pos, leaf, n FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM below WHERE n > 1 GROUP BY tree, level, pos // 2),
        subroots AS (SELECT tree AS pos, h, level, count(*) OVER () AS n FROM below WHERE n = 1),
        above(level, pos, h, n) AS (
            SELECT 0, pos, h, n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM above WHERE n > 1 GROUP BY level, pos // 2),
        folding(doc_id, leaf, tree, pos, steps, level, h, proof, in_top) AS (
            SELECT doc_id, leaf, tree, pos, (SELECT s.level FROM subroots s WHERE s.pos = l.tree), 0, claimed, '', false FROM leaves l
            UNION ALL
            SELECT f.doc_id, f.leaf, f.tree, CASE WHEN f.level = f.steps AND NOT f.in_top THEN f.tree ELSE f.pos // 2 END, f.steps,
                   CASE WHEN f.level = f.steps AND NOT f.in_top THEN 0 ELSE f.level + 1 END,
                   CASE WHEN f.level = f.steps AND NOT f.in_top THEN f.h WHEN f.pos % 2 = 1 THEN sha256(coalesce(b.h, a.h, '') || f.h) ELSE sha256(f.h || coalesce(b.h, a.h, '')) END,
                   f.proof || coalesce(b.h, a.h, ''), f.in_top OR f.level = f.steps
            FROM folding f LEFT JOIN below b ON NOT f.in_top AND f.level < f.steps AND b.tree = f.tree AND b.level = f.level AND b.pos = xor(f.pos, 1)
            LEFT JOIN above a ON f.in_top AND a.level = f.level AND a.pos = xor(f.pos, 1)
            WHERE NOT f.in_top OR f.level < (SELECT max(level) FROM above)),
        ended AS (SELECT * FROM folding WHERE in_top AND level = (SELECT max(level) FROM above))
        SELECT e.doc_id, e.leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
        FROM ended e JOIN subroots s ON s.pos = e.tree, (SELECT h FROM above WHERE n = 1) r""",
    "op13_prefix_trie": rf"""
        WITH {CRC_SQL}
        turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
        whole AS (
            SELECT c.conv_id, coalesce((SELECT list(said ORDER BY p) FROM turns t WHERE t.conv_id = c.base AND p < h), []) || coalesce((SELECT list(said ORDER BY p) FROM turns t WHERE t.conv_id = c.conv_id AND p >= h), []) AS s FROM convs c),
        prefixes AS (SELECT conv_id, len(s) AS size, d, s[1:d] AS node FROM whole, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
        nodes AS (
            SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE size = d) AS ends,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].text, '[^ 	-
]+')) END AS words FROM prefixes GROUP BY node, d),
        children AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
        under AS (
            SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved
            FROM (SELECT n_convs, words, n_children, node[1:k] AS top FROM (SELECT n.*, n_children FROM nodes n LEFT JOIN children USING (node)), LATERAL (SELECT unnest(range(0, d + 1)) AS k)) GROUP BY top)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1:n.d - 1] AND p.d = n.d - 1 LEFT JOIN children c ON c.node = n.node JOIN under u ON u.top = n.node""",
}
