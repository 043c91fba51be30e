"""Registered queries of the text operators, each over its whole table, and their DuckDB SQL where there is any."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import audit, chat, contamination, exact, jaccard, lines, packing, quality, secrets, suffixes, tokens, toxicity, vectors
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark, sf_dir):
    """Token counts of every whole document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op2_exact_dedup(spark, sf_dir):
    """Exact dedup of all documents: those up to the median id are the snapshot, the others arrive."""
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    """Secrets in every whole document: fixed kinds, and tokens that pass the randomness battery."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    """Toxicity scores of every whole document; labels outside the held-out fold teach."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark, sf_dir):
    """Components of all documents linked by 5-word shingles at Jaccard similarity 0.75 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    """Benchmark windows in every whole document."""
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_suffix_dedup(spark, sf_dir):
    """Bytes of all documents that no repeated 400-byte string covers."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_best_fit_packing(spark, sf_dir):
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality(spark, sf_dir):
    """Quality scores of every whole document; labels outside the held-out fold teach."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark, sf_dir):
    """Lines of all documents: how many each has and loses, and the SHA-256 of what is left (a null text counts as empty)."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_filter_audit(spark, sf_dir):
    """All orders of five filters over all documents, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation that speaks the template's own language.
CONTROL = "\\### Assistant: </turn> ok"


def op12_chat_format(spark, sf_dir):
    """All conversations as logs, folded and formatted; the columns are read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(chat.log_of(rows.union(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))


def op13_vector_codes(spark, sf_dir):
    """Product codes of all embeddings, with the codebooks fitted to all of them."""
    codes, books = vectors.compress(table(spark, sf_dir, "embeddings"))
    return codes.drop("label").withColumn("codebooks_sha256", F.lit(vectors.codebooks_sha256(books)))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_exact_dedup, op3_secret_scan, op4_toxicity, op5_ngram_jaccard, op6_decontamination,
    op7_suffix_dedup, op8_best_fit_packing, op9_quality, op10_line_dedup,
    op11_filter_audit, op12_chat_format, op13_vector_codes)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS6 = r"(?:[0-9a-z]|[^\x00-\x7F])+"
WORDS10 = r"[^\x20\x09-\x0D]+"



def _rounds(n: int) -> str:
    """CTEs of ``n`` rounds and the last assignment; books0 are the first codebooks, a{n} the last codes."""
    out = []
    for k in range(n + 1):
        out.append(f"""a{k} AS (SELECT vec_id, part, min((d, entry)) AS best FROM (
            SELECT vec_id, part, entry, CAST(list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))) AS BIGINT) AS d
            FROM pts JOIN books{k} USING (part)) GROUP BY vec_id, part)""")
        if k < n:
            out.append(f"""sums{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
            SELECT part, best[2] AS entry, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM pts JOIN a{k} USING (vec_id, part)) GROUP BY part, entry, i),
        moved{k} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM sums{k} GROUP BY part, entry),
        books{k + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN moved{k} m USING (part, entry))""")
    return ",\n        ".join(out)


SQL = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256, {LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (norm)""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS6}') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORDS6}') AS w FROM benchmark),
        win AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
                    lambda p: list_slice(w, p, p + least(len(w), 10) - 1))) AS g FROM i WHERE len(w) > 0),
        lens AS (SELECT DISTINCT k FROM win),
        pos AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d JOIN lens ON len(w) >= k),
        hit AS (SELECT DISTINCT doc_id, p, pos.k, item_id FROM pos JOIN win ON win.k = pos.k AND list_slice(w, p, p + pos.k - 1) = g),
        cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
        o AS (SELECT doc_id, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS10}') AS w FROM l),
        t AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min((doc_id, i)) AS f FROM o WHERE len(w) > 0 GROUP BY 1),
        v AS (SELECT k, f, unnest(range(1, len(w) + 1)) AS p, unnest(list_transform(range(1, len(w) + 1),
                  lambda p: array_to_string(list_slice(w, 1, p - 1) || list_slice(w, p + 1, len(w)), ' '))) AS u, len(w) AS n
              FROM t WHERE len(w) >= 8),
        swapped AS (SELECT u, p, min(f) AS f FROM v GROUP BY u, p),
        near AS (SELECT k, swapped.f FROM v JOIN swapped USING (u, p)
                 UNION ALL SELECT v.k, t.f FROM v JOIN t ON t.k = v.u WHERE v.n > 8
                 UNION ALL SELECT t.k, v.f FROM v JOIN t ON t.k = v.u WHERE v.n > 8
                 UNION ALL SELECT k, f FROM t),
        stays AS (SELECT k, min(f) AS f FROM near GROUP BY k),
        m AS (SELECT o.doc_id, o.i, line, len(w) > 0 AND (o.doc_id, o.i) <> f AS gone
              FROM o LEFT JOIN stays ON array_to_string(w, ' ') = k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op11_filter_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '{WORDS10}') AS ws FROM documents),
        firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
        lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
                FROM labels GROUP BY doc_id),
        failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                          CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
                          || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                          || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
                   FROM d JOIN firsts USING (t) LEFT JOIN lab USING (doc_id)),
        counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders_ AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
                    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        placed AS (SELECT part, fails, n, good, toxic, o, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: strpos(o, x))), 9) AS gone
               FROM counted CROSS JOIN orders_ WHERE fails <> ''
               UNION ALL SELECT part, fails, n, good, toxic, o, 9 FROM counted CROSS JOIN orders_ WHERE fails = ''),
        steps AS (SELECT part, o, step, substr(o, step, 1) AS x, sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed,
                         sum(n) FILTER (WHERE gone < step AND contains(fails, substr(o, step, 1))) AS redundant,
                         sum(n) FILTER (WHERE fails = substr(o, step, 1)) AS unique_fails,
                         sum(good) FILTER (WHERE gone = step) AS good_lost, sum(toxic) FILTER (WHERE gone = step) AS toxic_lost
                  FROM (SELECT *, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM placed) GROUP BY ALL)
        SELECT part, o AS filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM steps""",
    "op12_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
        w AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') AS body,
                     replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ':', '\c') AS head FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM w GROUP BY conv_id""",
    "op13_vector_codes": f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                      FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        pts AS (SELECT vec_id, part, list_slice(v, part * len(v) // 16 + 1, (part + 1) * len(v) // 16) AS p FROM kept, range(16) AS t(part)),
        books0 AS (SELECT part, entry, p AS c FROM pts JOIN (
            SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
        {_rounds(2)},
        codes AS (SELECT vec_id, string_agg(lower(printf('%02x', best[2])), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
                  FROM a2 GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM codes JOIN kept USING (vec_id), digest""",
}
