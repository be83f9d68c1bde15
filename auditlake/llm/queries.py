"""Registered queries: each applies one operator to its whole table and derives the columns to return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.alignment import align_documents
from auditlake.llm.embeddings import near_vectors
from auditlake.llm.filter_audit import audit_filters
from auditlake.llm.language import held_out, identify_languages
from auditlake.llm.line_dedup import remove_boilerplate
from auditlake.llm.packing import pack_documents
from auditlake.llm.quality import judge_quality
from auditlake.llm.separators import document_tokens
from auditlake.llm.sharding import shard_documents
from auditlake.llm.shingle_join import link_documents
from auditlake.llm.suffix_dedup import remove_repeats
from auditlake.llm.tree_bpe import encode_documents
from auditlake.llm.warc import archive_pages

BUILDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        BUILDS[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


@query()
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), f AS (
        SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archive_pages(table(spark, folder, "pages"))
    own = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(own, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query(
    r"""
    WITH w AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), g AS (
        SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)
    ), r AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
            SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2
        ) GROUP BY doc_id
    ), f AS (
        SELECT w.doc_id, lang, source, len(words) AS n_words,
            coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines
        FROM w LEFT JOIN r USING (doc_id)
    ), b AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
    ), v AS (
        SELECT doc_id, lang, source, base_failed, unnest([
            {'rate': 'word_length', 'v': CASE WHEN n_words > 0 THEN word_chars * 4096 // n_words ELSE 0 END, 'least': 410},
            {'rate': 'symbols', 'v': CASE WHEN n_words > 0 THEN n_symbols * 4096 // n_words ELSE 0 END, 'least': 66},
            {'rate': 'dup_lines', 'v': CASE WHEN n_lines > 0 THEN n_dup_lines * 4096 // n_lines ELSE 0 END, 'least': 164},
            {'rate': 'repeats', 'v': CASE WHEN n_words > 0 THEN n_repeat_words * 4096 // n_words ELSE 0 END, 'least': 131}
        ], recursive := true) FROM b
    ), s AS (
        SELECT lang, source, rate, least, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS low FROM v WHERE NOT base_failed
    ), l AS (
        SELECT 0 AS level, * FROM s UNION ALL SELECT 1, lang, '', rate, least, low FROM s UNION ALL SELECT 2, '', '', rate, least, low FROM s
    ), q AS (
        SELECT level, lang, source, rate, least, count(*) AS n, quantile_disc(low, 0.25) AS q1, quantile_disc(low, 0.5) AS q2, quantile_disc(low, 0.75) AS q3
        FROM l GROUP BY ALL
    ), h AS (
        SELECT level, lang, source, rate, n, q2 - 15 * greatest(least(q2 - q1, q3 - q2), least) AS low, q2 + 15 * greatest(least(q2 - q1, q3 - q2), least) AS high FROM q
    ), k AS (
        SELECT doc_id, bool_and(v.v <= x.high AND (v.rate <> 'word_length' OR v.v >= x.low)) AS ok
        FROM v LEFT JOIN h h0 ON h0.level = 0 AND h0.lang = v.lang AND h0.source = v.source AND h0.rate = v.rate
        LEFT JOIN h h1 ON h1.level = 1 AND h1.lang = v.lang AND h1.rate = v.rate
        LEFT JOIN h h2 ON h2.level = 2 AND h2.rate = v.rate,
        LATERAL (SELECT CASE WHEN h0.n >= 100 THEN h0.high WHEN h1.n >= 100 THEN h1.high ELSE h2.high END AS high,
            CASE WHEN h0.n >= 100 THEN h0.low WHEN h1.n >= 100 THEN h1.low ELSE h2.low END AS low) x
        GROUP BY doc_id
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND ok AS kept
    FROM b JOIN k USING (doc_id)
    """
)
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(table(spark, folder, "documents"))


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify_languages(docs, F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"))
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score")


@query(
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), r AS (
        SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
    ), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
    """
)
def op9_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query(
    r"""
    WITH d AS (
        SELECT doc_id, text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents
    ), t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
    s AS (
        SELECT bare FROM t WHERE len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) >= 3 GROUP BY bare HAVING count(DISTINCT site) >= 5
    ), m AS (
        SELECT t.*, s.bare IS NOT NULL AS gone FROM t LEFT JOIN s ON t.bare = s.bare
    ), g AS (
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone, 2 * sum(CASE WHEN gone THEN length(line) ELSE 0 END) > sum(length(line)) AS copy,
            array_to_string(list(line ORDER BY pos) FILTER (WHERE NOT gone), chr(10)) AS rest
        FROM m GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_lines IS NULL OR copy THEN 0 ELSE n_gone END AS n_removed,
        CASE WHEN copy THEN text WHEN n_lines IS NOT NULL THEN coalesce(rest, '') END AS text
    FROM documents LEFT JOIN g USING (doc_id)
    """
)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_boilerplate(table(spark, folder, "documents")).select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "_cut.*")


@query()
def op5_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    return document_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end_id=50256)


@query(
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 3], ' ') END AS shingle
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), l AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
    ), r AS (
        SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) ON node = doc_id
    """
)
def op6_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return link_documents(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    r"""
    WITH w AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), m AS (
        SELECT w.doc_id, part, [
            len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
            coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails, coalesce(good, false) AS good, coalesce(bad, false) AS toxic
        FROM w LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id) l ON l.doc_id = w.doc_id
    ), g AS (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
    l(c, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)), o AS (
        SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS idx FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
    ), s AS (
        SELECT filter_order, step, idx[step] AS own, idx[1 : step - 1] AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)
    ), x AS (
        SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failed, len(list_filter(before, lambda f: fails[f])) > 0 AS gone, len(list_filter(fails, lambda f: f)) = 1 AS single
        FROM g, s
    ), c AS (
        SELECT part, filter_order, step, own,
            coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (WHERE failed AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed AND single), 0)::BIGINT AS unique_fails,
            coalesce(sum(n) FILTER (WHERE failed AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE failed AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
        FROM x GROUP BY ALL
    )
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM c
    """
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
    c AS (
        SELECT doc_id, base, substr(h, (2 * base + 1)::BIGINT, 4198) AS piece
        FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 2000)) AS base FROM d)
    ), w AS (
        SELECT doc_id, base + i AS start, hash(substr(piece, (2 * i + 1)::BIGINT, 200)) AS k, substr(piece, (2 * i + 1)::BIGINT, 200) AS s
        FROM (SELECT doc_id, base, piece, unnest(range(0, least(length(piece) // 2 - 99, 2000))) AS i FROM c)
    ), m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
    f AS (
        SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS n FROM w SEMI JOIN m USING (k)) WHERE n > 1
    ), r AS (
        SELECT doc_id, start, sum(CASE WHEN start <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS run
        FROM (SELECT *, lag(start, 1, -1000) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM f)
    ), g AS (SELECT doc_id, run, min(start) AS begin, max(start) + 100 AS stop FROM r GROUP BY doc_id, run),
    e AS (
        SELECT doc_id, begin, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY begin) AS kept_from FROM g
    ), k AS (
        SELECT e.doc_id, count(*) AS n_spans, sum(stop - begin)::BIGINT AS n_removed,
            string_agg(substr(h, 2 * kept_from + 1, 2 * (begin - kept_from)), '' ORDER BY begin) || substr(any_value(h), 2 * max(stop) + 1) AS kept
        FROM e JOIN d USING (doc_id) GROUP BY e.doc_id
    )
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """
)
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    return aligned.withColumnRenamed("groups", "groups_sha256")
