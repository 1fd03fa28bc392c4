"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import audit, linefreq, mixing, ordermin, packing, pieces, pseudolm, quality, secrets, simhash, toxicity, vectorcodes, warc
from loomdex.llm.common import forget, shared_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).drop("text")


def op3_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudolm.pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(found, lambda x: x["kind"].isin(*secrets.BASE))
    return docs.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.rendered(base), 256).alias("base_sha256"),
        secrets.rendered(found).alias("spans"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark)
    warc.write_warc(warc.records(table(spark, sf_dir, "pages")), archives)
    read = warc.payloads(warc.read_warc(spark, archives))
    forget(spark, archives)  # its pieces are stored
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as long)")
    is_response = F.col("type") == "response"
    return read.select(
        page("id").alias("page_id"),
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(~is_response, page("refers_to")).alias("refers_to"),
    )


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = ordermin.with_next(ordermin.add_sketch(docs, "text", "sketch"), "doc_id", ["text", "sketch"])
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("n_chars div 2").cast("int"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars) - cut), substring(next_text, 1, cut))")).drop("next_text", "cut")
    docs = ordermin.add_sketch(docs.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        ordermin.as_text(F.col("sketch")).alias("fingerprint"),
        ordermin.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        ordermin.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        ordermin.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip", keep_text=False)
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linefreq.line_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_step_groups(packing.pack(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
    return found.select("vec_id", vectorcodes.as_hex(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece, "op3_pseudo_likelihood": op3_pseudo_likelihood, "op2_toxicity": op2_toxicity, "op1_quality": op1_quality, "op7_order_minhash": op7_order_minhash, "op9_line_rules": op9_line_rules, "op6_warc": op6_warc, "op4_simhash": op4_simhash, "op5_secret_scan": op5_secret_scan, "op10_mix_sources": op10_mix_sources, "op11_pack": op11_pack, "op12_vector_codes": op12_vector_codes, "op13_filter_audit": op13_filter_audit}
#: WARC: what the archives must give back is a property of the pages alone.
_WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
    last AS (SELECT html, max(page_id) AS first FROM p WHERE n >= {warc.MIN_REVISIT} GROUP BY html)
    SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first THEN first END AS refers_to FROM p LEFT JOIN last ON p.html = last.html"""

#: Line rules: lines themselves stand for their hashes, texts for their digests.
_LINES = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    win AS (SELECT r, i, array_to_string(w[i:i + {linefreq.WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - {linefreq.WINDOW - 1})) AS i FROM w)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + {linefreq.WINDOW - 1})) AS p FROM twice) GROUP BY r),
    base AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered ON w.r = covered.r),
    ln AS (SELECT r, doc_id, source, text, trim(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS h, length(x) AS n FROM (SELECT r, doc_id, source, text, unnest(l) AS x FROM w)),
    named AS (SELECT * FROM ln WHERE h <> ''),
    held AS (SELECT source, h, count(*) AS n FROM (SELECT DISTINCT source, h, doc_id, text FROM named) GROUP BY source, h),
    above AS (SELECT source, h FROM held WHERE n > {linefreq.MAX_DOCS}),
    lost AS (SELECT r, sum(n) AS total, coalesce(sum(n) FILTER (above.h IS NOT NULL), 0) AS gone FROM named LEFT JOIN above ON named.source IS NOT DISTINCT FROM above.source AND named.h = above.h GROUP BY r),
    judged AS (SELECT base.*, n_words < {linefreq.MIN_WORDS} OR 100 * n_repeat_words > {linefreq.MAX_REPEAT} * n_words AS base_failed, coalesce(gone, 0) AS gone, coalesce(total, 0) AS total FROM base LEFT JOIN lost ON base.r = lost.r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (gone > 0 AND total - gone < {linefreq.MIN_LEFT}::DOUBLE * total) AS kept, gone::BIGINT AS removed_chars FROM judged"""



def _codes_sql() -> str:
    """Vector codes: every distance to every entry, twice for the codebooks and once for the codes."""
    n, size = vectorcodes.PARTS, vectorcodes.ENTRIES

    def assigned(k: int) -> str:
        # distances are exact in doubles, and the index is the last digits of what is least
        far = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
        return f"a{k} AS (SELECT r, vec_id, label, x.p, x, min(({far})::BIGINT * {size} + e) AS m FROM x JOIN b{k} ON x.p = b{k}.p GROUP BY r, vec_id, label, x.p, x)"

    def learned(k: int) -> str:
        sums = f"SELECT p, m % {size} AS e, i, floor(sum(y) / count(*)) AS y FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, m % {size}, i"
        return f"b{k + 1} AS (SELECT b.p, b.e, coalesce(t.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM ({sums}) GROUP BY p, e) t ON b.p = t.p AND b.e = t.e)"

    steps = ", ".join(x for k in range(vectorcodes.ROUNDS) for x in (assigned(k), learned(k)))
    part = f"v[p * len(v) // {n} + 1:(p + 1) * len(v) // {n}]"
    return f"""
        WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({vectorcodes.SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT r, vec_id, label, p, {part} AS x FROM k, range({n}) t(p)),
        f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM (SELECT * FROM k ORDER BY vec_id LIMIT {size})),
        b0 AS (SELECT p, e, {part} AS c FROM f, range({n}) t(p)), {steps}, {assigned(vectorcodes.ROUNDS)},
        h AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b{vectorcodes.ROUNDS})),
        o AS (SELECT r, vec_id, label, string_agg(printf('%02x', m % {size}), '' ORDER BY p) AS code, sum(m // {size})::BIGINT AS error FROM a{vectorcodes.ROUNDS} GROUP BY r, vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


#: The audit: every order against every cell.
_AUDIT = """
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
    o AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
    l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
        + 4 * (100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 5 * length(w.t))::INT + 8 * regexp_matches(w.t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
        FROM w JOIN o ON w.t = o.t LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
    f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, b)),
    p AS (SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
    s AS (SELECT filter_order, step::INT AS step, b, sum(b) OVER (PARTITION BY filter_order ORDER BY step)::INT - b AS before FROM p, range(1, 6) r(step) JOIN f ON letter = filter_order[step]),
    r AS (SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & b > 0 AND mask & before = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & b > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & b > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & b > 0 AND mask & before = 0), 0) AS toxic_lost
        FROM s, c GROUP BY part, filter_order, step, b)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r"""

#: The others need hashes, trained models or parsers that SQL lacks; tests/llm holds them against plain loops, the sentencepiece library or held-out labels.
ORACLES: dict[str, str] = {"op6_warc": _WARC, "op9_line_rules": _LINES, "op12_vector_codes": _codes_sql(), "op13_filter_audit": _AUDIT}
