"""The thin queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, decontaminate, licenses, linededup, packing, pieces, pii, quality, runs, simhash, store, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_digest(packing.pack(_table(spark, sf_dir, "documents")))


def pack_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "boundary")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, and how much was deleted as an earlier one's block."""
    done = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc.doc_id", "n_pieces", "n_removed", "removed_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of personal data in every document."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *map(pii.count_of, pii.PATTERNS), F.sha2(pii.span_list("base"), 256).alias("base_sha256"), pii.span_list("spans").alias("spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, written to archives and read back."""
    archives = warc.write_archives(warc.plan(_table(spark, sf_dir, "pages"), min_bytes=0))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    done = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents")))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document with planted repeats: how many, the longest, digests of all and of the collapsed text."""
    done = runs.periodic_runs(runs.planted(_table(spark, sf_dir, "documents")))
    top = runs.longest(F.col("runs"))
    figures = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(runs.run_list(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.less")
    return figures.select("doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"), F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and which items these are."""
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = align.aligned(_table(spark, sf_dir, "documents"), lists=False)
    text = F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256")
    done = store.materialise(whole.select("rid", "doc_id", count("n_a"), count("n_b"), count("n_groups"), text, "pairs"), "aligned")
    figures = done.drop("pairs")
    return figures.join(align.scored(done), "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", count("n_links"), count("n_best"), count("count_sum"), "groups_sha256")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_line_dedup, op4_license_scan, op5_html_extraction, op6_pii, op7_warc, op8_quality_rules, op9_nearest, op10_sentencepiece, op11_periodic_runs, op12_decontamination, op13_alignment)}


# Base32 of a SHA-1: eight groups of 20 bits, each four letters of the alphabet.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END) % 32 + 1 AS INT), 1)), '')"


def _license_sql() -> str:
    known = ", ".join(f"('{name}', [" + ", ".join(f"'{g}'" for g in licenses.template_bigrams(t)) + "])" for name, t in licenses.TEMPLATES)
    cut = lambda x: f"string_split(regexp_replace({x}, '([.!?:;])[ \\t]', '\\1' || chr(10), 'g'), chr(10))"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
        p AS (SELECT rid, t, list_transform(string_split_regex(t, '\\n[ \\t\\r]*\\n'), lambda x: replace(x, chr(10), ' ')) AS ps FROM d),
        u AS (SELECT rid, unnest(list_distinct(list_concat(string_split(t, chr(10)), {cut('t')}, ps, flatten(list_transform(ps, lambda x: {cut('x')})), [t]))) AS u FROM p),
        w AS (SELECT rid, u, regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+(?:[.][\\p{{L}}\\p{{N}}]+)*') AS w FROM u),
        g AS (SELECT rid, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
        k AS (SELECT * FROM (VALUES {known}) k(name, b)),
        s AS (SELECT rid, u, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g JOIN k ON len(g) * 3 >= len(b) * 2 AND len(g) * 2 <= len(b) * 3),
        m AS (SELECT rid, name, dice FROM s WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid, u ORDER BY dice DESC, name) = 1)
        SELECT doc_id, count(name) AS n_units, list(name ORDER BY dice DESC, name)[1] AS licence, round(max(dice), 6) AS score, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licences FROM d LEFT JOIN m USING (rid) GROUP BY rid, doc_id"""


# Shortest runs of pieces with 20 words or more from each piece, and up to each piece; what an earlier document has goes.
_DEDUP_SQL = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text FROM documents),
    ps AS (SELECT rid, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(1)), '([.!?]) ', '\\1' || chr(1) || ' ', 'g'), chr(1)) AS ps FROM d WHERE text IS NOT NULL),
    ns AS (SELECT rid, ps, list_transform(ps, lambda p: lower(trim(regexp_replace(p, '\\s+', ' ', 'g')))) AS ns FROM ps),
    pc AS (SELECT rid, unnest(ps) AS p, unnest(ns) AS n, generate_subscripts(ps, 1) AS k FROM ns),
    sz AS (SELECT *, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words FROM pc),
    cu AS (SELECT *, sum(words) OVER (PARTITION BY rid ORDER BY k) AS hi FROM sz),
    lo AS (SELECT *, hi - words AS lo FROM cu),
    ru AS (SELECT a.rid, a.k AS i, b.k AS j FROM lo a ASOF JOIN (SELECT * FROM lo WHERE words > 0) b ON a.rid = b.rid AND a.lo + 20 <= b.hi
        UNION SELECT b.rid, a.k, b.k FROM lo b ASOF JOIN (SELECT * FROM lo WHERE words > 0) a ON a.rid = b.rid AND b.hi - 20 >= a.lo),
    ke AS (SELECT rid, i, j, min(rid) OVER (PARTITION BY array_to_string(ns[i:j], chr(2))) AS first FROM ru JOIN ns USING (rid)),
    gone AS (SELECT DISTINCT rid, unnest(range(i, j + 1)) AS k FROM ke WHERE first < rid),
    left_ AS (SELECT rid, count(*) AS n_pieces, count(g.k) AS n_removed, coalesce(sum(words) FILTER (g.k IS NOT NULL), 0) AS removed_words, string_agg(p, '' ORDER BY k) FILTER (g.k IS NULL) AS stay FROM sz LEFT JOIN gone g USING (rid, k) GROUP BY rid)
    SELECT doc_id, coalesce(n_pieces, 0)::BIGINT AS n_pieces, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_words, 0)::BIGINT AS removed_words, sha256(coalesce(stay, '')) AS text_sha256 FROM d LEFT JOIN left_ USING (rid)"""

# White space that separates words in normalised lines.
_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"
_QUALITY_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    win AS (SELECT rid, k, array_to_string(ws[k:k + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS k FROM w)),
    twice AS (SELECT rid, k FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    rep AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest(range(k, k + 8)) AS k FROM twice) GROUP BY rid),
    li AS (SELECT rid, source, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
    nl AS (SELECT rid, source, l, k, trim(regexp_replace(lower(l), '{_BLANK}', ' ', 'g')) AS n, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words FROM li WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
    wh AS (SELECT rid, string_agg(n, chr(10) ORDER BY k) AS whole, count(*) - count(DISTINCT l) AS n_dup_lines FROM nl GROUP BY rid),
    often AS (SELECT source, n FROM nl JOIN wh USING (rid) GROUP BY source, n HAVING count(DISTINCT whole) > 50),
    gone AS (SELECT rid, sum(words) AS removed FROM nl JOIN often o ON o.n = nl.n AND o.source IS NOT DISTINCT FROM nl.source GROUP BY rid),
    f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words FROM w LEFT JOIN wh USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND n_words - removed_words >= 0.2::DOUBLE * n_words AS kept FROM b"""


# CRC-32 of the id's digits, bit by bit; then all equal pairs a lag apart, their islands, and what islands leave.
_RUNS_SQL = """WITH h AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM documents),
    g AS (SELECT rid, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 % greatest(len(ws), 1) AS a, 3 + h // 10 % 8 AS k FROM h),
    p AS (SELECT *, 1 + (n - a) // k AS p FROM g),
    d AS (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE ws END AS ws FROM p),
    w AS (SELECT rid, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM d),
    m AS (SELECT x.rid, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    c AS (SELECT rid, q FROM m GROUP BY rid, q HAVING count(*) >= greatest(6 - q, 3 * q)),
    s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m SEMI JOIN c USING (rid, q)),
    l AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, island HAVING count(*) >= greatest(6 - q, 3 * q)),
    r AS (SELECT rid, start, length, min(q) AS period FROM l GROUP BY rid, start, length),
    f AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS t FROM r GROUP BY rid),
    gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
    left_ AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, t.s::BIGINT AS start, t.l::BIGINT AS length, t.p::BIGINT AS period, (1000 * t.l // t.p)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN f USING (rid) LEFT JOIN left_ USING (rid)"""

_LEAKS_SQL = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
    s AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
    w AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') AS s FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM s))),
    o AS (SELECT rid, k, n, item_id FROM w JOIN s USING (n, s)),
    hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS k FROM o) GROUP BY rid),
    its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM o) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)""".replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def oracle_sql() -> dict[str, str]:
    """Operators that need neither XXH64, a tokenizer nor HTML parsing."""
    return {
        "op3_line_dedup": _DEDUP_SQL,
        "op8_quality_rules": _QUALITY_SQL,
        "op11_periodic_runs": _RUNS_SQL,
        "op12_decontamination": _LEAKS_SQL,
        "op4_license_scan": _license_sql(),
        "op7_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
            t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
            SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t""",
    }
