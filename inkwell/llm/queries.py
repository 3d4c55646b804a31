"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup, exact_topk, jaccard_join, language_id, lexical_search, license_scan, packing, pii, quality, quotation_linking, sentencepiece_codec, spelling_variants, url_filter
from inkwell.session import materialize

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(exact_topk.integers(table(spark, sf_dir, "embeddings")), "vectors")
    return exact_topk.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_linking.conversations(table(spark, sf_dir, "conversations"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs.where(~held_out()), labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECE_BPE, digests=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_language_id, op3_quotation_linking, op4_jaccard_join, op5_quality, op6_best_fit_packing, op7_license_scan, op8_sentencepiece, op9_exact_dedup, op10_pii, op11_spelling_variants, op12_lexical_search, op13_url_filter)}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"



def sql_host(url: str) -> str:
    return LOWER.format(f"regexp_extract(coalesce({url}, ''), '{url_filter.URL}', 1)")


def sql_path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '{url_filter.URL}', 2)"


def sql_address(url: str) -> str:
    parts = f"string_split(regexp_extract(coalesce({url}, ''), '{url_filter.QUERY}', 1), '&')"
    asked = f"array_to_string(list_sort(list_filter({parts}, lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))), '&')"
    bare = rf"regexp_replace(regexp_replace({sql_host(url)}, ':(80|443)\z', ''), '^www\.', '')"
    return rf"CASE WHEN {sql_host(url)} = '' THEN '' ELSE {bare} || regexp_replace({sql_path(url)}, '/+\z', '') || CASE WHEN {asked} = '' THEN '' ELSE '?' || {asked} END END"


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ORACLES = {
    "op1_exact_topk": """
        WITH t AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.v, c.v), 0) AS BIGINT) AS score
            FROM t q JOIN t c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
        ),
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
        ),
        few AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        summed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
                string_split(concat(doc_id, ':', run), ''),
                lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END))),
                lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS h
            FROM few, crc
        ),
        w AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
                sum(n)::BIGINT AS n
            FROM summed GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5
        ),
        d AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
            FROM (SELECT *, unnest(range(length(word))) AS i FROM w)
        ),
        near AS (
            SELECT a.word, b.word AS x, b.n AS xn FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
            UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
            UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word
        ),
        best AS (
            SELECT word, count(*) AS n_near, max(xn) AS top, arg_min(x, (-xn, encode(x))) AS x FROM near GROUP BY word
        ),
        f AS (
            SELECT w.word, CASE WHEN top >= 5 * n THEN x END AS form, n, coalesce(n_near, 0) AS n_near,
                CASE WHEN top >= 5 * n THEN top END AS form_n
            FROM w LEFT JOIN best USING (word)
        ),
        up AS (
            SELECT word, form AS at FROM f WHERE form IS NOT NULL
            UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.at = f.word WHERE f.form IS NOT NULL
        ),
        ends AS (SELECT up.word, up.at FROM up JOIN f ON up.at = f.word WHERE f.form IS NULL)
        SELECT word, form, coalesce(ends.at, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
    """,
    "op12_lexical_search": f"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER.format("text")}, '{TERM}') AS ts FROM documents
        ),
        s AS (SELECT count(*) AS nd, coalesce(sum(len(ts)), 0)::BIGINT AS l FROM d WHERE len(ts) > 0),
        p AS (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS term FROM d WHERE len(ts) > 0),
        tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nd),
        i AS (
            SELECT r, item_id, unnest(list_distinct(regexp_extract_all({LOWER.format("text")}, '{TERM}'))) AS term
            FROM (SELECT row_number() OVER () AS r, * FROM benchmark)
        ),
        g AS (
            SELECT r, item_id, k, doc_id,
                sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))))::BIGINT AS score
            FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY r, item_id, k, doc_id
        ),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
            FROM g WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """,
    "op13_url_filter": rf"""
        WITH RECURSIVE rules(verdict, h, p) AS (VALUES {", ".join(map(str, url_filter.RULES))}),
        pg AS (
            SELECT page_id, url, regexp_replace(html, '{url_filter.COMMENT}', '', 'g') AS plain,
                {sql_host("url")} AS host, {sql_path("url")} AS path, {sql_address("url")} AS address
            FROM pages
        ),
        said AS (
            SELECT url, host, path, address, replace(unnest([
                regexp_extract(regexp_extract(plain, {sql_text(url_filter.CANONICAL_TAG)}, 1), {sql_text(url_filter.HREF)}, 1),
                regexp_extract(regexp_extract(plain, {sql_text(url_filter.REFRESH_TAG)}, 1), {sql_text(url_filter.REFRESH_URL)}, 1)
            ]), '&amp;', '&') AS t FROM pg
        ),
        whole AS (
            SELECT address, CASE
                WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
                WHEN t LIKE '//%' THEN 'http:' || t
                WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR t LIKE '#%' OR t = '' OR host = '' THEN NULL
                WHEN t LIKE '/%' THEN 'http://' || host || t
                WHEN t LIKE '?%' THEN 'http://' || host || path || t
                ELSE 'http://' || host || coalesce(nullif(regexp_replace(path, '[^/]*\z', ''), ''), '/') || regexp_replace(t, '^\./', '') END AS url
            FROM said
        ),
        links AS (SELECT address, url, {sql_address("url")} AS other FROM whole WHERE url IS NOT NULL),
        e AS (SELECT address AS a, other AS b FROM links WHERE other <> '' AND address <> '' UNION SELECT other, address FROM links WHERE other <> '' AND address <> ''),
        places AS (
            SELECT host, path, address FROM pg
            UNION SELECT {sql_host("url")}, {sql_path("url")}, other FROM links
        ),
        fit AS (
            SELECT host, path, address, h || p AS rule, verdict, row_number() OVER (
                PARTITION BY host, path, address ORDER BY length(h || p) DESC, length(h) DESC, verdict) AS n
            FROM places JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p)
        ),
        best AS (SELECT * FROM fit WHERE n = 1),
        alias(address, other) AS (
            SELECT DISTINCT address, address FROM places WHERE address <> ''
            UNION SELECT alias.address, e.b FROM alias JOIN e ON alias.other = e.a
        ),
        bad AS (
            SELECT alias.address FROM alias JOIN best ON alias.other = best.address
            GROUP BY alias.address HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
        )
        SELECT page_id, pg.host, pg.path, rule, coalesce(verdict, CASE WHEN bad.address IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
            CASE WHEN rule IS NOT NULL THEN 'rule' WHEN bad.address IS NULL THEN 'none' ELSE 'alias' END AS via
        FROM pg LEFT JOIN best ON best.host = pg.host AND best.path = pg.path AND best.address = pg.address LEFT JOIN bad ON bad.address = pg.address
    """,
}
