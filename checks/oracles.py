"""DuckDB SQL giving the same rows as the queries of the same name."""

from __future__ import annotations

from inkwell.functions.stopwords import default_stop_words

SPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _quoted(words) -> str:
    return "[" + ", ".join("'" + word.replace("'", "''") + "'" for word in words) + "]"


STOP = f"stop_words AS MATERIALIZED (SELECT {_quoted(default_stop_words())} AS stops)"
LETTER_TOKENS = (
    r"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'), "
    r"lambda t: length(t) >= 2 AND regexp_matches(t, '^[\p{{L}}_]+$'){more})"
)
NOT_STOP = " AND NOT list_contains(stops, t)"


def _tokens(source: str = "documents", key: str = "doc_id", stop: bool = False) -> str:
    """CTE ``tok(doc_id, tokens)``."""
    tokens = LETTER_TOKENS.format(text="text", more=NOT_STOP if stop else "")
    return f"tok AS MATERIALIZED (SELECT {key} AS doc_id, {tokens} AS tokens FROM {source}{', stop_words' if stop else ''})"


TOKEN_ROWS = """
token_rows AS (
  SELECT doc_id, unnest(range(len(tokens)))::INTEGER AS pos, unnest(tokens) AS token FROM tok
)"""

TERM_COUNTS = """
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""

SENTENCES = rf"""
parts AS (
  SELECT doc_id, regexp_split_to_array(text, '[?!;？！。；…\n]') AS parts FROM documents
),
trimmed AS (
  SELECT doc_id, unnest(range(len(parts))) AS p,
         regexp_replace(unnest(parts), '\A{SPACE}+|{SPACE}+\z', '', 'g') AS sentence
  FROM parts
),
sentence_rows AS MATERIALIZED (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS idx, sentence
  FROM trimmed WHERE sentence <> ''
)"""

WORD_LISTS = rf"""
{STOP},
{SENTENCES.strip()},
words_no_filter AS (
  SELECT doc_id, idx, sentence,
         regexp_extract_all(lower(sentence), '[.0-9]+|[\p{{L}}_][\p{{L}}\p{{N}}_]*') AS words
  FROM sentence_rows
),
words_no_stop_words AS MATERIALIZED (
  SELECT doc_id, idx, sentence, list_filter(words, lambda t: NOT list_contains(stops, t)) AS words
  FROM words_no_filter, stop_words
),
words_all_filters AS MATERIALIZED (
  SELECT doc_id, idx, sentence, list_filter(words, lambda t: NOT regexp_matches(t, '^[.0-9]')) AS words
  FROM words_no_stop_words
)"""

SHARED = """
sentence_words AS (
  SELECT DISTINCT doc_id, idx, len(words) AS n, word
  FROM (SELECT doc_id, idx, words, unnest(words) AS word FROM words_all_filters)
),
shared AS (
  SELECT a.doc_id, a.idx AS src, b.idx AS dst, a.n AS n_a, b.n AS n_b, count(*) AS shared
  FROM sentence_words a JOIN sentence_words b ON a.doc_id = b.doc_id AND a.word = b.word
  GROUP BY ALL
)"""

LOG_WEIGHT = "CASE WHEN ln(n_a) + ln(n_b) < 1e-12 THEN 0.0 ELSE shared / (ln(n_a) + ln(n_b)) END"


def _pagerank(
    nodes: str, links: str, rounds: int = 100, tol: str = "1e-6", teleport: str = "1.0", dangling: str = "1.0", start: str = "1.0"
) -> str:
    """CTE ``scores(graph, node, score)``: a graph stops after ``rounds``, or when it moves by less than ``tol`` per node."""
    return f"""
nodes AS MATERIALIZED (
  SELECT graph, node, count(*) OVER (PARTITION BY graph) AS n,
         ({teleport})::DOUBLE / sum(({teleport})::DOUBLE) OVER (PARTITION BY graph) AS lands,
         ({dangling})::DOUBLE / sum(({dangling})::DOUBLE) OVER (PARTITION BY graph) AS goes,
         ({start})::DOUBLE / sum(({start})::DOUBLE) OVER (PARTITION BY graph) AS begins
  FROM ({nodes})
),
links AS MATERIALIZED (
  SELECT graph, src, dst, weight / sum(weight) OVER (PARTITION BY graph, src) AS share FROM ({links})
),
start AS MATERIALIZED (
  SELECT graph, node, n, lands, goes, begins, NOT EXISTS (SELECT 1 FROM links l WHERE l.graph = nodes.graph AND l.src = node) AS loose
  FROM nodes
),
rounds AS (
  SELECT graph, node, n, lands, goes, loose, begins AS score, 0 AS done, false AS finished FROM start
  UNION ALL
  SELECT graph, node, n, lands, goes, loose, moved, done + 1, sum(abs(moved - score)) OVER (PARTITION BY graph) < n * {tol}
  FROM (
    SELECT s.*, 0.85 * (coalesce(g.got, 0.0) + s.loose_mass * s.goes) + 0.15 * s.lands AS moved
    FROM (
      SELECT *, sum(CASE WHEN loose THEN score ELSE 0.0 END) OVER (PARTITION BY graph) AS loose_mass
      FROM rounds WHERE done < {rounds} AND NOT finished
    ) s
    LEFT JOIN (
      SELECT l.graph, l.dst, sum(r.score * l.share) AS got
      FROM rounds r JOIN links l ON r.graph = l.graph AND r.node = l.src
      WHERE r.done < {rounds} AND NOT r.finished
      GROUP BY ALL
    ) g ON g.graph = s.graph AND g.dst = s.node
  )
),
scores AS (SELECT graph, node, arg_max(score, done) AS score FROM rounds GROUP BY graph, node)"""


def _sentence_scores(weight: str = LOG_WEIGHT, rounds: int = 100, tol: str = "1e-6", **vectors: str) -> str:
    links = f"SELECT * FROM (SELECT doc_id AS graph, src, dst, {weight} AS weight FROM shared) WHERE weight > 0"
    return f"""
WITH RECURSIVE {WORD_LISTS.strip()},
{SHARED.strip()},
{_pagerank("SELECT doc_id AS graph, idx AS node, sentence FROM sentence_rows", links, rounds, tol, **vectors).strip()},
ranked AS (
  SELECT s.doc_id, s.idx, s.sentence, score,
         row_number() OVER (PARTITION BY s.doc_id ORDER BY round(score, 9) DESC, s.idx) AS rank
  FROM scores JOIN sentence_rows s ON s.doc_id = graph AND s.idx = node
)"""


WORD_PAIRS = """
positions AS MATERIALIZED (
  SELECT doc_id, idx, unnest(range(len(words))) AS pos, unnest(words) AS word FROM {source}
),
pairs AS (
  SELECT a.doc_id, a.idx, (b.pos - a.pos)::INTEGER AS distance, a.word AS w1, b.word AS w2
  FROM positions a JOIN positions b
    ON a.doc_id = b.doc_id AND a.idx = b.idx AND b.pos > a.pos AND b.pos < a.pos + {window}
)"""

VERTICES = """
vertices AS MATERIALIZED (
  SELECT doc_id, word, (row_number() OVER (PARTITION BY doc_id ORDER BY min(idx * 1000000 + pos)) - 1)::INTEGER AS vertex
  FROM (SELECT doc_id, idx, unnest(range(len(words))) AS pos, unnest(words) AS word FROM words_all_filters)
  GROUP BY doc_id, word
)"""

SOFTMAX = """
exps AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings),
dist AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM exps)"""

MARKED = rf"""
marked AS (
  SELECT doc_id, regexp_replace(
    '《' || source || '》' || text || '《' || lang || '》（' || source || '号）' || n_chars::VARCHAR
    || '《' || source || '》（' || lang || '）end（' || lang || '号）', '{SPACE}+', '', 'g') AS content
  FROM documents
)"""

COMMON_WORDS = rf"""
bench AS MATERIALIZED (
  SELECT item_id, {LETTER_TOKENS.format(text="text", more="")} AS tokens FROM benchmark
),
bench_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(tokens) AS term FROM bench) GROUP BY term),
common_words AS (SELECT term AS word FROM bench_df WHERE df * 4 >= (SELECT count(*) FROM bench)),
lexicon AS (
  SELECT term AS word, CASE WHEN term LIKE '%ly' THEN 'd' WHEN term LIKE '%ed' THEN 'v'
                            WHEN term LIKE '%er' THEN 'a' ELSE 'n' END AS tag
  FROM bench_df
)"""


def oracles() -> dict[str, str]:
    tokens, kept_tokens = _tokens(), _tokens(stop=True)
    sql = {}
    sql["corpus_scan"] = "SELECT doc_id, text AS content FROM documents"
    sql["corpus_projected_limit"] = (
        "SELECT doc_id, text AS content FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 200"
    )
    sql["corpus_nonempty"] = "SELECT conv_id AS doc_id, text AS content FROM conversations WHERE length(text) > 0"
    sql["corpus_remap"] = (
        "SELECT page_id AS doc_id, url AS title, NULL::VARCHAR AS time, html, NULL::VARCHAR AS org FROM pages"
    )
    sql["corpus_union"] = """
SELECT doc_id, NULL::VARCHAR AS title, NULL::VARCHAR AS time, text AS html, source AS org, 'documents' AS corpus FROM documents
UNION ALL
SELECT page_id, url, NULL, html, NULL, 'pages' FROM pages"""
    sql["corpus_clean"] = "SELECT DISTINCT text AS content FROM documents WHERE text IS NOT NULL"
    sql["corpus_distinct_with_id"] = "SELECT DISTINCT doc_id, text AS content FROM documents WHERE text IS NOT NULL"
    sql["stopwords_table"] = f"WITH {COMMON_WORDS.strip()} SELECT word FROM common_words"
    sql["text_lines_scan"] = f"""
WITH {STOP}, {kept_tokens},
first_seen AS (
  SELECT doc_id, token, min(pos) AS pos
  FROM (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM tok) GROUP BY ALL
),
line AS (SELECT doc_id, string_agg(token, ',' ORDER BY pos) AS line FROM first_seen GROUP BY doc_id)
SELECT '[' || coalesce(line, '') || ']' AS content FROM tok LEFT JOIN line USING (doc_id)"""
    sql["vector_csv_roundtrip"] = f"""
WITH {SOFTMAX.strip()}
SELECT vec_id::VARCHAR AS id, (list_position(p, list_max(p)) - 1)::INTEGER AS topic_num,
       unnest(range(len(p)))::INTEGER AS dim, round(unnest(p), 6) AS value
FROM dist"""
    sql["decode_text"] = "SELECT doc_id, '(' || text || chr(65533) AS content FROM documents"
    sql["tokenize"] = f"""
WITH {tokens} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS n_tokens FROM tok"""
    sql["token_filter"] = f"""
WITH {STOP}, kept AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+(?:\\.[0-9]+)?%?'),
    lambda t: length(t) >= 2 AND regexp_matches(t, '^[\\x{{4E00}}-\\x{{9FA5}}_a-zA-Z]+$'){NOT_STOP}) AS tokens
  FROM documents, stop_words
)
SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INTEGER AS n_tokens FROM kept"""
    sql["tokens_stopword_anti"] = f"""
WITH {tokens}, {TOKEN_ROWS.strip()}, {COMMON_WORDS.strip()}
SELECT doc_id, pos, token FROM token_rows WHERE token NOT IN (SELECT word FROM common_words)"""
    sql["tokens_tag_filter"] = f"""
WITH {tokens}, {TOKEN_ROWS.strip()}, {COMMON_WORDS.strip()}
SELECT doc_id, pos, token FROM token_rows LEFT JOIN lexicon ON token = word
WHERE CASE WHEN word IS NULL THEN regexp_matches(token, '^[A-Za-z][A-Za-z0-9]*$') ELSE tag IN ('n', 'v') END"""
    sql["strip_whitespace"] = f"SELECT doc_id, regexp_replace(text, '{SPACE}+', '', 'g') AS content FROM documents"
    sql["extract_titles"] = f"""
WITH {MARKED.strip()},
found AS (SELECT doc_id, content, regexp_extract_all(content, '《(.*?)》', 1) AS names FROM marked),
firsts AS (
  SELECT doc_id, name, min(p) AS p
  FROM (SELECT doc_id, unnest(range(len(names))) AS p, replace(unnest(names), '《', '') AS name FROM found) GROUP BY ALL
)
SELECT doc_id, (SELECT string_agg(name, '|' ORDER BY p) FROM firsts f WHERE f.doc_id = found.doc_id) AS titles,
       regexp_replace(content, '《.*?》', '', 'g') AS rest
FROM found"""
    sql["drop_doc_numbers"] = f"""
WITH {MARKED.strip()}
SELECT doc_id, regexp_replace(content, '（[^（）]*号）', '', 'g') AS per_bracket,
       regexp_replace(content, '（.*号）', '', 'g') AS greedy
FROM marked"""
    sql["sentence_split"] = f"WITH {SENTENCES.strip()} SELECT doc_id, idx, sentence FROM sentence_rows"
    sql["sentence_words"] = f"""
WITH {WORD_LISTS.strip()}
SELECT a.doc_id, a.idx, array_to_string(a.words, ' ') AS words_no_filter,
       array_to_string(b.words, ' ') AS words_no_stop_words, array_to_string(c.words, ' ') AS words_all_filters
FROM words_no_filter a JOIN words_no_stop_words b USING (doc_id, idx) JOIN words_all_filters c USING (doc_id, idx)"""
    sql["parse_keyword_line"] = r"""
WITH lines AS (SELECT doc_id, '[' || lang || ', ' || text || ',' || source || ']' AS line FROM documents),
items AS (SELECT doc_id, string_split(regexp_replace(line, '\A[\[\]]+|[\[\]]+\z', '', 'g'), ',') AS items FROM lines)
SELECT doc_id, len(items)::INTEGER AS n, array_to_string(items, '|') AS items FROM items"""
    sql["term_frequency"] = f"WITH {tokens}, {TERM_COUNTS.strip()} SELECT doc_id, term, tf FROM tf"
    sql["document_frequency"] = f"WITH {tokens}, {TERM_COUNTS.strip()} SELECT term, df FROM df"
    weight = "round(tf * ln(((SELECT count(*) FROM tok) + 1)::DOUBLE / (df + 1)), 6)"
    sql["tfidf"] = f"""
WITH {tokens}, {TERM_COUNTS.strip()}
SELECT doc_id, term, tf, df, {weight} AS tfidf FROM tf JOIN df USING (term)"""
    sql["count_vectors"] = sql["term_frequency"]
    sql["idf_vectors"] = f"""
WITH {tokens}, {TERM_COUNTS.strip()}
SELECT doc_id, term, {weight} AS tfidf FROM tf JOIN df USING (term)"""
    sql["hashing_tf_totals"] = f"WITH {tokens} SELECT doc_id, len(tokens)::BIGINT AS n_tokens FROM tok WHERE len(tokens) > 0"
    sql["list_concat_by_key"] = f"""
WITH {tokens}
SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos, token
FROM (SELECT source, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tok JOIN documents USING (doc_id))"""
    sql["sentence_graph_edges"] = f"""
WITH {WORD_LISTS.strip()}, {SHARED.strip()}
SELECT doc_id, src, dst, round(weight, 6) AS weight
FROM (SELECT doc_id, src, dst, {LOG_WEIGHT} AS weight FROM shared WHERE src <= dst) WHERE weight > 0"""
    sql["textrank_scores"] = f"""
{_sentence_scores()}
SELECT doc_id, idx, sentence, round(score, 9) AS weight, rank::INTEGER AS rank FROM ranked"""
    sql["textrank_summary"] = f"""
{_sentence_scores()},
picked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM ranked WHERE length(sentence) >= 6
),
joined AS (
  SELECT doc_id, string_agg(sentence, chr(10) ORDER BY place) AS html, count(*) AS n FROM picked WHERE place <= 3 GROUP BY doc_id
)
SELECT doc_id, coalesce(html, '') AS html, coalesce(n, 0)::INTEGER AS n_sentences
FROM documents LEFT JOIN joined USING (doc_id)"""
    sql["textrank_personal"] = f"""
{_sentence_scores(teleport="1.0 / (node + 1)", dangling="length(sentence)", start="CASE WHEN node = 0 THEN 1 ELSE 0 END")}
SELECT doc_id, idx, round(score, 9) AS weight, rank::INTEGER AS rank FROM ranked"""
    sql["textrank_custom_similarity"] = f"""
{_sentence_scores("shared / (n_a + n_b)", 30, "0")}
SELECT doc_id, idx, round(score, 9) AS weight FROM ranked"""
    sql["token_window_pairs"] = f"""
WITH {WORD_LISTS.strip()}, {WORD_PAIRS.format(source="words_all_filters", window=3).strip()}
SELECT doc_id, idx, distance, w1, w2, count(*) AS n FROM pairs GROUP BY ALL"""
    sql["word_vertices"] = f"WITH {WORD_LISTS.strip()}, {VERTICES.strip()} SELECT doc_id, vertex, word FROM vertices"
    edges = """
both_ways AS (SELECT doc_id, w1, w2 FROM pairs UNION SELECT doc_id, w2, w1 FROM pairs)"""
    sql["word_graph_edges"] = f"""
WITH {WORD_LISTS.strip()}, {WORD_PAIRS.format(source="words_no_stop_words", window=2).strip()},
{VERTICES.strip()}, {edges.strip()}
SELECT doc_id, w1, w2 FROM both_ways
SEMI JOIN (SELECT doc_id, word AS w1 FROM vertices) a USING (doc_id, w1)
SEMI JOIN (SELECT doc_id, word AS w2 FROM vertices) b USING (doc_id, w2)"""
    word_graph = f"""
WITH RECURSIVE {WORD_LISTS.strip()}, {WORD_PAIRS.format(source="words_all_filters", window=2).strip()},
{VERTICES.strip()}, {edges.strip()}"""
    ranks = _pagerank(
        "SELECT doc_id AS graph, word AS node FROM vertices",
        "SELECT doc_id AS graph, w1 AS src, w2 AS dst, 1.0::DOUBLE AS weight FROM both_ways",
    )
    sql["keyword_rank"] = f"""
{word_graph}, {ranks.strip()}
SELECT doc_id, word, round(score, 9) AS weight,
       row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, vertex)::INTEGER AS rank
FROM scores JOIN vertices ON doc_id = graph AND word = node"""
    ranks = _pagerank(
        "SELECT DISTINCT 0 AS graph, word AS node FROM vertices",
        "SELECT DISTINCT 0 AS graph, w1 AS src, w2 AS dst, 1.0::DOUBLE AS weight FROM both_ways",
    )
    sql["corpus_keyword_rank"] = f"""
{word_graph}, {ranks.strip()}
SELECT node AS word, round(score, 9) AS weight FROM scores"""
    sql["topic_argmax"] = f"""
WITH {SOFTMAX.strip()} SELECT vec_id AS doc_id, (list_position(p, list_max(p)) - 1)::INTEGER AS topic_num FROM dist"""
    sql["doc_similarity_kl_top5"] = f"""
WITH {SOFTMAX.strip()},
pairs AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2,
         greatest(list_sum(list_transform(list_zip(a.p, b.p), lambda z: z[1] * ln(z[1] / z[2]))), 0.0) AS kl
  FROM dist a, dist b
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round(kl, 9), id2) AS rank FROM pairs)
SELECT id1, id2, round(kl, 6) AS kl, rank::INTEGER AS rank FROM ranked WHERE rank <= 5"""
    sql["doc_similarity_euclid_top5"] = """
WITH vecs AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (
  SELECT a.vec_id AS id1, b.vec_id AS id2,
         sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
  FROM vecs a, vecs b
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round(distance, 9), id2) AS rank FROM pairs)
SELECT id1, id2, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity, rank::INTEGER AS rank
FROM ranked WHERE rank <= 5"""
    vowels = ", ".join(f"length(l) - length(replace(l, '{c}', '')) + 1.0::DOUBLE" for c in "aeiou")
    letters = f"[{vowels}, length(translate(l, 'aeiou', '')) + 1.0::DOUBLE]"
    lower = "translate(text, 'AEIOU', 'aeiou')"
    shares = f"""
WITH q AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM (
  SELECT id, {letters} AS v FROM (SELECT conv_id * 100000 + turn AS id, {lower} AS l FROM conversations WHERE text IS NOT NULL))),
c AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM (
  SELECT id, {letters} AS v FROM (SELECT doc_id AS id, {lower} AS l FROM documents WHERE text IS NOT NULL))),"""
    for name, column, distance in (
        ("kl", "kl", "greatest(list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * ln(z[1] / z[2]))), 0.0)"),
        ("euclid", "distance", "sqrt(list_sum(list_transform(list_zip(q.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"),
    ):
        sql[f"doc_similarity_index_{name}"] = f"""{shares}
pairs AS (SELECT q.id AS id1, c.id AS id2, {distance} AS d FROM q, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY round(d, 9), id2) AS rank FROM pairs)
SELECT id1, id2, round(d, 6) AS {column}, rank::INTEGER AS rank FROM ranked WHERE rank <= 5"""
    training = f"{STOP}, {_tokens(stop=True)}, {TERM_COUNTS.strip()}"
    sql["sharded_topic_words"] = f"WITH {training} SELECT term, round(sum(tf)::DOUBLE, 4) AS held FROM tf GROUP BY term"
    sql["sharded_topic_idf_words"] = f"""
WITH {training},
w AS (SELECT term, sum(tf) * ln(((SELECT count(*) FROM tok) + 1)::DOUBLE / (df + 1)) AS held FROM tf JOIN df USING (term) GROUP BY term, df)
SELECT term, round(held, 3) AS held FROM w WHERE held > 0"""
    sql["sharded_topic_shape"] = "SELECT i::INTEGER AS topic, 15::BIGINT AS terms, true AS falls, true AS shares FROM range(10) t(i)"
    others = LETTER_TOKENS.format(text="text", more=NOT_STOP)
    sql["sharded_topic_labels"] = f"""
WITH {training},
both_kinds AS (
  SELECT format('turn {{}} {{}}', conv_id, turn) AS doc_id, text FROM conversations
  UNION ALL SELECT format('page {{}}', page_id) AS doc_id, html AS text FROM pages
),
listed AS (SELECT doc_id, row_number() OVER () AS r, {others} AS tokens FROM both_kinds, stop_words),
known AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(tokens) AS term FROM listed) JOIN df USING (term) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_known, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS total, true AS first
FROM listed LEFT JOIN known USING (r)"""
    latin, chars = "abcdefghijklmnopqrstuvwxyz", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
    runs = r"[\x{4E00}-\x{9FA5}]+|[A-Za-z0-9]+(?:\.[0-9]+)?%?"
    sql["han_cover"] = f"""
WITH t AS (SELECT doc_id, regexp_replace(translate(lower(text), '{latin}', '{chars}'), '{SPACE}+', '', 'g') AS c FROM documents)
SELECT doc_id, md5(array_to_string(coalesce(regexp_extract_all(c, '{runs}'), []), '')) AS spelled FROM t"""
    sql["combine_lengths"] = """
SELECT source, count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS chars, max(length(text))::INTEGER AS longest
FROM documents GROUP BY source"""
    return sql
