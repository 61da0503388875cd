"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from heronry.operators.retrieval import METHODS as RETRIEVAL_METHODS
from heronry.sources.tables import METHODS, QUERY_TYPES, STRATEGIES

NL = "chr(10)"
TOKEN = r"\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])|\s+$"
WORD = r"[\p{L}\p{N}_]+"
SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SECTIONS = f"""
sections AS (
    SELECT doc_id, lang, book, md, (sum(length(md)) OVER (PARTITION BY book ORDER BY doc_id) - length(md))::BIGINT AS start FROM (
        SELECT doc_id, lang, source AS book,
            CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN '## Book ' || source || {NL} || {NL} ELSE '' END
            || '### doc ' || doc_id || {NL} || {NL}
            || CASE WHEN doc_id % 3 = 0 THEN '#### ' || lang || ' notes' || {NL} || {NL} ELSE '' END
            || CASE WHEN doc_id % 17 = 0 THEN '```text' || {NL} || text || {NL} || '```'
                    WHEN doc_id % 5 = 0 THEN '| key | value |' || {NL} || '| --- | --- |' || {NL} || '| lang | ' || lang || ' |' || {NL} || '| doc | ' || doc_id || ' |' || {NL} || {NL} || text
                    ELSE text END
            || {NL} || {NL} AS md
        FROM documents)
)"""

LINES = f"""{SECTIONS},
split AS (SELECT doc_id, book, start, string_split(md, {NL}) AS parts FROM sections),
lines AS (
    SELECT doc_id, book, start, line_no, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1)::BIGINT AS loc
    FROM (SELECT doc_id, book, start, n - 1 AS line_no, parts[n] AS line FROM (SELECT doc_id, book, start, parts, unnest(range(1, len(parts) + 1)) AS n FROM split))
)"""

BLOCKS = f"""{LINES},
fenced AS (SELECT *, line LIKE '```%' AS fence, sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM lines),
kinds AS (
    SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN 'heading' WHEN trim(line) = '' THEN 'blank' WHEN trim(line) LIKE '|%' THEN 'pipe' ELSE 'text' END AS kind
    FROM fenced
),
steps AS (SELECT *, (kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no), ''))::INT AS step FROM kinds),
islands AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM steps),
blocks AS (
    SELECT doc_id, island, kind, string_agg(line, {NL} ORDER BY line_no) AS raw, count(*) AS n, sum((line LIKE '%|%')::INT) AS pipes, min(loc) AS char_start, max(loc + length(line) + 1) AS char_end,
           list(line ORDER BY line_no) FILTER (line LIKE '%|%') AS piped
    FROM islands GROUP BY doc_id, island, kind
),
typed AS (SELECT *, kind IN ('pipe', 'text') AND n >= 2 AND pipes >= 2 AND 2 * pipes > n AS is_table FROM blocks)"""

HEADINGS = f"""{LINES},
fenced AS (SELECT *, line LIKE '```%' AS fence, sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM lines),
headings AS (
    SELECT doc_id, book, start, loc, line, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) AS content
    FROM fenced WHERE fences % 2 = 0 AND NOT fence AND regexp_matches(line, '^#{{1,6}}\\s')
)"""

PLACED = f"""{HEADINGS},
sizes AS (SELECT book, sum(length(md)) AS n FROM sections GROUP BY book),
starts AS (SELECT book, sum(n) OVER (ORDER BY book) - n AS book_start FROM sizes),
placed AS (SELECT h.book, (h.start + h.loc + s.book_start)::BIGINT AS pos, h.level, h.content FROM headings h JOIN starts s ON h.book = s.book),
books AS (
    SELECT book AS book_title, (row_number() OVER (ORDER BY pos) - 1)::INTEGER AS book_index, pos AS start_offset, lead(pos) OVER (ORDER BY pos) AS end_offset, content AS h2_header_text
    FROM placed WHERE level = 2
)"""

CHUNKS = f"""
tok AS (SELECT doc_id, source AS book, regexp_extract_all(text, '{TOKEN}') AS t FROM documents),
cut AS (SELECT doc_id, book, t, unnest(range(0, len(t), 448)) AS p FROM tok),
raw AS (SELECT doc_id, book, (p // 448)::BIGINT AS chunk_no, array_to_string(list_slice(t, p + 1, p + 512), '') AS content, length(array_to_string(list_slice(t, 1, p), ''))::BIGINT AS char_start FROM cut),
chunks AS (
    SELECT doc_id, book, chunk_no, content, char_start, char_start + length(content) AS char_end, len(regexp_extract_all(content, '{TOKEN}'))::BIGINT AS token_count,
           substr(sha1('fixed_size:' || content || ':' || char_start), 1, 16) AS chunk_id
    FROM raw
)"""

INDEX = f"""{CHUNKS},
once AS (SELECT chunk_id, min(content) AS content, min(token_count) AS token_count FROM chunks GROUP BY chunk_id),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '{WORD}')) AS term FROM once) GROUP BY chunk_id, term),
stats AS (SELECT chunk_id, len(regexp_extract_all(lower(content), '{WORD}')) AS dl FROM once),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
dfs AS (SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM post GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM dfs) ELSE raw_idf END AS idf FROM dfs)"""

GOLD = f"""
gold AS (
    SELECT 'q' || item_id AS query_id, {names(QUERY_TYPES)}[item_id % 6 + 1] AS query_type, list_slice(regexp_extract_all(lower(text), '{WORD}'), 1, 8) AS terms, substr(text, 1, 60) AS answer, text AS passage
    FROM benchmark
),
located AS (
    SELECT query_id, doc_id, greatest(0, loc - 300)::BIGINT AS char_start, least(n, loc + m + 300)::BIGINT AS char_end FROM (
        SELECT g.query_id, g.answer, d.doc_id, instr(d.text, trim(g.passage)) - 1 AS loc, length(d.text) AS n, length(trim(g.passage)) AS m, row_number() OVER (PARTITION BY g.query_id ORDER BY d.doc_id) AS r
        FROM gold g JOIN documents d ON instr(d.text, trim(g.passage)) > 0 WHERE length(trim(g.passage)) >= 10)
    WHERE r = 1
)"""

BM25 = f"""{INDEX}, {GOLD},
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM gold) GROUP BY query_id, term),
scored AS (
    SELECT a.query_id, p.chunk_id, sum(a.qtf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * s.dl / (SELECT avgdl FROM corpus)))) AS score
    FROM asked a JOIN post p ON a.term = p.term JOIN terms t ON t.term = a.term JOIN stats s ON s.chunk_id = p.chunk_id GROUP BY a.query_id, p.chunk_id
),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE score > 0)"""

PARENTS = f"""
first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id) AS r FROM chunks) WHERE r = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start, chunk_id) AS n FROM first_),
around AS (SELECT a.chunk_id, b.n, b.content, sum(b.token_count) OVER (PARTITION BY a.chunk_id ORDER BY b.n) AS total FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n - 5 AND a.n + 5),
parents AS (SELECT chunk_id, coalesce(string_agg(content, {NL} || {NL} ORDER BY n) FILTER (total <= 2000), '') AS parent FROM around GROUP BY chunk_id)"""

JUDGED = f"""{BM25},
judged AS (
    SELECT h.query_id, h.rank, contains(lower(o.content), lower(g.answer)) AND g.answer <> '' AS relevant FROM hits h JOIN once o ON h.chunk_id = o.chunk_id JOIN gold g ON g.query_id = h.query_id WHERE h.rank <= 20
),
ks AS (SELECT query_id, unnest([1, 3, 5, 10, 20]) AS k FROM gold),
cuts AS (
    SELECT ks.query_id, ks.k, j.rank, coalesce(j.relevant, false) AS relevant, CASE WHEN j.rank <= ks.k AND j.relevant THEN 1.0 ELSE 0.0 END AS g FROM ks LEFT JOIN judged j ON ks.query_id = j.query_id
),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY g DESC, rank) AS r FROM cuts),
measured AS (
    SELECT query_id, k::BIGINT AS k, coalesce(max(g), 0.0) AS recall, coalesce(max(CASE WHEN relevant THEN 1.0 / rank END), 0.0) AS mrr,
           CASE WHEN coalesce(sum(g), 0) = 0 THEN 0.0 ELSE sum(g / log2(rank + 1)) / sum(g / log2(r + 1)) END AS ndcg
    FROM ideal GROUP BY query_id, k
)"""

VECTORS = """
wide AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
v AS (SELECT vec_id, label, lpad(vec_id::VARCHAR, 8, '0') AS chunk_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM wide)"""
#: Every vector whose id is divisible by 20 as a question, nth by its number, with every vector.
NEAR = f"""{VECTORS},
asked AS (SELECT vec_id AS query_id, vec_id // 20 AS nth, label AS q_label, e FROM v WHERE vec_id % 20 = 0),
near AS (SELECT query_id, nth, q_label, chunk_id, vec_id, label, list_inner_product(q.e, c.e) AS score FROM asked q CROSS JOIN v c)"""
DENSE_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)"


def fused(k: int) -> str:
    return f"""WITH {NEAR},
first AS (SELECT query_id, chunk_id, rank FROM (SELECT *, {DENSE_RANK} AS rank FROM near) WHERE rank <= {max(3 * k, 50)}),
second AS (SELECT query_id - 20 AS query_id, chunk_id, rank FROM first WHERE query_id >= 20),
both_lists AS (SELECT *, 0 AS list_no FROM first UNION ALL SELECT *, 1 FROM second),
merged AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 1000 + rank) AS seen FROM both_lists GROUP BY query_id, chunk_id)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, chunk_id) AS rank FROM merged) WHERE rank <= {k}"""


RESULTS = f"""
results AS (
    SELECT {names(STRATEGIES)}[user_id % 6 + 1] AS strategy, {names(METHODS)}[event_id % 5 + 1] AS method, [1, 3, 5, 10, 20][(event_id // 5) % 5 + 1] AS k, event_id % 3 + 1 AS trial,
           'q' || (event_id % 110) AS query_id, {names((*QUERY_TYPES, "distractor"))}[event_id % 7 + 1] AS query_type, (v % 2)::DOUBLE AS recall, 1.0::DOUBLE / (v % 4 + 1) AS mrr, (v % 5) / 4.0::DOUBLE AS ndcg,
           (v % 3 > 0)::INT::DOUBLE AS hit, (v % 11) / 10.0::DOUBLE AS faithfulness, event_id
    FROM (SELECT *, floor(value)::BIGINT AS v FROM events)
)"""

PRICED = """
prices AS (SELECT * FROM (VALUES ('text-embedding-3-small', 0.02, 0.0), ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('claude-sonnet-4-5-20241022', 3.0, 15.0)) t(model, rate_in, rate_out)),
calls AS (
    SELECT event_type AS stage, ['text-embedding-3-small', 'gpt-4o', 'gpt-4o-mini', 'claude-sonnet-4-5-20241022', 'unlisted'][event_id % 5 + 1] AS model, floor(value)::BIGINT * 10 AS input_tokens, floor(value)::BIGINT AS output_tokens, event_id % 4 = 0 AS cached
    FROM events
),
priced AS (
    SELECT c.*, input_tokens / 1e6 * CASE WHEN cached AND c.model LIKE 'claude%' THEN 0.3 ELSE coalesce(rate_in::DOUBLE, 0) END + output_tokens / 1e6 * coalesce(rate_out::DOUBLE, 0) AS cost FROM calls c LEFT JOIN prices p ON c.model = p.model
)"""

TABLES = f"""
parts AS (SELECT p_partkey, '| brand | size |' || {NL} || '| --- | --- |' || {NL} || '| ' || p_brand || ' | ' || p_size || ' |' AS t FROM part),
state AS (SELECT 'p' || p_partkey AS chunk_id, p_partkey % 5 = 0 AS body_only, p_partkey % 5 <> 0 AND p_partkey % 7 = 0 AS head_only FROM parts)"""

GOLD_ROWS = f"""{GOLD},
rows_ AS (
    SELECT g.query_id, CASE WHEN n % 11 = 0 THEN 'riddle' ELSE query_type END AS query_type, CASE WHEN n % 9 = 0 THEN ' ' ELSE array_to_string(terms, ' ') END AS query, CASE WHEN n % 10 = 0 THEN 'no such answer' ELSE answer END AS answer,
           CASE WHEN n % 2 = 0 THEN 'human' ELSE 'auto' END AS validator, l.doc_id, l.char_start, l.char_end, n
    FROM (SELECT *, substr(query_id, 2)::INT AS n FROM gold) g LEFT JOIN located l ON g.query_id = l.query_id
)"""


def mean_of(value: str, keys: str, where: str = "true") -> str:
    cols = ", ".join(f"{k}::BIGINT AS k" if k == "k" else k for k in keys.split(", "))
    return f"WITH {RESULTS} SELECT {cols}, round(avg({value}), 4) AS mean_{value} FROM results WHERE {where} GROUP BY {keys}"


def pivoted(value: str) -> str:
    cols = ", ".join(f"round(avg({value}) FILTER (method = '{m}'), 4) AS {m}" for m in METHODS)
    return f"WITH {RESULTS} SELECT strategy, {cols} FROM results WHERE query_type <> 'distractor' AND k = 10 GROUP BY strategy"


def best(where: str) -> str:
    return f"""best AS (
    SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY round(mean, 9) DESC, strategy, method) AS r FROM (
        SELECT query_type, strategy, method, avg(recall) AS mean, count(DISTINCT query_id) AS n FROM results WHERE k = 10 AND {where} GROUP BY query_type, strategy, method)
)"""


ORACLES: dict[str, str] = {
    "corpus_lines_offsets": f'WITH {LINES} SELECT doc_id, line_no::BIGINT AS line_no, md5(line) AS line_md5, loc AS "offset" FROM lines',
    "corpus_headings": f"WITH {HEADINGS} SELECT doc_id, level::INTEGER AS level, content, loc AS char_start, loc + length(line) + 1 AS char_end FROM headings",
    "corpus_code_blocks": f"WITH {BLOCKS} SELECT doc_id, char_start, char_end, md5(raw) AS content_md5, 'text' AS info FROM blocks WHERE kind = 'code'",
    "corpus_tables": f"WITH {BLOCKS} SELECT doc_id, char_start, char_end, md5(raw) AS raw_md5 FROM typed WHERE is_table",
    "corpus_table_structure": f"""WITH {BLOCKS},
        cells AS (SELECT doc_id, char_start, pipes, piped, list_transform(string_split(trim(piped[1]), '|'), lambda c: trim(c)) AS c, regexp_matches(trim(piped[2]), '^[\\s|:\\-]+$') AS aligned FROM typed WHERE is_table),
        lead_cut AS (SELECT *, CASE WHEN c[1] = '' THEN list_slice(c, 2, len(c)) ELSE c END AS d FROM cells),
        both_cut AS (SELECT *, CASE WHEN d[len(d)] = '' THEN list_slice(d, 1, len(d) - 1) ELSE d END AS e FROM lead_cut)
        SELECT doc_id, char_start, array_to_string(e, '~') AS header, (pipes - 1 - aligned::INT)::BIGINT AS body_rows, aligned FROM both_cut""",
    "corpus_paragraphs": f"WITH {BLOCKS} SELECT doc_id, char_start, char_end, md5(trim(replace(raw, {NL}, ' '))) AS content_md5 FROM typed WHERE kind = 'text' AND NOT is_table",
    "corpus_profile": f"""WITH {LINES},
        marked AS (SELECT *, trim(line) LIKE '|%' AS pipe, trim(line) LIKE '```%' AS fence, sum((trim(line) LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM lines),
        runs AS (SELECT *, pipe AND NOT coalesce(lag(pipe) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS table_start FROM marked)
        SELECT book, count(*) AS total_lines, sum(length(line))::BIGINT AS total_characters, sum(len(regexp_extract_all(line, '{TOKEN}')))::BIGINT AS total_tokens, sum((trim(line) = '')::INT)::BIGINT AS empty_lines,
            sum(regexp_matches(line, '^#{{1,6}}\\s+.+$')::INT)::BIGINT AS headings, sum(table_start::INT)::BIGINT AS table_count, sum(pipe::INT)::BIGINT AS table_lines, round(sum(pipe::INT) / count(*), 4) AS table_line_fraction,
            sum((fence AND fences % 2 = 1)::INT)::BIGINT AS code_blocks, sum((NOT fence AND fences % 2 = 1)::INT)::BIGINT AS code_lines, sum(regexp_matches(line, '^##\\s+\\*\\*')::INT)::BIGINT AS bold_h2_headers, round(avg(length(line)), 1) AS avg_line_length
        FROM runs GROUP BY book""",
    "corpus_header_samples": f"""WITH {LINES},
        h AS (SELECT book, doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})\\s+.+$', 1)) AS level, substr(trim(regexp_replace(line, '^#{{1,6}}\\s+', '')), 1, 100) AS title FROM lines WHERE regexp_matches(line, '^#{{1,6}}\\s+.+$'))
        SELECT book, level::BIGINT AS level, n, doc_id, title, level_total FROM (SELECT *, row_number() OVER (PARTITION BY book, level ORDER BY doc_id, line_no) AS n, count(*) OVER (PARTITION BY book, level) AS level_total FROM h) WHERE n <= 5""",
    "title_normalize": "SELECT doc_id, source || ' ' || lower(lang) || ' no ' || doc_id AS title FROM documents",
    "book_spans": f"WITH {PLACED} SELECT book_title, book_index, start_offset, coalesce(end_offset, -1)::BIGINT AS end_offset, h2_header_text FROM books",
    "unmatched_headings": f"WITH {PLACED} SELECT pos, content FROM placed WHERE level = 2 AND book IN ('src3', 'src7')",
    "book_for_offset": f"WITH {PLACED} SELECT p.pos, b.book_title, b.book_index FROM placed p LEFT JOIN books b ON p.pos >= b.start_offset AND (b.end_offset IS NULL OR p.pos < b.end_offset) WHERE p.level = 3",
    "chapter_path": f"""WITH {HEADINGS},
        points AS (SELECT book, doc_id, start + length(md) // 2 AS pos FROM sections)
        SELECT p.book, p.doc_id, array_to_string(list_filter([
            (SELECT h.content FROM headings h WHERE h.book = p.book AND h.level = 2 AND h.start + h.loc <= p.pos ORDER BY h.start + h.loc DESC LIMIT 1),
            (SELECT h.content FROM headings h WHERE h.book = p.book AND h.level = 3 AND h.start + h.loc <= p.pos ORDER BY h.start + h.loc DESC LIMIT 1),
            (SELECT h.content FROM headings h WHERE h.book = p.book AND h.level = 4 AND h.start + h.loc <= p.pos ORDER BY h.start + h.loc DESC LIMIT 1)], lambda x: x IS NOT NULL), ' > ') AS path
        FROM points p""",
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}'))::BIGINT AS tokens FROM documents",
    "token_truncate": f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '{TOKEN}'), 1, 20), '') AS head FROM documents",
    "bm25_tokens": f"SELECT doc_id, len(t)::BIGINT AS terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)",
    "sentence_split": f"""SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (
        SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30) || '|{chr(10)}{chr(10)}+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""",
    "cosine_pairs": """WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
        SELECT a.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS cosine FROM w a JOIN w b ON b.vec_id = a.vec_id + 1""",
    "chunk_fixed_size": f"WITH {CHUNKS} SELECT doc_id, chunk_no, char_start, char_end, token_count, chunk_id FROM chunks",
    "chunk_markdown_hierarchical": f"""WITH {SECTIONS},
        parts AS (SELECT doc_id, string_split(regexp_replace(md, '(?m)^(#{{2,4}}\\s)', chr(30) || '\\1', 'g'), chr(30)) AS s FROM sections),
        each AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM parts),
        cut AS (SELECT doc_id, s[n] AS body, length(array_to_string(list_slice(s, 1, n - 1), '')) AS start FROM each),
        kept AS (SELECT doc_id, start::BIGINT AS char_start, trim(body, {SPACE}) AS content FROM cut WHERE trim(body, {SPACE}) <> '')
        SELECT doc_id, char_start, md5(content) AS content_md5, len(regexp_extract_all(content, '{TOKEN}'))::BIGINT AS token_count, length(content) - length(replace(content, '|', '')) > 4 AS contains_table, contains(content, '```') AS contains_code FROM kept""",
    "chunk_tables_in_context": f"""WITH {BLOCKS},
        tables AS (SELECT t.doc_id, t.raw, t.char_start, t.char_end, trim(substr(s.md, greatest(0, t.char_start - 1000) + 1, t.char_start - greatest(0, t.char_start - 1000)), {SPACE}) AS before FROM typed t JOIN sections s ON s.doc_id = t.doc_id WHERE t.is_table),
        cut AS (SELECT *, array_to_string(list_slice(regexp_extract_all(before, '{TOKEN}'), 1, 200), '') AS head FROM tables),
        ctx AS (SELECT *, CASE WHEN len(string_split(head, {NL})) > 10 THEN array_to_string(list_slice(string_split(head, {NL}), -10, -1), {NL}) ELSE head END AS context FROM cut)
        SELECT doc_id, char_start, char_end, md5(CASE WHEN context <> '' THEN context || {NL} || {NL} || raw ELSE raw END) AS content_md5 FROM ctx""",
    "chunk_contextual": f"WITH {CHUNKS} SELECT chunk_id, 'About: ' || substr(content, 1, 30) AS contextual_prefix FROM chunks",
    "chunk_flags": f"WITH {SECTIONS} SELECT substr(sha1('section:' || md || ':' || start), 1, 16) AS chunk_id, length(md) - length(replace(md, '|', '')) > 4 AS contains_table, contains(md, '```') AS contains_code FROM sections",
    "chunk_dedup": "SELECT substr(sha1(text), 1, 16) AS chunk_id, min(doc_id) AS seq FROM documents GROUP BY 1",
    "chunk_sample": f"WITH {CHUNKS} SELECT chunk_id, md5('42:' || chunk_id) AS h FROM chunks ORDER BY h, chunk_id LIMIT 50",
    "chunk_counts": f"WITH {CHUNKS} SELECT book, count(*) AS chunks, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY book",
    "index_postings": f"""WITH {CHUNKS}, post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '{WORD}')) AS term FROM chunks) GROUP BY chunk_id, term)
        SELECT chunk_id, count(*) AS terms, sum(tf)::BIGINT AS tf, max(term) AS last_term FROM post GROUP BY chunk_id""",
    "index_doc_stats": f"WITH {CHUNKS} SELECT chunk_id, max(len(regexp_extract_all(lower(content), '{WORD}')))::BIGINT AS dl FROM chunks GROUP BY chunk_id",
    "index_term_stats": f"""WITH {CHUNKS},
        words AS MATERIALIZED (SELECT chunk_id, list_distinct(regexp_extract_all(lower(content), '{WORD}')) AS terms FROM chunks),
        total AS MATERIALIZED (SELECT count(*) AS n FROM words),
        once_each AS (SELECT DISTINCT chunk_id, unnest(terms) AS term FROM words),
        dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM once_each GROUP BY term),
        raws AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs, total),
        mean AS MATERIALIZED (SELECT avg(raw_idf) AS m FROM raws)
        SELECT term, df, round(CASE WHEN raw_idf < 0 THEN 0.25 * m ELSE raw_idf END, 6) AS idf FROM raws, mean""",
    "index_vectors": f"WITH {VECTORS} SELECT vec_id, round(list_inner_product(e, list_transform(range(1, len(e) + 1), lambda i: i::DOUBLE)), 6) AS weighted, round(list_inner_product(e, e), 6) AS norm FROM v",
    "retrieve_dense_all": f"WITH {NEAR} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, {DENSE_RANK} AS rank FROM near) WHERE rank <= 10",
    "retrieve_bm25": f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits WHERE rank <= 10",
    "retrieve_metadata_filter_all": f"""WITH {NEAR},
        allowed AS (SELECT * FROM near WHERE (nth % 2 <> 0 OR vec_id % 4 = 0) AND (nth % 3 <> 0 OR label = q_label))
        SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, {DENSE_RANK} AS rank FROM allowed) WHERE rank <= 5""",
    "fuse_rrf_all": fused(10),
    "retrieve_hybrid_rrf_all": fused(20),
    "retrieve_query_decomposition_all": f"""WITH {NEAR},
        parts AS (SELECT * FROM (SELECT nth // 5 AS query_id, nth % 5 AS part, chunk_id, score, {DENSE_RANK} AS rank FROM near) WHERE part < 4 AND rank <= 10),
        many AS (SELECT query_id, count(DISTINCT part) AS n FROM parts GROUP BY query_id),
        merged AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(part * 1000 + rank) AS seen FROM parts WHERE query_id IN (SELECT query_id FROM many WHERE n > 1) GROUP BY query_id, chunk_id)
        SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, chunk_id) AS rank FROM merged) WHERE rank <= 10
        UNION ALL SELECT query_id, rank, chunk_id, round(score, 6) FROM parts WHERE query_id IN (SELECT query_id FROM many WHERE n = 1)""",
    "retrieve_hybrid_rerank": f"""WITH {BM25},
        pairs AS (SELECT h.query_id, h.chunk_id, list_distinct(g.terms) AS q, list_distinct(regexp_extract_all(lower(o.content), '{WORD}')) AS p FROM hits h JOIN gold g ON g.query_id = h.query_id JOIN once o ON o.chunk_id = h.chunk_id WHERE h.rank <= 10),
        shares AS (SELECT query_id, chunk_id, len(list_filter(q, lambda w: list_contains(p, w)))::DOUBLE / greatest(1, len(q)) AS score FROM pairs)
        SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM shares)""",
    "parent_map": f"WITH {CHUNKS}, {PARENTS} SELECT chunk_id, length(parent)::BIGINT AS n, md5(parent) AS parent_md5 FROM parents",
    "retrieve_small_to_big": f"""WITH {BM25}, {PARENTS},
        big AS (SELECT h.query_id, h.rank, h.chunk_id, CASE WHEN p.parent <> '' THEN p.parent ELSE o.content END AS content FROM hits h JOIN once o ON o.chunk_id = h.chunk_id LEFT JOIN parents p ON p.chunk_id = h.chunk_id WHERE h.rank <= 15),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(content, 1, 200) ORDER BY rank) AS b FROM big) WHERE b = 1),
        again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM best)
        SELECT query_id, place AS rank, chunk_id, md5(content) AS content_md5 FROM again WHERE place <= 5""",
    "retrieve_hyde": f"""WITH {INDEX}, {GOLD},
        bins AS (SELECT chunk_id, b, sum(tf)::DOUBLE AS c FROM (SELECT chunk_id, tf, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b FROM post) GROUP BY chunk_id, b),
        norms AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM bins GROUP BY chunk_id),
        q_bins AS (SELECT query_id, b, 2.0::DOUBLE * count(*) AS c FROM (SELECT query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT query_id, unnest(terms) AS t FROM gold)) GROUP BY query_id, b),
        scores AS (SELECT q.query_id, d.chunk_id, sum(q.c * d.c / n.n) AS score FROM q_bins q JOIN bins d ON q.b = d.b JOIN norms n ON n.chunk_id = d.chunk_id GROUP BY q.query_id, d.chunk_id)
        SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores) WHERE rank <= 5""",
    "span_overlaps": """SELECT event_id, round(CASE WHEN least(b - a, 20) <= 0 THEN 0.0::DOUBLE ELSE greatest(0, least(b, e) - greatest(a, c))::DOUBLE / least(b - a, 20) END, 6) AS overlap
        FROM (SELECT event_id, event_id % 97 AS a, event_id % 97 + user_id % 50 AS b, event_id % 89 AS c, event_id % 89 + 20 AS e FROM events)""",
    "relevance": f"WITH {JUDGED} SELECT query_id, rank, relevant, round(relevant::INT::DOUBLE, 6) AS gain FROM judged",
    "metrics_all": f"WITH {JUDGED} SELECT query_id, k, round(recall::DOUBLE, 6) AS recall, round(mrr::DOUBLE, 6) AS mrr, round(ndcg::DOUBLE, 6) AS ndcg, round(recall::DOUBLE, 6) AS hit FROM measured",
    "recall_by_type": f"""WITH {JUDGED} SELECT CASE WHEN l.query_id IS NULL THEN 'distractor' ELSE g.query_type END AS query_type, k, round(avg(recall)::DOUBLE, 6) AS mean_recall, round(avg(mrr)::DOUBLE, 6) AS mean_mrr, count(*) AS n
        FROM measured m JOIN gold g ON m.query_id = g.query_id LEFT JOIN located l ON l.query_id = g.query_id GROUP BY 1, 2""",
    "abstention_rate": "SELECT role AS query_type, count(*) AS n, round(avg((turn % 3 = 0 OR contains(upper(coalesce(text, '')), 'NOT_IN_CORPUS'))::INT), 4) AS abstention_rate FROM conversations GROUP BY role",
    "judge_score_parse": "SELECT conv_id, turn, round(CASE turn % 3 WHEN 0 THEN (conv_id % 10) / 10.0::DOUBLE WHEN 1 THEN least(1, conv_id % 4)::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM conversations",
    "generation_summary": f"WITH {RESULTS} SELECT strategy, method, round(avg(faithfulness), 6) AS mean, round(stddev_pop(faithfulness), 6) AS std, count(*) AS n FROM results GROUP BY strategy, method",
    "table_integrity": f"""WITH {TABLES} SELECT count(*) AS total_table_chunks, sum((NOT body_only AND NOT head_only)::INT)::BIGINT AS intact_tables, sum((head_only OR body_only)::INT)::BIGINT AS issues_count,
        round(sum((NOT body_only AND NOT head_only)::INT) / count(*), 4) AS integrity_score FROM state""",
    "table_integrity_issues": f"WITH {TABLES} SELECT chunk_id, 'header_only' AS issue FROM state WHERE head_only UNION ALL SELECT chunk_id, 'header_only' FROM state WHERE body_only",
    "citation_validity": """WITH answers AS (SELECT doc_id // 10 AS answer_id, doc_id * 2 AS cited FROM documents),
        known AS (SELECT a.answer_id, a.cited, d.text FROM answers a LEFT JOIN documents d ON d.doc_id = a.cited),
        ids AS (SELECT answer_id, count(*) AS total_citations, count(text) AS valid_ids FROM known GROUP BY answer_id),
        claims AS (SELECT doc_id // 20 AS answer_id, doc_id, translate(substr(text, 1, 12), 'aeht', 'AEHT') AS claim FROM documents WHERE doc_id % 2 = 0),
        found AS (SELECT c.answer_id, c.doc_id, max(coalesce(contains(lower(k.text), lower(c.claim)), false)::INT) AS ok FROM claims c LEFT JOIN known k ON k.answer_id = c.answer_id GROUP BY c.answer_id, c.doc_id),
        per AS (SELECT answer_id, count(*) AS n, sum(ok) AS claims_found FROM found GROUP BY answer_id)
        SELECT coalesce(i.answer_id, p.answer_id) AS answer_id, total_citations, valid_ids, round(CASE WHEN coalesce(total_citations, 0) = 0 THEN 1.0::DOUBLE ELSE valid_ids::DOUBLE / total_citations END, 6) AS id_validity,
            coalesce(claims_found, 0)::BIGINT AS claims_found, round(CASE WHEN coalesce(n, 0) = 0 THEN 1.0::DOUBLE ELSE claims_found::DOUBLE / n END, 6) AS claim_validity FROM ids i FULL JOIN per p ON i.answer_id = p.answer_id""",
    "token_distribution": f"""WITH {CHUNKS} SELECT book, count(*) AS n, round(avg(token_count), 4) AS mean, round(quantile_cont(token_count, 0.5), 4) AS p50, round(quantile_cont(token_count, 0.95), 4) AS p95, max(token_count)::DOUBLE AS max, min(token_count)::DOUBLE AS min,
        round(stddev_pop(token_count), 4) AS std, round(stddev_pop(token_count) / avg(token_count), 4) AS cv, round(sum(token_count)::DOUBLE, 4) AS total FROM chunks GROUP BY book""",
    "latency_stats": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(avg(value), 2) AS mean, round(min(value), 2) AS min, round(max(value), 2) AS max FROM events GROUP BY event_type",
    "bootstrap_ci_hashed": f"""WITH {RESULTS},
        draws AS (SELECT method AS system, event_id, ndcg, unnest(range(1, 101)) AS b FROM results WHERE k = 10),
        u AS (SELECT *, ('0x' || substr(md5(system || ':' || event_id || ':' || b), 1, 8))::BIGINT % 1000000 / 1000000.0::DOUBLE AS u FROM draws),
        w AS (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119], lambda c: u >= c::DOUBLE)) AS n FROM u),
        m AS (SELECT system, b, sum(n * ndcg) / sum(n) AS m FROM w GROUP BY system, b)
        SELECT system, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m GROUP BY system""",
    "holm_bonferroni": f"""WITH {RESULTS},
        p AS (SELECT strategy || '/' || method AS comparison, round(avg(recall), 6) / 50 AS p_value FROM results GROUP BY 1),
        t AS (SELECT comparison, p_value, 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p_value, comparison) + 1) AS threshold FROM p)
        SELECT comparison, round(p_value, 8) AS p_value, round(threshold, 8) AS threshold, p_value < threshold AS significant FROM t""",
    "judge_variance": f"WITH {RESULTS}, t AS (SELECT method, trial, avg(faithfulness) AS m FROM results GROUP BY method, trial) SELECT method, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS trials FROM t GROUP BY method",
    "cohen_kappa": """SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM (
        SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""",
    "gold_build": f"""WITH {GOLD} SELECT query_id, query_type, n, query FROM (SELECT query_id, query_type, array_to_string(terms, ' ') AS query, row_number() OVER (PARTITION BY query_type ORDER BY md5(query_id)) AS n FROM gold)
        WHERE n <= CASE query_type WHEN 'lore' THEN 25 WHEN 'mechanical' THEN 25 WHEN 'tabular' THEN 20 WHEN 'cross_reference' THEN 15 WHEN 'monster' THEN 10 ELSE 5 END""",
    "gold_locate_anchor": f"WITH {GOLD} SELECT query_id, doc_id, char_start, char_end FROM located",
    "gold_distractors": f"WITH {GOLD} SELECT query_id, 'distractor' AS query_type, 'NOT_IN_CORPUS' AS answer FROM (SELECT query_id FROM gold ORDER BY md5(query_id) LIMIT 10)",
    "gold_section_sample": """SELECT doc_id, loc::BIGINT AS section_start, md5(substr(text, loc + 1, 3500)) AS section_md5
        FROM (SELECT doc_id, text, (('0x' || substr(md5('42:' || doc_id || ':1'), 1, 8))::BIGINT % (greatest(0, length(text) - 3500) + 1))::BIGINT AS loc FROM documents)""",
    "gold_validate": f"""WITH {GOLD_ROWS}
        SELECT query_id, 'empty_query' AS issue FROM rows_ WHERE trim(query) = '' UNION ALL SELECT query_id, 'empty_answer' FROM rows_ WHERE trim(answer) = '' UNION ALL SELECT query_id, 'unknown_type' FROM rows_ WHERE query_type = 'riddle'
        UNION ALL SELECT query_id, 'missing_context' FROM rows_ WHERE char_start IS NULL UNION ALL SELECT query_id, 'unreviewed' FROM rows_ WHERE validator = 'auto'
        UNION ALL SELECT r.query_id, 'answer_not_in_span' FROM rows_ r JOIN documents d ON r.doc_id = d.doc_id WHERE char_start > 0 AND NOT contains(lower(substr(d.text, char_start + 1, char_end - char_start)), lower(r.answer))""",
    "gold_type_counts": f"WITH {GOLD} SELECT query_type, count(*) AS n FROM gold GROUP BY query_type",
    "gold_content_hash": f"WITH {GOLD} SELECT substr(sha256(string_agg(query_id || '|' || query_type || '|' || answer, {NL} ORDER BY query_id)), 1, 16) AS content_hash, count(*) AS total FROM gold",
    "gold_review_sheet": f"""WITH {GOLD_ROWS} SELECT r.query_id, query_type, query, answer, md5(coalesce(replace(substr(substr(d.text, char_start + 1, char_end - char_start), 1, 500), {NL}, ' '), '')) AS context_md5
        FROM rows_ r LEFT JOIN documents d ON r.doc_id = d.doc_id""",
    "gold_ingest_reviews": f"WITH {GOLD_ROWS} SELECT query_id, query_type, 'human' AS validator FROM rows_ WHERE n % 5 <> 0 AND n % 13 <> 0",
    "phase1_grid": f"SELECT unnest({names(STRATEGIES)}) AS strategy, 'dense' AS method, 5::BIGINT AS rows",
    "phase2_grid": f"SELECT method, unnest(range(1, CASE WHEN method IN ('hyde', 'query_decomposition') THEN 4 ELSE 2 END)) AS trial, {5 * len(STRATEGIES)}::BIGINT AS rows FROM (SELECT unnest({names(RETRIEVAL_METHODS)}) AS method)",
    "routing_table": f"WITH {RESULTS}, {best("query_type <> 'distractor'")} SELECT query_type, strategy, method, round(mean, 6) AS mean, n FROM best WHERE r = 1",
    "routing_policy": f"""WITH {RESULTS}, {best("query_type <> 'distractor'")},
        single AS (SELECT strategy, method, avg(recall) AS single, avg(recall) FILTER (query_type <> 'distractor') AS same FROM results WHERE k = 10 GROUP BY strategy, method ORDER BY round(avg(recall), 9) DESC, strategy, method LIMIT 1),
        routed AS (SELECT avg(r.recall) AS routed FROM results r JOIN best b ON b.r = 1 AND r.query_type = b.query_type AND r.strategy = b.strategy AND r.method = b.method WHERE r.k = 10)
        SELECT strategy, method, round(single, 4) AS single, round(same, 4) AS single_same_rows, round(routed, 4) AS routed, round(routed - single, 4) AS lift FROM single, routed""",
    "report_summary": f"""WITH {RESULTS} SELECT count(*) AS total_rows, array_to_string(list_sort(list(DISTINCT strategy)), ',') AS strategies, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods,
        array_to_string(list_sort(list(DISTINCT query_type)), ',') AS query_types FROM results""",
    "report_pivot_recall": pivoted("recall"),
    "report_pivot_ndcg": pivoted("ndcg"),
    "report_recall_curves": mean_of("recall", "strategy, method, k"),
    "report_mrr": mean_of("mrr", "strategy, method"),
    "report_hit_curves": mean_of("hit", "strategy, k", "method = 'hybrid_rrf'"),
    "report_best_per_type": f"WITH {RESULTS}, {best('true')} SELECT query_type, strategy, method, round(mean, 4) AS mean FROM best WHERE r = 1",
    "report_verdict": f"""WITH {RESULTS},
        m AS (SELECT method, strategy, avg(recall) AS m FROM results WHERE k = 10 AND query_type <> 'distractor' GROUP BY method, strategy),
        p AS (SELECT max(m) FILTER (method = 'dense') - min(m) FILTER (method = 'dense') AS s1, max(m) FILTER (method = 'hybrid_rerank') - min(m) FILTER (method = 'hybrid_rerank') AS s2,
                     coalesce(max(m) FILTER (method = 'dense' AND strategy = 'contextual'), 0) AS c, coalesce(max(m) FILTER (method = 'dense' AND strategy = 'adaptive'), 0) AS a, coalesce(max(m) FILTER (method = 'dense' AND strategy = 'recursive'), 0) AS r,
                     coalesce(max(m) FILTER (method = 'dense' AND strategy = 'markdown_hierarchical'), 0) AS h, arg_max(strategy, m) FILTER (method = 'dense') AS top FROM m),
        v AS (SELECT *, CASE WHEN s1 IS NULL THEN 'insufficient data' WHEN s2 IS NULL THEN 'missing' WHEN s2 < 0.02 AND s1 >= 0.02 THEN 'B' WHEN c > a + 0.03 AND top = 'contextual' THEN 'A' WHEN abs(c - a) < 0.02 AND a >= greatest(r, h) THEN 'D' ELSE 'C' END AS verdict FROM p)
        SELECT verdict, round(s1, 4) AS dense_spread, round(s2, 4) AS rerank_spread,
            CASE verdict WHEN 'A' THEN 'contextual chunking' WHEN 'B' THEN 'any chunking with reranking' WHEN 'C' THEN 'the best measured configuration' WHEN 'D' THEN 'adaptive chunking' ELSE '' END AS recommendation FROM v""",
    "cost_by_model": f"WITH {PRICED} SELECT model, count(*) AS calls, round(sum(cost), 6) AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM priced GROUP BY model",
    "cost_by_stage": f"WITH {PRICED} SELECT stage, count(*) AS calls, round(sum(cost), 6) AS cost_usd, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM priced GROUP BY stage",
    "budget_check": f"WITH {PRICED}, s AS (SELECT stage, sum(cost) AS spent, CASE stage WHEN 'click' THEN 0.5::DOUBLE WHEN 'purchase' THEN 100.0::DOUBLE END AS budget FROM priced GROUP BY stage) SELECT stage, round(spent, 6) AS spent, budget, coalesce(spent > budget, false) AS exceeded FROM s",
    "cache_hit_rate": "SELECT event_type AS namespace, count(*) AS requests, sum(((event_id % 50) % 3 = 0)::INT)::BIGINT AS hits, round(avg(((event_id % 50) % 3 = 0)::INT), 4) AS hit_rate FROM events GROUP BY event_type",
    "run_log_summary": "SELECT event_type AS stage, count(*) AS runs, round(sum(value), 4) AS seconds, round(max(value), 4) AS longest FROM events GROUP BY event_type",
}
