"""The same results as plain SQL, for checking. Not used by the library itself."""

from __future__ import annotations

from presswork.functions.text import BLANKS
from presswork.operators.retrieval import NOTHING_FOUND, SYSTEM_PROMPT

# Fixture tables of ``fixtures.py``.
PRELUDE = r"""
categories AS (
  SELECT * FROM (VALUES (1,'en'),(2,'de'),(3,'es'),(4,'fr')) t(category_id, name)),
news_sources AS (
  SELECT CAST(dense_rank() OVER (ORDER BY source, lang) AS INT) AS source_id,
         category_id, source || '_' || lang AS name
  FROM (SELECT DISTINCT source, lang FROM documents) d
  JOIN categories c ON d.lang = c.name),
articles AS (
  SELECT doc_id AS article_id, s.source_id, s.category_id,
         'Report ' || doc_id || ' by ' || source AS title, text AS description,
         'http://news.example/' || doc_id AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 104729) % 2592000) AS published_at,
         doc_id % 11 <> 0 AS is_processed,
         doc_id % 40 >= 12 AS is_duplicate,
         CASE WHEN doc_id % 40 >= 28 THEN doc_id - doc_id % 40
              WHEN doc_id % 40 >= 12 THEN doc_id - doc_id % 40 + doc_id % 4 END AS representative_id
  FROM documents d JOIN news_sources s ON s.name = d.source || '_' || d.lang),
article_chunks AS (
  SELECT vec_id AS chunk_id, vec_id // 2 AS article_id, CAST(vec_id % 2 AS INT) AS chunk_index,
         coalesce(d.text, 'passage ' || vec_id) AS content,
         CASE WHEN vec_id % 50 <> 49 THEN embedding END AS embedding
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id // 2),
users AS (SELECT DISTINCT user_id FROM events),
prefs AS (
  SELECT user_id * 10 + category_id AS pref_id, user_id, category_id,
         CAST(1 + (user_id * category_id * 3 + category_id * 7) % 10 AS INT) AS weight
  FROM users CROSS JOIN categories
  WHERE user_id % 7 <> 0 AND (user_id + category_id) % 5 <> 0),
seen AS (
  SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM documents) AS article_id
  FROM events WHERE event_type = 'view'),
chat_history AS (
  SELECT conv_id * 1000 + turn AS chat_id, CAST(conv_id AS VARCHAR) AS session_id, role,
         text AS message,
         TIMESTAMP '2024-01-29 00:00:00' + to_seconds((conv_id * 104729) % 259200 + turn * 60)
           AS created_at
  FROM conversations),
chat_sessions AS (
  SELECT session_id, CAST(session_id AS BIGINT) % 15 AS user_id,
         min(created_at) AS created_at, max(created_at) AS updated_at
  FROM chat_history GROUP BY session_id),
feed_items AS (
  SELECT article_id AS item_id, source_id, category_id,
         CASE WHEN article_id % 17 = 0 THEN '' ELSE '<b>' || title || '</b>' END AS title,
         CASE WHEN article_id % 23 = 0 THEN '' ELSE ' <p>' || description || '</p>' || chr(10) END
           AS summary,
         CASE WHEN article_id % 5 = 0 THEN '<div>' || description || '</div>' END AS content,
         'http://news.example/'
           || CASE WHEN article_id % 10 = 9 THEN article_id - 9 ELSE article_id END AS link,
         CASE WHEN article_id % 19 = 0 THEN 'yesterday'
              ELSE 'Mon, ' || strftime(published_at, '%d %b %Y %H:%M:%S') || ' +0900' END
           AS published
  FROM articles),
named AS (
  SELECT a.*, c.name AS category_name, split_part(s.name, '_', 1) AS source_name,
         s.name AS full_source_name
  FROM articles a JOIN categories c USING (category_id)
  JOIN news_sources s ON s.source_id = a.source_id),
servable AS (SELECT * FROM named WHERE NOT is_duplicate AND is_processed)
"""


def _ago(published: str, as_of: str = "TIMESTAMP '2024-01-31 00:00:00'") -> str:
    minutes = f"CAST(trunc((epoch({as_of}) - epoch({published})) / 60) AS BIGINT)"
    return (
        f"CASE WHEN {published} IS NULL THEN '' WHEN {minutes} < 1 THEN '방금 전' "
        f"WHEN {minutes} < 60 THEN {minutes} || '분 전' "
        f"WHEN {minutes} < 1440 THEN ({minutes} // 60) || '시간 전' "
        f"ELSE ({minutes} // 1440) || '일 전' END"
    )


def _card(press="NULL", similarity="CAST(NULL AS DOUBLE)", weight="NULL"):
    # Whole numbers that may be NULL are compared as text, here and below.
    return (
        "article_id, title, description, url, "
        "strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, "
        f"{_ago('published_at')} AS published_ago, category_name, source_name, "
        f"CAST({press} AS VARCHAR) AS press_count, {similarity} AS similarity, "
        f"CAST({weight} AS VARCHAR) AS category_weight"
    )


def _with(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {','.join([PRELUDE, *ctes])}\n{body}"


# N2: slots per (user, category).
_ALLOCATION = """
weighted AS (
  SELECT user_id, category_id, weight,
         row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, category_id) AS pref_rank,
         count(*) OVER (PARTITION BY user_id) AS n,
         greatest(1, round_even({limit} * CAST(weight AS DOUBLE)
                                / sum(weight) OVER (PARTITION BY user_id), 0)) AS share
  FROM prefs),
alloc AS (
  SELECT user_id, category_id, weight, CAST(pref_rank AS INT) AS pref_rank,
         CAST(CASE WHEN pref_rank < n THEN share
              ELSE greatest(0, {limit} - coalesce(sum(CASE WHEN pref_rank < n THEN share END)
                                              OVER (PARTITION BY user_id), 0)) END AS INT) AS slots
  FROM weighted)"""

_RECOMMEND = """
pool AS (
  SELECT a.user_id, a.weight, a.pref_rank, a.slots, s.*,
         row_number() OVER (PARTITION BY a.user_id, a.category_id
                            ORDER BY s.published_at DESC, s.article_id) - {offset} AS bucket_rank
  FROM alloc a JOIN servable s ON s.category_id = a.category_id {unseen}),
newest AS (
  SELECT *, row_number() OVER (ORDER BY published_at DESC, article_id) - {offset} AS bucket_rank
  FROM servable),
picked AS (
  SELECT user_id, weight, pref_rank, bucket_rank, article_id, title, description, url,
         published_at, category_name, source_name
  FROM pool WHERE bucket_rank BETWEEN 1 AND slots
  UNION ALL
  SELECT u.user_id, NULL, 1, bucket_rank, article_id, title, description, url, published_at,
         category_name, source_name
  FROM users u JOIN newest n ON n.bucket_rank BETWEEN 1 AND {limit}
  WHERE u.user_id NOT IN (SELECT user_id FROM prefs))"""


def _recommend(limit: int, offset: int, unseen: str = "") -> str:
    position = (
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY bucket_rank, pref_rank) AS INT)"
    )
    return _with(
        f"SELECT user_id, {position} AS position, {_card(weight='weight')} FROM picked",
        _ALLOCATION.format(limit=limit),
        _RECOMMEND.format(limit=limit, offset=offset, unseen=unseen),
    )


def feeds() -> dict[str, str]:
    unseen = (
        "WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = a.user_id"
        " AND seen.article_id = s.article_id)"
    )
    return {
        "latest_feed": _with(
            f"SELECT {_card()} FROM servable ORDER BY servable.published_at DESC, article_id LIMIT 20"
        ),
        "latest_feed_by_category": _with(
            f"SELECT {_card()} FROM servable WHERE category_id = 2 "
            "ORDER BY servable.published_at DESC, article_id LIMIT 5 OFFSET 5"
        ),
        "trending": _with(
            f"SELECT {_card(press='press')} FROM story "
            "ORDER BY press DESC, story.published_at DESC, article_id LIMIT 9",
            """story AS (
  SELECT s.*, (SELECT count(*) FROM articles d WHERE d.representative_id = s.article_id) + 1
           AS press
  FROM servable s WHERE published_at > TIMESTAMP '2024-01-30 00:00:00')""",
        ),
        "other_press": _with(
            f"""SELECT representative_id, article_id, title, url, source_name,
  {_ago('published_at')} AS published_ago
FROM (SELECT *, row_number() OVER (PARTITION BY representative_id, source_name
                                   ORDER BY published_at DESC, article_id) AS rn
      FROM named WHERE representative_id IS NOT NULL) WHERE rn = 1"""
        ),
        "new_since_cursor": _with(
            f"""SELECT user_id, {_card(weight='weight')}
FROM prefs JOIN servable USING (category_id)
WHERE servable.published_at > TIMESTAMP '2024-01-30 00:00:00'"""
        ),
        "merge_live_feed": _with(
            """SELECT user_id, article_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, place) AS INT) AS position
FROM (SELECT user_id, article_id, 1 AS part, place FROM arrived
      WHERE (user_id, article_id) NOT IN (SELECT user_id, article_id FROM shown)
      UNION ALL SELECT user_id, article_id, 2, place FROM shown)""",
            _ALLOCATION.format(limit=12),
            _RECOMMEND.format(limit=12, offset=0, unseen=""),
            """shown AS (
  SELECT user_id, article_id,
         row_number() OVER (PARTITION BY user_id ORDER BY bucket_rank, pref_rank) AS place
  FROM picked),
arrived AS (
  SELECT user_id, article_id,
         row_number() OVER (PARTITION BY user_id ORDER BY published_at DESC, article_id) AS place
  FROM prefs JOIN servable USING (category_id)
  WHERE published_at > TIMESTAMP '2024-01-30 00:00:00')""",
        ),
        "published_ago": _with(
            f"SELECT article_id, {_ago('published_at')} AS published_ago FROM articles"
        ),
        "recommend_allocation": _with("SELECT * FROM alloc", _ALLOCATION.format(limit=12)),
        "recommend": _recommend(12, 0),
        "recommend_page2": _recommend(12, 12),
        "recommend_excluding_seen": _recommend(12, 0, unseen),
    }


_B = BLANKS.replace("'", "''")
_BLANK_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in BLANKS) + "]+"


def _strip(x: str) -> str:
    return f"trim({x}, '{_B}')"


def _clean(x: str) -> str:
    return _strip(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')")


_PARSED = f"""
parsed AS (
  SELECT item_id, source_id, category_id, {_clean('title')} AS title,
         CASE WHEN source_id % 2 = 0 THEN {_clean('coalesce(content, summary)')}
              ELSE {_clean('summary')} END AS description,
         link AS url,
         TRY_CAST(try_strptime(substr(published, 6, 20), '%d %b %Y %H:%M:%S') AS TIMESTAMP)
           AS published_at
  FROM feed_items),
judged AS (
  SELECT *, CASE WHEN title = '' OR url = '' OR published_at IS NULL THEN 'missing field'
                 WHEN length({_strip('description')}) < 50 THEN 'short description' END
            AS reject_reason
  FROM parsed)"""

_NEW_COLUMNS = """url, title, description, source_id, category_id, published_at,
  false AS is_processed, false AS is_duplicate, CAST(NULL AS VARCHAR) AS representative_id,
  TIMESTAMP '2024-01-31' AS created_at"""


def _insert(order: str, stored: str, base: str) -> str:
    return f"""
fresh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {order}) AS nth
                 FROM judged WHERE reject_reason IS NULL)
  WHERE nth = 1 AND url NOT IN ({stored})),
inserted AS (
  SELECT {base} + row_number() OVER (ORDER BY md5(url), url) AS article_id, {_NEW_COLUMNS}
  FROM fresh)"""


_INSERT = _insert(
    "item_id",
    "SELECT url FROM articles WHERE published_at < TIMESTAMP '2024-01-15'",
    "(SELECT max(article_id) FROM articles WHERE published_at < TIMESTAMP '2024-01-15')",
)

_CHUNKED = f"""
split AS (
  SELECT article_id, list_filter(string_split(regexp_replace(
           {_strip("title || '. ' || description")},
           '([.!?。]){_BLANK_RUN}', '\\1' || chr(57344), 'g'), chr(57344)),
           lambda x: x <> '') AS sentences
  FROM articles),
folded AS (
  SELECT article_id, list_reduce(
    list_prepend({{'done': CAST([] AS VARCHAR[]), 'cur': ''}},
      list_transform(sentences, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x}})),
    lambda acc, x: CASE
      WHEN length(x.cur) > 200 THEN {{
        'done': list_concat(
          CASE WHEN acc.cur = '' THEN acc.done ELSE list_append(acc.done, acc.cur) END,
          list_filter(list_transform(range(0, length(x.cur), 170),
            lambda i: {_strip('substr(x.cur, i + 1, 200)')}), lambda w: w <> '')),
        'cur': ''}}
      WHEN length(acc.cur) + length(x.cur) + 1 > 200 THEN {{
        'done': CASE WHEN acc.cur = '' THEN acc.done ELSE list_append(acc.done, acc.cur) END,
        'cur': CASE WHEN acc.cur = '' THEN x.cur
                    ELSE {_strip("right(acc.cur, 30) || ' ' || x.cur")} END}}
      ELSE {{'done': acc.done,
            'cur': CASE WHEN acc.cur = '' THEN x.cur ELSE acc.cur || ' ' || x.cur END}} END
    ) AS s
  FROM split WHERE len(sentences) > 0),
pieces AS (
  SELECT article_id, CASE WHEN s.cur = '' THEN s.done ELSE list_append(s.done, s.cur) END AS p
  FROM folded),
numbered AS (SELECT article_id, p, unnest(range(0, len(p))) AS i FROM pieces),
chunked AS (
  SELECT article_id, CAST(i AS INT) AS chunk_index, p[i + 1] AS content
  FROM numbered WHERE length(p[i + 1]) > 10),
waiting AS (
  SELECT * FROM articles WHERE NOT is_processed AND NOT is_duplicate
    AND description IS NOT NULL AND length(description) >= 20)"""



def _letters(text: str) -> str:
    """Characters by code point modulo 64, the encoder of the runs that are compared."""
    return (
        f"list_transform(range(64), lambda k: CAST(len(list_filter(string_split({text}, ''), "
        "lambda c: unicode(c) % 64 = k)) AS DOUBLE))"
    )


_APPENDED = """
appended AS (
  SELECT *, (SELECT max(chunk_id) FROM article_chunks)
    + row_number() OVER (ORDER BY md5(article_id || chr(31) || chunk_index), article_id, chunk_index)
      AS chunk_id, TIMESTAMP '2024-01-31' AS created_at
  FROM chunked WHERE article_id IN (SELECT article_id FROM waiting)
    AND (article_id, chunk_index) NOT IN (SELECT article_id, chunk_index FROM article_chunks))"""

_COMPARED_HOURLY = f"""
first_vectors AS (
  SELECT article_id, CAST(embedding AS DOUBLE[]) AS vec FROM article_chunks
  WHERE chunk_index = 0 AND embedding IS NOT NULL
  UNION ALL
  SELECT article_id, {_letters('content')} FROM appended WHERE chunk_index = 0),
cand AS (
  SELECT a.article_id, a.category_id, a.source_id, a.published_at, f.vec,
         row_number() OVER (PARTITION BY a.category_id ORDER BY a.published_at, a.article_id) AS rn
  FROM articles a JOIN first_vectors f ON f.article_id = a.article_id
  WHERE (a.is_processed OR a.article_id IN (SELECT article_id FROM waiting)) AND NOT a.is_duplicate
    AND a.published_at > TIMESTAMP '2024-01-31' - INTERVAL 744 HOUR)"""

_COMPARED = """
cand AS (
  SELECT a.article_id, a.category_id, a.source_id, a.published_at,
         CAST(c.embedding AS DOUBLE[]) AS vec,
         row_number() OVER (PARTITION BY a.category_id ORDER BY a.published_at, a.article_id) AS rn
  FROM articles a JOIN article_chunks c
    ON c.article_id = a.article_id AND c.chunk_index = 0 AND c.embedding IS NOT NULL)"""

# The election one article at a time, carrying the representatives so far.
_ELECTED = """
steps AS (
  SELECT category_id, rn, article_id, CAST(NULL AS BIGINT) AS rep, CAST(NULL AS DOUBLE[]) AS rep_vec,
         vec, [{'id': article_id, 'src': source_id, 'vec': vec}] AS reps
  FROM cand WHERE rn = 1
  UNION ALL
  SELECT category_id, rn, article_id, hit.id, hit.vec, vec,
         CASE WHEN hit IS NULL THEN list_append(reps, me) ELSE reps END
  FROM (SELECT c.category_id, c.rn, c.article_id, c.vec, s.reps,
               {'id': c.article_id, 'src': c.source_id, 'vec': c.vec} AS me,
               list_filter(s.reps, lambda r: r.src <> c.source_id
                 AND list_cosine_similarity(r.vec, c.vec) >= 0.3)[1] AS hit
        FROM steps s JOIN cand c ON c.category_id = s.category_id AND c.rn = s.rn + 1)),
elected AS (
  SELECT article_id AS duplicate_id, rep AS representative_id,
         list_cosine_similarity(rep_vec, vec) AS similarity
  FROM steps WHERE rep IS NOT NULL),
flagged AS (
  SELECT a.article_id, a.is_duplicate OR e.duplicate_id IS NOT NULL AS is_duplicate,
         CASE WHEN NOT a.is_duplicate AND e.duplicate_id IS NOT NULL THEN e.representative_id
              ELSE a.representative_id END AS representative_id
  FROM articles a LEFT JOIN elected e ON e.duplicate_id = a.article_id)"""


def _retrieved(questions: str) -> str:
    return f"""
asked AS ({questions}),
scored AS (
  SELECT q.query_id, ac.chunk_id, ac.content, s.article_id, s.title, s.url, s.published_at,
         s.category_name, s.full_source_name AS source_name,
         list_cosine_similarity(CAST(ac.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))
           AS similarity,
         coalesce(p.weight, 5) AS weight
  FROM asked q, article_chunks ac JOIN servable s ON s.article_id = ac.article_id
  LEFT JOIN prefs p ON p.category_id = s.category_id AND p.user_id = q.user_id
  WHERE ac.embedding IS NOT NULL),
blended AS (
  SELECT *, similarity * 0.7 + CAST(weight AS DOUBLE) / 10 * 0.2
            + epoch(published_at) / epoch(TIMESTAMP '2024-01-31') * 0.1 AS score
  FROM scored),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT)
              AS rank FROM blended),
best AS (SELECT * FROM ranked WHERE rank <= 5)"""


_EVERY_VECTOR = "SELECT vec_id AS query_id, vec_id AS user_id, embedding AS vector FROM embeddings"
_QUESTIONS = """
questions AS (
  SELECT CAST(session_id AS BIGINT) AS query_id, session_id,
         CAST(session_id AS BIGINT) % 15 AS user_id,
         arg_max(message, created_at) AS question, any_value(e.embedding) AS vector
  FROM chat_history h JOIN embeddings e ON e.vec_id = CAST(h.session_id AS BIGINT)
  WHERE role = 'user' GROUP BY session_id)"""


def collection() -> dict[str, str]:
    return {
        "clean_html_pages": f"SELECT page_id, {_clean('html')} AS text FROM pages",
        "parse_feed_dates": _with("SELECT item_id, published_at FROM parsed", _PARSED),
        "ingest_rss_items": _with(
            "SELECT source_id, category_id, title, description, url, published_at FROM parsed",
            _PARSED,
        ),
        "ingest_validate": _with("SELECT item_id, reject_reason FROM judged", _PARSED),
        "insert_if_absent": _with("SELECT * FROM inserted", _PARSED, _INSERT),
        "ingest_stats": _with(
            """SELECT source_id, total, coalesce(saved, 0) AS saved,
  total - coalesce(saved, 0) AS skipped
FROM (SELECT source_id, count(*) AS total FROM judged GROUP BY source_id)
LEFT JOIN (SELECT source_id, count(*) AS saved FROM inserted GROUP BY source_id)
USING (source_id)""",
            _PARSED,
            _INSERT,
        ),
        "synth_articles": _with(
            """SELECT source_id, category_id,
  ['Budget talks continue', 'Exports rise again', 'Rain closes mountain roads'][n * 31 % 3 + 1]
    || ' ' || (n + 1) AS title,
  ['Negotiators met again today and said that they expect a result by the end of the week.',
   'Analysts call the figures solid and look for a quiet market in the coming days.'][n * 17 % 2 + 1]
    AS description,
  'https://dummy-news.com/article/' || (n + 1) AS url,
  TIMESTAMP '2024-01-01' + to_seconds(n * 104729 % 2592000) AS published_at
FROM (SELECT unnest(range((SELECT count(*) FROM articles), 2 * (SELECT count(*) FROM articles))) AS n)
JOIN news_sources ON source_id - 1 = n * 7919 % (SELECT count(*) FROM news_sources)"""
        ),
        "unprocessed_count": _with("SELECT count(*) AS n_unprocessed FROM waiting", _CHUNKED),
        "partition_bounds": _with(
            "SELECT min(article_id) AS min_id, max(article_id) AS max_id, count(*) AS n_articles "
            "FROM waiting",
            _CHUNKED,
        ),
        "newest_unprocessed": _with(
            "SELECT article_id, published_at FROM waiting "
            "ORDER BY published_at DESC, article_id LIMIT 5000",
            _CHUNKED,
        ),
        "newest_unprocessed_cut": _with(
            "SELECT article_id, published_at FROM waiting "
            "ORDER BY published_at DESC, article_id LIMIT 10",
            _CHUNKED,
        ),
        "chunk_documents": _with("SELECT * FROM chunked", _CHUNKED),
        "embed_chunks": _with(
            "SELECT article_id, chunk_index, 768 AS dimensions, 1.0::DOUBLE AS norm FROM chunked",
            _CHUNKED,
        ),
        "append_chunks": _with("SELECT * FROM appended", _CHUNKED, _APPENDED),
        "mark_processed": _with(
            """SELECT article_id, is_duplicate,
  is_processed OR article_id IN (SELECT article_id FROM waiting) AS is_processed FROM articles""",
            _CHUNKED,
        ),
        "embedding_backlog": _with(
            f"""SELECT chunk_id, 64 AS dimensions, 1.0::DOUBLE AS norm,
  round(list_sum(list_transform(v, lambda x, i: x * i))
        / sqrt(list_sum(list_transform(v, lambda x: x * x))), 2) AS weighted
FROM (SELECT chunk_id, CASE WHEN embedding IS NOT NULL THEN CAST(embedding AS DOUBLE[])
                            ELSE {_letters('content')} END AS v FROM article_chunks)"""
        ),
        "parse_embedding": """
SELECT vec_id, CAST(i AS INT) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings
      WHERE vec_id % 7 NOT IN (3, 5))""",
        "normalize_vectors": """
SELECT vec_id, CAST(i AS INT) AS pos,
  round(CAST(embedding[i + 1] AS DOUBLE)
        / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5)
    + 0.0::DOUBLE AS value
FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
    }


def duplicates() -> dict[str, str]:
    def elected(body):
        return _with(body, _COMPARED, _ELECTED, recursive=True)

    return {
        "dedup_candidates": _with(
            """SELECT a.article_id, a.category_id, a.source_id, a.published_at
FROM articles a JOIN article_chunks c
  ON c.article_id = a.article_id AND c.chunk_index = 0 AND c.embedding IS NOT NULL
WHERE a.is_processed AND NOT a.is_duplicate
  AND a.published_at > TIMESTAMP '2024-01-31' - INTERVAL 744 HOUR"""
        ),
        "similar_pairs": _with(
            """SELECT article_id, arg_min(other, place) AS first_similar_id,
  round(arg_min(sim, place), 4) AS similarity
FROM (SELECT c.article_id, e.article_id AS other, e.rn AS place,
             list_cosine_similarity(c.vec, e.vec) AS sim
      FROM cand c JOIN cand e ON e.category_id = c.category_id AND e.rn < c.rn
        AND e.source_id <> c.source_id)
WHERE sim >= 0.3 GROUP BY article_id""",
            _COMPARED,
        ),
        "elect_duplicates": elected(
            "SELECT duplicate_id, representative_id, round(similarity, 4) AS similarity FROM elected"
        ),
        "dedup_stats": elected(
            """SELECT category_id, count(*) AS n_compared, count(duplicate_id) AS n_duplicates
FROM cand LEFT JOIN elected ON duplicate_id = article_id GROUP BY category_id"""
        ),
        "hourly_run": _with(
            """SELECT f.article_id, f.is_duplicate,
  CAST(f.representative_id AS VARCHAR) AS representative_id,
  a.is_processed OR a.article_id IN (SELECT article_id FROM waiting) AS is_processed,
  CAST(n_new AS VARCHAR) AS n_new, CAST(first_new AS VARCHAR) AS first_new,
  CAST(new_length AS VARCHAR) AS new_length
FROM flagged f JOIN articles a USING (article_id)
LEFT JOIN (SELECT article_id, count(*) AS n_new, min(chunk_id) AS first_new,
                  sum(length(content)) AS new_length FROM appended GROUP BY article_id)
  USING (article_id)""",
            _CHUNKED,
            _APPENDED,
            _COMPARED_HOURLY,
            _ELECTED,
            recursive=True,
        ),
        "apply_duplicates": elected(
            "SELECT * REPLACE (CAST(representative_id AS VARCHAR) AS representative_id) FROM flagged"
        ),
        "audit_rep_chains": elected(
            """SELECT f.representative_id, count(*) AS n_followers,
  any_value(r.representative_id) AS next_representative_id
FROM flagged f JOIN flagged r ON r.article_id = f.representative_id AND r.is_duplicate
GROUP BY f.representative_id"""
        ),
    }


def retrieval_and_chat() -> dict[str, str]:
    every = _retrieved(_EVERY_VECTOR)
    last = """SELECT chat_id, session_id, role, message, created_at,
  CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, chat_id) AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY session_id
                                   ORDER BY created_at DESC, chat_id DESC) AS rn
      FROM chat_history) WHERE rn <= {n}"""
    system = SYSTEM_PROMPT.replace("'", "''")
    return {
        "retrieve_topk": _with(
            """SELECT query_id, rank, chunk_id, article_id, title, category_name, source_name,
  round(similarity, 4) AS similarity, round(score, 4) AS score FROM best""",
            every,
        ),
        "answer_sources": _with(
            """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT)
  AS rank, article_id, title, url, source_name, round_even(similarity, 3) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY rank) AS nth
      FROM best) WHERE nth = 1""",
            every,
        ),
        "prompt_context": _with(
            f"""SELECT q.session_id,
  CASE WHEN context IS NOT NULL THEN '[SYSTEM]' || chr(10) || '{system}' || context
    || coalesce(chr(10) || chr(10) || turns, '')
    || chr(10) || chr(10) || '[USER]' || chr(10) || question END AS prompt,
  CASE WHEN context IS NULL THEN '{NOTHING_FOUND}' END AS reply
FROM questions q
LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] ' || title || ' (' || source_name || ', '
             || strftime(published_at, '%Y-%m-%d') || ')' || chr(10) || content,
             chr(10) || chr(10) ORDER BY rank) AS context FROM best GROUP BY query_id) b
  ON b.query_id = q.query_id
LEFT JOIN (SELECT session_id, string_agg('[' || upper(role) || ']' || chr(10) || message,
             chr(10) || chr(10) ORDER BY position) AS turns
           FROM ({last.format(n=6)}) GROUP BY session_id) t ON t.session_id = q.session_id""",
            _QUESTIONS,
            _retrieved("SELECT query_id, user_id, vector FROM questions"),
        ),
        "chat_history_last_n": _with(last.format(n=6)),
        "chat_history_shown": _with(last.format(n=50)),
        "chat_history_cut": _with(last.format(n=4)),
        "chat_turn_batch": _with(
            """SELECT (SELECT max(chat_id) FROM chat_history) + row_number() OVER (
    ORDER BY md5(session_id || chr(31) || '2024-01-31 12:00:00' || chr(31) || 'user' || chr(31) || question)) AS chat_id,
  session_id, 'user' AS role, question AS message, TIMESTAMP '2024-01-31 12:00:00' AS created_at
FROM questions""",
            _QUESTIONS,
        ),
        "chat_turn_closed": _with(
            """SELECT CAST(row_number() OVER (ORDER BY md5(chat_id || chr(31) || rank), chat_id, rank) AS BIGINT) AS id,
  chat_id, session_id, 'assistant' AS role, message, rank,
  query_id * 2 + rank AS article_id, CAST(1 AS DOUBLE) / rank AS similarity
FROM numbered CROSS JOIN (VALUES (1), (2)) AS r(rank)""",
            _QUESTIONS,
            """turns AS (
  SELECT query_id + extra AS query_id, session_id, 'answer ' || (query_id + extra) AS message
  FROM questions CROSS JOIN (VALUES (0), (1000000)) AS e(extra)),
numbered AS (
  SELECT *, (SELECT max(chat_id) FROM chat_history) + row_number() OVER (
    ORDER BY md5(session_id || chr(31) || '2024-01-31 12:00:00' || chr(31) || 'assistant'
                 || chr(31) || query_id), session_id, query_id) AS chat_id
  FROM turns)""",
        ),
        "upsert_sessions": _with(
            """SELECT session_id, min(created_at) AS created_at, max(created_at) AS updated_at,
  CAST(session_id AS BIGINT) % 15
    + CASE WHEN min(created_at) < TIMESTAMP '2024-01-30' THEN 0 ELSE 100 END AS user_id
FROM chat_history GROUP BY session_id"""
        ),
        "user_sessions": _with("SELECT * FROM chat_sessions ORDER BY user_id, updated_at DESC"),
        "session_groups": _with(
            """SELECT user_id, session_id, substr(session_id, 1, 8) AS short_id,
  CASE WHEN updated_at >= TIMESTAMP '2024-01-31' THEN '오늘'
       WHEN updated_at >= TIMESTAMP '2024-01-30' THEN '어제' ELSE '이전' END AS date_group
FROM chat_sessions"""
        ),
        "user_prefs": _with(
            """SELECT user_id, pref_id, category_id, name AS category_name, weight
FROM prefs JOIN categories USING (category_id)"""
        ),
        "upsert_prefs": _with(
            """SELECT p.pref_id, p.user_id, p.category_id, coalesce(l.weight, p.weight) AS weight,
  TIMESTAMP '2024-01-30' AS created_at
FROM prefs p LEFT JOIN latest l USING (user_id, category_id)
UNION ALL
SELECT (SELECT max(pref_id) FROM prefs) + row_number() OVER (
    ORDER BY md5(user_id || chr(31) || category_id), user_id, category_id),
  user_id, category_id, weight, TIMESTAMP '2024-01-31'
FROM latest WHERE (user_id, category_id) NOT IN (SELECT user_id, category_id FROM prefs)""",
            """latest AS (
  SELECT user_id, CAST(1 + event_id % 4 AS INT) AS category_id,
         CAST(arg_max(1 + event_id % 10, event_id) AS INT) AS weight
  FROM events WHERE event_type = 'click' GROUP BY user_id, 1 + event_id % 4)""",
        ),
    }


# The tables with planted violations, and what each constraint must find in them.
_BROKEN = """
b_categories AS (
  SELECT category_id, name FROM categories
  UNION ALL VALUES (1, 'xx'), (9, 'de'), (8, NULL)),
b_news_sources AS (
  SELECT source_id, CASE WHEN source_id % 13 = 0 THEN 99 ELSE category_id END AS category_id, name,
         CASE WHEN source_id % 7 <> 0 THEN 'http://feeds.example/' || (source_id - source_id % 2) END AS rss_url
  FROM news_sources),
b_articles AS (
  SELECT article_id, CASE WHEN article_id % 83 = 0 THEN 0 ELSE source_id END AS source_id,
         CASE WHEN article_id % 71 = 0 THEN 77 ELSE category_id END AS category_id,
         CASE WHEN article_id % 89 <> 0 THEN title END AS title,
         CASE WHEN article_id % 10 = 9 THEN 'http://news.example/again' ELSE url END AS url,
         CASE WHEN article_id % 97 <> 0 THEN published_at END AS published_at,
         CASE WHEN article_id % 67 = 0 THEN -1 ELSE representative_id END AS representative_id
  FROM articles),
b_article_chunks AS (
  SELECT CASE WHEN chunk_id % 53 = 0 THEN 1 ELSE chunk_id END AS chunk_id,
         CASE WHEN chunk_id % 61 = 0 THEN 1000000000 ELSE article_id END AS article_id, chunk_index,
         CASE WHEN chunk_id % 59 <> 0 THEN content END AS content
  FROM article_chunks),
b_users AS (
  SELECT user_id, 'u' || (user_id - user_id % 3) AS email,
         CASE WHEN user_id % 11 <> 0 THEN '-' END AS password_hash FROM users),
b_user_category_prefs AS (
  SELECT pref_id, CASE WHEN pref_id % 43 = 0 THEN 1000000000 ELSE user_id END AS user_id,
         CASE WHEN pref_id % 47 = 0 THEN 80 ELSE category_id END AS category_id,
         CASE WHEN pref_id % 37 = 0 THEN 11 ELSE weight END AS weight
  FROM (SELECT * FROM prefs UNION ALL
        SELECT pref_id + 1000000, user_id, category_id, weight FROM prefs WHERE pref_id % 41 = 0)),
b_chat_sessions AS (
  SELECT session_id, CASE WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN -5 ELSE user_id END AS user_id
  FROM chat_sessions),
b_chat_history AS (
  SELECT chat_id, CASE WHEN chat_id % 53 = 0 THEN 'gone' ELSE session_id END AS session_id,
         CASE WHEN chat_id % 29 <> 0 THEN role END AS role, message, created_at
  FROM chat_history),
b_chat_sources AS (
  SELECT chat_id AS id, CASE WHEN chat_id % 31 = 0 THEN -1 ELSE chat_id END AS chat_id,
         chat_id % 2000 AS article_id, 1 AS rank, CASE WHEN chat_id % 23 <> 0 THEN 0.5 END AS similarity
  FROM chat_history)"""

_REQUIRED = {
    "categories": "category_id name",
    "news_sources": "source_id category_id name rss_url",
    "articles": "article_id source_id category_id title url published_at",
    "article_chunks": "chunk_id article_id chunk_index content",
    "users": "user_id email password_hash",
    "user_category_prefs": "pref_id user_id category_id weight",
    "chat_sessions": "session_id user_id",
    "chat_history": "chat_id session_id role message",
    "chat_sources": "id chat_id article_id rank similarity",
}
_KEYS = """categories.category_id categories.name news_sources.source_id news_sources.rss_url
articles.article_id articles.url article_chunks.chunk_id users.user_id users.email
user_category_prefs.pref_id user_category_prefs.user_id,category_id chat_sessions.session_id
chat_history.chat_id chat_sources.id"""
_PARENTS = """news_sources.category_id>categories.category_id articles.source_id>news_sources.source_id
articles.category_id>categories.category_id articles.representative_id>articles.article_id
article_chunks.article_id>articles.article_id user_category_prefs.user_id>users.user_id
user_category_prefs.category_id>categories.category_id chat_sessions.user_id>users.user_id
chat_history.session_id>chat_sessions.session_id chat_sources.chat_id>chat_history.chat_id
chat_sources.article_id>articles.article_id"""


def _constraints() -> str:
    def row(kind, table, columns, count, source):
        return (
            f"SELECT '{kind}' AS kind, '{table}' AS \"table\", '{columns}' AS columns, "
            f"CAST({count} AS BIGINT) AS n_rows FROM {source}"
        )

    out = [
        row("required", t, c, f"count_if({c} IS NULL)", f"b_{t}")
        for t, columns in _REQUIRED.items()
        for c in columns.split()
    ]
    for key in _KEYS.split():
        t, columns = key.split(".")
        present = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))
        out.append(
            row("unique", t, columns, "count(*) - (SELECT count(*) FROM "
                f"(SELECT DISTINCT {columns} FROM b_{t} WHERE {present}))", f"b_{t} WHERE {present}")
        )
    for link in _PARENTS.split():
        child, parent = (x.split(".") for x in link.split(">"))
        out.append(
            row("reference", *child, "count(*)", f"b_{child[0]} x WHERE {child[1]} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM b_{parent[0]} p WHERE p.{parent[1]} = x.{child[1]})")
        )
    out.append(
        row("range", "user_category_prefs", "weight", "count_if(weight NOT BETWEEN 1 AND 10)", "b_user_category_prefs")
    )
    return _with(" UNION ALL ".join(out), _BROKEN)


def _chains(columns: str, where: str = "") -> str:
    """Every chain of representatives walked link by link, with the path behind it."""
    return _with(
        f"""SELECT {columns} FROM (
  WITH RECURSIVE links AS (
    SELECT article_id, CASE WHEN article_id % 40 = 20 THEN article_id + 4
      WHEN article_id % 5 <> 0 OR article_id % 40 = 25 THEN article_id - 1 END AS representative_id
    FROM articles
  ), walk AS (
    SELECT article_id, representative_id, representative_id AS stop, [article_id] AS path
    FROM links WHERE representative_id IS NOT NULL
    UNION ALL
    SELECT w.article_id, w.representative_id, l.representative_id, list_append(path, stop)
    FROM walk w JOIN links l ON l.article_id = stop AND l.representative_id IS NOT NULL
    WHERE NOT list_contains(path, stop)
  )
  SELECT article_id, representative_id, list_contains(path, stop) AS looped,
    CASE WHEN looped THEN list_min(path[list_position(path, stop):]) ELSE stop END AS final_id,
    CASE WHEN NOT looped THEN CAST(len(path) AS VARCHAR) END AS hops
  FROM walk w
  WHERE looped OR stop NOT IN (SELECT article_id FROM links WHERE representative_id IS NOT NULL)
) {where}"""
    )


def audits() -> dict[str, str]:
    return {
        "audit_chain_ends": _chains("article_id, representative_id, final_id, hops, looped"),
        "audit_chain_repairs": _chains(
            """article_id, article_id <> final_id AS is_duplicate,
  CASE WHEN article_id <> final_id THEN CAST(final_id AS VARCHAR) END AS representative_id""",
            "WHERE article_id = final_id OR representative_id <> final_id",
        ),
        "audit_constraints": _constraints(),
        "audit_unique": _with(
            "SELECT link, count(*) AS n_rows FROM feed_items GROUP BY link HAVING count(*) > 1"
        ),
        "audit_orphans": _with(
            "SELECT * FROM seen WHERE article_id NOT IN (SELECT article_id FROM servable)"
        ),
        "audit_ranges": _with(
            """SELECT 'weight_from_1_to_10' AS rule, count_if(weight NOT BETWEEN 1 AND 10)::BIGINT
  AS n_rows FROM prefs
UNION ALL SELECT 'title_present', count_if(title = '')::BIGINT FROM parsed
UNION ALL SELECT 'url_present', count_if(url = '')::BIGINT FROM parsed
UNION ALL SELECT 'date_present', count_if(published_at IS NULL)::BIGINT FROM parsed""",
            _PARSED,
        ),
    }


def streams() -> dict[str, str]:
    return {
        "stream_ingest_dedup": _with(
            "SELECT * FROM inserted",
            _PARSED,
            _insert("published_at, title, description, source_id", "SELECT ''", "0"),
        ),
        "stream_chunk": _with(
            """SELECT *, row_number() OVER (
    ORDER BY md5(article_id || chr(31) || chunk_index), article_id, chunk_index) AS chunk_id
FROM chunked WHERE article_id IN (SELECT article_id FROM waiting)""",
            _CHUNKED,
        ),
        "live_feed_batch": _live_feed("2024-01-30"),
        "live_feed_quiet": _live_feed("2024-01-30 21:00:00"),
    }


def _live_feed(since: str) -> str:
    return _with(
        f"""SELECT user_id, false AS heartbeat,
  CAST((row_number() OVER (PARTITION BY user_id ORDER BY n.published_at DESC, n.article_id) - 1)
       % 100 AS VARCHAR) AS pos,
  CAST(n.article_id AS VARCHAR) AS article_id, title, description, url,
  strftime(n.published_at, '%Y-%m-%dT%H:%M:%S') AS published_at,
  {_ago('n.published_at')} AS published_ago, category_name, source_name,
  CAST(NULL AS VARCHAR) AS press_count, CAST(NULL AS DOUBLE) AS similarity,
  CAST(weight AS VARCHAR) AS category_weight
FROM prefs JOIN news n USING (category_id)
UNION ALL
SELECT DISTINCT user_id, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM prefs WHERE user_id NOT IN (SELECT user_id FROM prefs JOIN news USING (category_id))""",
        f"news AS (SELECT * FROM servable WHERE published_at > TIMESTAMP '{since}')",
    )


# Changes by way of a store give what the same changes to a whole table give.
_STORED = {
    "stored_prefs": "upsert_prefs",
    "stored_sessions": "upsert_sessions",
    "stored_vectors": "embedding_backlog",
}


def oracle_sql() -> dict[str, str]:
    sql = {
        **feeds(),
        **collection(),
        **duplicates(),
        **retrieval_and_chat(),
        **audits(),
        **streams(),
    }
    return sql | {name: sql[same] for name, same in _STORED.items()}
