"""SQL equivalents of the registered queries, for DuckDB, written without the package.

Each statement names the derived tables it needs; they are prepended as CTEs.
"""

from __future__ import annotations

import re

_MODULE = "(o_custkey*5 + cast(substr(o_orderpriority,1,1) as bigint) - 1)"

# Python's str.strip() characters, as far as the derived texts use them.
_BLANK = r"concat(E' \t\n\r', chr(160), chr(12288))"

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The prompt sent to the model.
_PROMPT = """You are an expert quiz generator. Create <<N>> multiple-choice questions based ONLY on the provided notes.

Difficulty level: <<D>>

Return ONLY valid JSON in this exact format (no markdown, no extra text):
{"questions": [{"question":"Question text here","options":["Option A","Option B","Option C","Option D"],"answer":0,"explanation":"Brief explanation"}]}

Rules:
- "answer" must be 0, 1, 2, or 3 (index of correct option)
- Include exactly 4 options per question
- Keep explanations brief and clear
- Base questions only on the provided notes

NOTES:
<<T>>
"""


def _prompt_sql() -> str:
    parts = re.split(r"(<<.>>)", _PROMPT)
    values = {
        "<<N>>": "cast(num_questions as varchar)",
        "<<D>>": "difficulty",
        "<<T>>": "substr(text, 1, 4000)",
    }
    return "concat(" + ", ".join(values.get(p) or f"'{p}'" for p in parts if p) + ")"


_CTES: dict[str, str] = {}

_CTES["users"] = """
SELECT c_custkey AS user_id, c_name AS username,
       concat(lower(replace(c_name,'#','.')),'@example.com') AS email
FROM customer"""

_CTES["modules"] = f"""
SELECT {_MODULE} AS module_id, o_custkey AS user_id, o_orderpriority AS module_name,
       min(o_orderdate) AS created_at
FROM orders GROUP BY o_custkey, o_orderpriority"""

_CTES["quizzes"] = f"""
SELECT o_orderkey AS quiz_id, o_custkey AS user_id, {_MODULE} AS module_id,
       o_orderdate AS "timestamp",
       CASE o_orderstatus WHEN 'O' THEN 'Easy' WHEN 'P' THEN 'Medium' ELSE 'Hard' END AS difficulty
FROM orders"""

_CTES["lines"] = """
SELECT l_orderkey AS quiz_id, l_orderkey*10 + l_linenumber AS question_id,
       min(l_partkey) AS part, min(l_suppkey) AS supp
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

_CTES["questions"] = """
SELECT question_id, quiz_id, concat('Q about part ', part) AS question_text,
       concat('["A', part, '","B', supp, '","C","D"]') AS options,
       cast(part % 4 as int) AS correct_answer,
       CASE WHEN part % 3 = 0 THEN NULL ELSE concat('See ', supp) END AS explanation
FROM lines"""

_CTES["choices"] = f"""
SELECT q.quiz_id*10 + a.attempt AS submission_id, o_custkey AS user_id, {_MODULE} AS module_id,
       q.quiz_id, q.question_id, a.attempt,
       cast((q.supp + (a.attempt-1)*q.part) % 4 as int) AS choice,
       o_orderdate + to_days(cast(a.attempt-1 as int)) AS submitted_at
FROM lines q JOIN orders ON o_orderkey = q.quiz_id
JOIN (VALUES (1),(2)) a(attempt) ON a.attempt = 1 OR q.quiz_id % 5 = 0
WHERE q.supp % 10 <> 0"""

_CTES["submissions"] = """
SELECT DISTINCT submission_id, user_id, module_id, quiz_id, attempt, submitted_at FROM choices"""

_CTES["graded"] = """
SELECT s.submission_id, s.submitted_at, s.user_id, s.module_id, s.quiz_id, q.question_id,
       q.question_text, q.options, q.correct_answer, q.explanation, c.choice,
       coalesce(c.choice, -1) AS user_answer,
       CASE WHEN coalesce(c.choice, -1) = q.correct_answer THEN 1 ELSE 0 END AS is_correct
FROM submissions s JOIN questions q USING (quiz_id)
LEFT JOIN choices c ON c.submission_id = s.submission_id AND c.question_id = q.question_id"""

_CTES["scored"] = """
SELECT s.submission_id, s.user_id, s.module_id, s.quiz_id, s.submitted_at,
       cast(coalesce(sum(is_correct), 0) as bigint) AS score, count(question_id) AS total,
       count(question_id) - count(choice) AS missing,
       CASE WHEN count(question_id) = 0 THEN 0.0
            ELSE coalesce(sum(is_correct), 0)::double / count(question_id) * 100 END AS percentage
FROM submissions s LEFT JOIN (SELECT submission_id, question_id, is_correct, choice FROM graded) g
USING (submission_id) GROUP BY ALL"""

_CTES["performance"] = """
SELECT submission_id AS performance_id, user_id, module_id, submitted_at AS "timestamp",
       score, total, percentage FROM scored"""

_CTES["listed"] = """
SELECT user_id, module_id, quiz_id, "timestamp", difficulty,
       cast(row_number() OVER (PARTITION BY user_id, module_id ORDER BY quiz_id DESC) as int) AS place
FROM quizzes"""

_CTES["raw_notes"] = r"""
SELECT doc_id AS note_id,
       concat('n', doc_id, ['.PDF','.docx','.rtf','.odt','.pptx','.txt'][doc_id % 6 + 1]) AS file_name,
       CASE WHEN doc_id % 7 = 0 THEN concat(E'\n\t ', text, chr(160), E' \r\n') ELSE text END AS text,
       CASE WHEN doc_id % 41 = 0 THEN concat('bad file ', doc_id) END AS extract_error
FROM documents"""

_CTES["gated"] = f"""
SELECT note_id, file_name, route,
       CASE WHEN status = 'ok' THEN text ELSE '' END AS text, status,
       CASE status WHEN 'extraction_error' THEN concat('Error extracting text: ', extract_error)
            WHEN 'scanned_or_empty'
            THEN 'PDF appears to be scanned or empty. Please use a text-based PDF.'
            WHEN 'empty' THEN 'No text could be extracted. Please check your file.' END AS message
FROM (SELECT *, CASE WHEN extract_error IS NOT NULL THEN 'extraction_error'
                     WHEN route = 'pdf' AND length(text) < 50 THEN 'scanned_or_empty'
                     WHEN text = '' THEN 'empty' ELSE 'ok' END AS status
      FROM (SELECT note_id, file_name, trim(coalesce(text, ''), {_BLANK}) AS text, extract_error,
                   CASE regexp_extract(lower(file_name), '[.]([a-z]+)$', 1)
                        WHEN 'txt' THEN 'text'
                        ELSE regexp_extract(lower(file_name), '[.]([a-z]+)$', 1) END AS route
            FROM raw_notes))"""

_CTES["good_notes"] = "SELECT * FROM gated WHERE status = 'ok'"

_CTES["lookups"] = r"""
SELECT user_id AS lookup_id, CASE user_id % 6
       WHEN 0 THEN username WHEN 1 THEN upper(username)
       WHEN 2 THEN concat(E' \t', upper(email), chr(160))
       WHEN 3 THEN concat('nobody', user_id) WHEN 4 THEN E' \n'
       ELSE concat('É', username) END AS identifier
FROM users"""

_CTES["all_users"] = """
SELECT * FROM users UNION ALL
SELECT user_id + 1000000000,
       CASE WHEN user_id % 2 = 0 THEN upper(username) ELSE concat('é', username) END,
       concat('second.', email)
FROM users WHERE user_id % 3 = 1"""

_CTES["import_batch"] = r"""
SELECT c_custkey AS seq,
       CASE WHEN c_custkey % 10 = 3 THEN E' \t' WHEN c_custkey % 10 = 4 THEN c_name
            WHEN c_custkey % 4 = 1 THEN concat('  new', c_custkey // 2, ' ')
            ELSE concat('new', c_custkey // 3) END AS username,
       CASE WHEN c_custkey % 9 = 2 THEN concat('bad@', c_custkey % 37)
            WHEN c_custkey % 9 = 5 THEN lower(concat(replace(c_name, '#', '.'), '@example.com'))
            ELSE concat(' New', c_custkey // 2, '@Example.org') END AS email
FROM customer"""

_CTES["wanted"] = r"""
SELECT o_orderkey AS request_id, o_custkey AS user_id, trim(CASE o_orderkey % 5
       WHEN 0 THEN concat(E' \t', o_orderpriority, ' ') WHEN 1 THEN lower(o_orderpriority)
       WHEN 2 THEN '  ' WHEN 3 THEN concat('Topic ', o_orderstatus)
       ELSE o_orderpriority END, E' \t') AS module_name
FROM orders"""

# The raw responses, attempt by attempt.
_CTES["pieces"] = r"""
SELECT *, concat('{"question":"Q about ', part, '","options":["A', part, '", "B', supp,
                 '","Cé", "D"],"answer":') AS opening FROM lines"""

_CTES["material"] = r"""
SELECT question_id, part, supp, part % 4 AS a, opening,
       concat(opening, part % 4, '}') AS bare,
       concat(opening, part % 4, ',"explanation":"See it"}') AS plain,
       concat(opening, part % 4, ',"explanation":null}') AS nulled,
       concat('{"questions": [', opening, part % 4, ',"explanation":"See it"}', E',\n ',
              opening, part % 4, '}', E',\n ', opening, part % 4, ',"explanation":null}', ']}') AS good
FROM pieces"""

_CTES["responses"] = r"""
SELECT question_id AS request_id, cast(u.attempt as int) AS attempt, texts[u.attempt] AS raw_text
FROM (SELECT question_id, CASE question_id % 16
  WHEN 0 THEN [good, good]
  WHEN 1 THEN [concat(E'```json\n', good, E'\n``` \n')]
  WHEN 2 THEN [concat(E'Here you go:\n', good, E'\nEnjoy!')]
  WHEN 3 THEN [concat(good, ' or else ', good), concat('{"questions": [', bare, ']}'), good]
  WHEN 4 THEN [concat('{"questions":[', bare, ',]}'), NULL,
               concat(E'```json\n', good, E'\n``` \n'), good]
  WHEN 5 THEN ['', 'I cannot do that.', concat(chr(160), E'\n'), good]
  WHEN 6 THEN [concat('{"questions": [', opening, '" ', a, ' "}]}')]
  WHEN 7 THEN [concat('{"questions": [', opening, '2.9}', E',\n ', opening, 'true}', E',\n ',
                      opening, '-0.9}]}')]
  WHEN 8 THEN [concat('{"questions": [', plain, E',\n ', opening, '4}]}'),
               concat(E'```\n', good, '```')]
  WHEN 9 THEN [concat('{"questions": [{"question":"Q about ', part, '","options":["', part,
                      '","B","C"],"answer":', a, '}]}'),
               concat('{"questions": [{"question":"Q about ', part, '","options":["', part,
                      '","B","C","D","E"],"answer":', a, '}]}'),
               concat('{"questions": [{"question":"Q about ', part, '","options":"abcd","answer":',
                      a, '}]}'), good]
  WHEN 10 THEN ['{"questions":[]}', good]
  WHEN 11 THEN ['{"questions":null}', '[1,2]', '5', good]
  WHEN 12 THEN [concat('{"questions":[{"options":["a","b","c","d"],"answer":', a, '}]}'),
                concat('{"questions":[{"question":null,"options":["a","b","c","d"],"answer":', a,
                       '}]}'), good]
  WHEN 13 THEN [concat('{"questions": [', plain, E',\n ', '1', E',\n ', bare, ']}'),
                concat('{"questions": [', bare, E',\n ', plain, ']}')]
  WHEN 14 THEN [concat(chr(160), ' ', good, chr(12288))]
  ELSE [concat('{"questions": [', opening, '"2.0"}]}'), concat('{"questions": [', opening, 'null}]}'),
        concat('{"questions": [', opening, '[1]}]}'), good] END AS texts
  FROM material) t JOIN (VALUES (1),(2),(3),(4)) u(attempt) ON u.attempt <= len(texts)"""

_CTES["documents_found"] = rf"""
SELECT request_id, attempt,
       CASE WHEN regexp_matches(body, '\{{.*\}}', 's') THEN regexp_extract(body, '\{{.*\}}', 0, 's')
            ELSE body END AS document
FROM (SELECT request_id, attempt,
             regexp_replace(regexp_replace(trim(coalesce(raw_text, ''), {_BLANK}),
                            '^```(?:json)?\s*', ''), '\s*```$', '') AS body FROM responses)"""

# This engine's json_valid tolerates a trailing comma.
_CTES["parsed"] = r"""
SELECT request_id, attempt,
       CASE WHEN json_valid(document) AND NOT regexp_matches(document, ',\s*[\]}]')
            THEN document::json END AS j
FROM documents_found"""

_CTES["items"] = r"""
SELECT request_id, attempt, pos, item, answer_type,
       CASE WHEN answer_type IN ('BIGINT','UBIGINT','DOUBLE')
            THEN trunc(cast(item->>'$.answer' as double))
            WHEN answer_type = 'BOOLEAN' THEN CASE item->>'$.answer' WHEN 'true' THEN 1 ELSE 0 END
            WHEN answer_type = 'VARCHAR'
            AND regexp_full_match(trim(item->>'$.answer'), '[+-]?[0-9]+')
            THEN cast(trim(item->>'$.answer') as double) END AS answer
FROM (SELECT request_id, attempt, p AS pos, item, json_type(item, '$.answer') AS answer_type
      FROM (SELECT request_id, attempt, p, json_extract(j, concat('$.questions[', p, ']')) AS item
            FROM (SELECT request_id, attempt, j,
                         unnest(range(json_array_length(j, '$.questions')::bigint)) AS p
                  FROM parsed WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.questions') = 'ARRAY')))"""

_CTES["judged"] = r"""
SELECT p.request_id, p.attempt,
       CASE WHEN j IS NULL THEN 'invalid_json'
            WHEN json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.questions'), '') = 'ARRAY'
                 AND coalesce(bad, 0) = 0 THEN 'ok'
            ELSE 'invalid_structure' END AS status,
       coalesce(n, 0) AS n
FROM parsed p LEFT JOIN (
  SELECT request_id, attempt, count(*) AS n, count(*) FILTER (
         coalesce(json_type(item) = 'OBJECT' AND json_exists(item, '$.question')
                  AND json_type(item, '$.options') = 'ARRAY'
                  AND json_array_length(item, '$.options') = 4
                  AND answer BETWEEN 0 AND 3, false) = false) AS bad
  FROM items GROUP BY request_id, attempt) i USING (request_id, attempt)"""

_CTES["first_ok"] = """
SELECT request_id, min(attempt) AS attempt, arg_min(n, attempt) AS n
FROM judged WHERE attempt <= 3 AND status = 'ok' GROUP BY request_id"""

_CTES["curated"] = r"""
SELECT i.request_id, cast(pos as int) AS position, item->>'$.question' AS question,
       json_extract(item, '$.options')::varchar AS options, cast(answer as int) AS answer,
       CASE WHEN json_exists(item, '$.explanation') THEN item->>'$.explanation' ELSE '' END AS explanation
FROM items i JOIN first_ok f ON f.request_id = i.request_id AND f.attempt = i.attempt"""

_CTES["saved_headers"] = """
SELECT f.request_id,
       (SELECT max(quiz_id) FROM quizzes)
         + row_number() OVER (ORDER BY md5(cast(f.request_id as varchar)), f.request_id) AS quiz_id,
       z.user_id, z.module_id, TIMESTAMP '2024-01-01 00:00:00' AS "timestamp",
       sha256(q.question_text) AS notes_hash, z.difficulty
FROM first_ok f JOIN questions q ON q.question_id = f.request_id JOIN quizzes z USING (quiz_id)"""


def _broken(column: str, by: str, step: int) -> str:
    return (
        f"CASE WHEN {by} % {step} = 0 THEN {column} + 1000000000000 "
        f"WHEN {by} % {step} <> 1 THEN {column} END"
    )


def _orphans(fk: str, child: str, key: str, column: str, step: int, parent: str, parent_key: str) -> str:
    return (
        f"SELECT '{fk}' AS fk, child_id, k AS missing_key FROM "
        f"(SELECT {key} AS child_id, {_broken(column, key, step)} AS k FROM {child}) x "
        f"WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = x.k)"
    )


_CTES["answers"] = """
SELECT *, row_number() OVER (ORDER BY md5(concat(submission_id, '/', question_id)), submission_id, question_id) AS answer_id
FROM graded"""

_ANSWER_ORDER = "md5(concat(user_id, '/', quiz_id, '/', question_id)), user_id, quiz_id, question_id"

# First attempts are numbered together, then the second attempts that replace some of them.
_CTES["kept_answers"] = f"""
SELECT attempt, row_number() OVER (ORDER BY attempt, {_ANSWER_ORDER}) AS answer_id,
       user_id, quiz_id, question_id, user_answer, is_correct
FROM (SELECT *, submission_id % 10 AS attempt FROM graded)"""

_FK_AUDIT = "\nUNION ALL\n".join(
    _orphans(*link)
    for link in [
        ("modules.user_id", "modules", "module_id", "user_id", 97, "users", "user_id"),
        ("quizzes.user_id", "quizzes", "quiz_id", "user_id", 89, "users", "user_id"),
        ("quizzes.module_id", "quizzes", "quiz_id", "module_id", 83, "modules", "module_id"),
        ("questions.quiz_id", "questions", "question_id", "quiz_id", 101, "quizzes", "quiz_id"),
        ("user_answers.user_id", "answers", "answer_id", "user_id", 103, "users", "user_id"),
        ("user_answers.quiz_id", "answers", "answer_id", "quiz_id", 107, "quizzes", "quiz_id"),
        ("user_answers.question_id", "answers", "answer_id", "question_id", 109, "questions", "question_id"),
        ("performance.user_id", "performance", "performance_id", "user_id", 113, "users", "user_id"),
        ("performance.module_id", "performance", "performance_id", "module_id", 127, "modules", "module_id"),
    ]
)

_IMPORT_CHECK = r"""SELECT seq, username, email, accepted, message FROM (
  WITH RECURSIVE cleaned AS (
    SELECT seq, trim(username, E' \t') AS username, lower(trim(email)) AS email,
           row_number() OVER (ORDER BY seq) AS n FROM import_batch),
  checked AS (
    SELECT *, CASE WHEN username = '' THEN 'Username and password required.'
      WHEN NOT regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')
      THEN 'Invalid email format.' END AS refusal,
      username IN (SELECT username FROM users) AS old_name,
      email IN (SELECT email FROM users) AS old_email FROM cleaned),
  walk AS (
    SELECT 0::bigint AS n, 0::bigint AS seq, '' AS username, '' AS email, '' AS message,
           []::varchar[] AS names, []::varchar[] AS emails
    UNION ALL
    SELECT n, seq, username, email, message,
      CASE WHEN message LIKE 'Account%' THEN list_append(names, username) ELSE names END,
      CASE WHEN message LIKE 'Account%' THEN list_append(emails, email) ELSE emails END
    FROM (SELECT c.n, c.seq, c.username, c.email, w.names, w.emails,
      CASE WHEN refusal IS NOT NULL THEN refusal
        WHEN old_name OR list_contains(w.names, c.username) THEN 'Username already exists.'
        WHEN old_email OR list_contains(w.emails, c.email) THEN 'Email already registered.'
        ELSE 'Account created successfully! You can now login.' END AS message
      FROM walk w JOIN checked c ON c.n = w.n + 1))
  SELECT seq, username, email, message LIKE 'Account%' AS accepted, message FROM walk WHERE n > 0)"""

_SQL: dict[str, str] = {
    "users_table": "SELECT user_id, username, email FROM users",
    "modules_table": "SELECT module_id, user_id, module_name, created_at FROM modules",
    "quizzes_table": 'SELECT quiz_id, user_id, module_id, "timestamp", difficulty FROM quizzes',
    "questions_table": "SELECT * FROM questions",
    "scored_attempts": """SELECT submission_id, user_id, module_id, quiz_id, score, total, percentage
FROM scored""",
    "accepted_attempts": "SELECT submission_id, score, total, percentage FROM scored WHERE missing = 0",
    "graded_answers": "SELECT submission_id, question_id, user_answer, is_correct FROM graded",
    "missing_answers": """SELECT submission_id, quiz_id, total, missing, missing = 0 AS accepted
FROM scored""",
    "review_lines": """SELECT submission_id, question_id,
  dense_rank() OVER (PARTITION BY quiz_id ORDER BY question_id) AS question_number, question_text,
  CASE WHEN is_correct = 1 THEN 'Correct' ELSE 'Incorrect' END AS verdict,
  CASE WHEN user_answer >= 0 THEN json_extract_string(options, concat('$[', user_answer, ']')) END
    AS chosen_option,
  json_extract_string(options, concat('$[', correct_answer, ']')) AS correct_option,
  nullif(explanation, '') AS explanation
FROM graded""",
    "grade_bands": """SELECT submission_id, band, score_of_total, percent,
  concat(band, ' Your score: ', score_of_total, ' (', percent, ')') AS result_line
FROM (SELECT submission_id,
  CASE WHEN percentage >= 90 THEN 'Outstanding!' WHEN percentage >= 75 THEN 'Great job!'
       WHEN percentage >= 60 THEN 'Good effort!' ELSE 'Keep practicing!' END AS band,
  concat(score, '/', total) AS score_of_total, format('{:.1f}%', percentage) AS percent
FROM scored)""",
    "progress_summary": """SELECT user_id, module_id, count(*) AS attempts,
  round(avg(percentage), 6) AS average, max(percentage) AS best
FROM performance GROUP BY user_id, module_id""",
    "progress_metrics": """SELECT user_id, module_id, count(*) AS total_attempts,
  format('{:.1f}%', round(avg(percentage), 6)) AS average_score,
  format('{:.1f}%', max(percentage)) AS best_score
FROM performance GROUP BY user_id, module_id""",
    "performance_trend": """SELECT user_id, module_id, performance_id, "timestamp", percentage
FROM performance""",
    "trend_places": """SELECT user_id, module_id, row_number() OVER (PARTITION BY user_id, module_id
    ORDER BY "timestamp" NULLS FIRST, performance_id NULLS FIRST) AS place, performance_id, "timestamp", percentage
FROM performance""",
    "module_list": """SELECT module_id, module_name, row_number() OVER (ORDER BY module_name NULLS FIRST) AS place
FROM modules WHERE user_id = (SELECT min(user_id) FROM modules)""",
    "quiz_list": """SELECT quiz_id, "timestamp", difficulty, row_number() OVER (ORDER BY quiz_id DESC) AS place
FROM quizzes JOIN (SELECT user_id, module_id FROM quizzes ORDER BY quiz_id DESC LIMIT 1) USING (user_id, module_id)
ORDER BY quiz_id DESC LIMIT 2""",
    "loaded_quiz": """SELECT z.quiz_id, z.difficulty, z."timestamp",
  concat('[', coalesce(d.body, ''), ']') AS questions
FROM quizzes z LEFT JOIN (SELECT quiz_id, string_agg(to_json({'question_id': question_id,
    'question': question_text, 'options': cast(options::json as varchar[]),
    'answer': correct_answer, 'explanation': coalesce(explanation, '')})::varchar, ','
    ORDER BY question_id) AS body FROM questions GROUP BY quiz_id) d USING (quiz_id)
WHERE z.quiz_id = (SELECT max(quiz_id) FROM quizzes)""",
    "question_difficulty": """SELECT question_id, count(g.submission_id) AS answers,
  sum(g.is_correct) / nullif(count(g.submission_id), 0)::double AS share_correct,
  CASE WHEN count(g.submission_id) > 0 THEN concat_ws(' ', format('{:.6f}', count(*) FILTER (g.user_answer = 0) / nullif(count(g.submission_id), 0)::double),
    format('{:.6f}', count(*) FILTER (g.user_answer = 1) / nullif(count(g.submission_id), 0)::double),
    format('{:.6f}', count(*) FILTER (g.user_answer = 2) / nullif(count(g.submission_id), 0)::double),
    format('{:.6f}', count(*) FILTER (g.user_answer = 3) / nullif(count(g.submission_id), 0)::double)) END AS option_shares
FROM questions q LEFT JOIN (SELECT question_id, submission_id, user_answer, is_correct FROM graded) g USING (question_id)
GROUP BY question_id""",
    "duplicate_notes": """SELECT note_id, min(note_id) OVER same AS first_note_id, count(*) OVER same AS copies
FROM good_notes WINDOW same AS (PARTITION BY text)""",
    "performance_history": """SELECT user_id, module_id, performance_id,
  row_number() OVER (PARTITION BY user_id, module_id
    ORDER BY "timestamp" NULLS FIRST, performance_id NULLS FIRST) AS place,
  strftime("timestamp", '%Y-%m-%d %H:%M') AS "Date & Time", score AS "Score", total AS "Total",
  percentage AS "Percentage (%)" FROM performance""",
    "performance_sql": """SELECT user_id, module_id, "timestamp", score, total, percentage
FROM performance WHERE percentage BETWEEN 25 AND 75""",
    "latest_quizzes_per_module": "SELECT * FROM listed WHERE place <= 3",
    "module_quizzes": "SELECT * FROM listed WHERE place <= 50",
    "modules_per_user": """SELECT user_id, module_id, module_name, place FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY user_id ORDER BY module_name) as int) AS place
  FROM modules) WHERE place <= 3""",
    "default_quiz": """SELECT l.user_id, l.module_id,
  coalesce(max(CASE WHEN l.quiz_id = s.wanted THEN l.quiz_id END), max(l.quiz_id)) AS quiz_id
FROM listed l JOIN (
  SELECT user_id, module_id, CASE module_id % 3 WHEN 1 THEN min(quiz_id) WHEN 2 THEN min(quiz_id) + 1 END
    AS wanted FROM quizzes GROUP BY user_id, module_id) s
ON s.user_id = l.user_id AND s.module_id = l.module_id
WHERE place <= 3 GROUP BY l.user_id, l.module_id""",
    "quiz_labels": """SELECT quiz_id, concat('Quiz #', quiz_id, ' • ',
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S'), ' • ', difficulty) AS label FROM quizzes""",
    "question_numbers": """SELECT quiz_id, question_id,
  row_number() OVER (PARTITION BY quiz_id ORDER BY question_id) AS question_number FROM questions""",
    "quiz_documents": """SELECT z.quiz_id, z.difficulty, z."timestamp",
  concat('[', coalesce(d.body, ''), ']') AS questions
FROM quizzes z LEFT JOIN (SELECT quiz_id, string_agg(to_json({'question_id': question_id,
    'question': question_text, 'options': cast(options::json as varchar[]),
    'answer': correct_answer, 'explanation': coalesce(explanation, '')})::varchar, ','
    ORDER BY question_id) AS body FROM questions GROUP BY quiz_id) d USING (quiz_id)""",
    "notes_assembled": f"""SELECT conv_id AS note_id, trim(string_agg(
  CASE WHEN (conv_id*7 + turn) % 9 <> 0 THEN text ELSE '' END, chr(10) ORDER BY turn), {_BLANK}) AS text
FROM conversations GROUP BY conv_id""",
    "note_files": f"""SELECT file_name, route,
  CASE WHEN route = 'pdf' THEN 'scanned_or_empty' WHEN route <> 'text' OR text = '' THEN 'empty' ELSE 'ok' END AS status,
  sha256(CASE WHEN route = 'text' THEN text ELSE '' END) AS text_hash,
  CASE WHEN route = 'rtf' THEN sha256(concat(raw, chr(10))) END AS markup_hash,
  CASE WHEN route NOT IN ('text', 'rtf') THEN cast(strlen(raw) + 1 + CASE WHEN note_id % 3 = 0 THEN 2 ELSE 0 END as int) END AS n_bytes
FROM (SELECT note_id, file_name, coalesce(text, '') AS raw, trim(coalesce(text, ''), {_BLANK}) AS text,
  replace(regexp_extract(lower(file_name), '[.]([a-z]+)$', 1), 'txt', 'text') AS route FROM raw_notes)""",
    "note_gate": """SELECT note_id, file_name, route, sha256(text) AS text, status, message FROM gated""",
    "notes_quarantined": """SELECT note_id, file_name, route, status, message FROM gated
WHERE status <> 'ok'""",
    "note_fingerprints": "SELECT note_id, sha256(text) AS notes_hash FROM good_notes",
    "note_previews": """SELECT note_id, length(text) AS n_chars,
  concat(substr(text, 1, 1500), CASE WHEN length(text) > 1500 THEN '...' ELSE '' END) AS preview,
  concat('Total: ', format('{:,}', length(text)), ' characters') AS caption FROM good_notes""",
    "notes_decoded": f"SELECT note_id, trim(text, {_BLANK}) AS text FROM raw_notes",
    "prompts_from_notes": f"""SELECT note_id, num_questions, difficulty, true AS settings_ok,
  {_prompt_sql()} AS prompt
FROM (SELECT conv_id AS note_id, 10 AS num_questions, 'Medium' AS difficulty, trim(string_agg(
    CASE WHEN (conv_id*7 + turn) % 9 <> 0 THEN text ELSE '' END, chr(10) ORDER BY turn), {_BLANK}) AS text
  FROM conversations GROUP BY conv_id) n WHERE length(text) >= 50""",
    "prompts": f"""SELECT note_id, num_questions, difficulty, settings_ok,
  CASE WHEN settings_ok THEN {_prompt_sql()} END AS prompt
FROM (SELECT *, num_questions BETWEEN 1 AND 50 AND difficulty IN ('Easy','Medium','Hard') AS settings_ok
  FROM (SELECT note_id, text,
    cast(CASE WHEN note_id % 11 <> 0 THEN note_id % 60 ELSE 10 END as int) AS num_questions,
    CASE WHEN note_id % 13 <> 0 THEN ['Easy','Medium','Hard','Extreme'][note_id % 4 + 1]
         ELSE 'Medium' END AS difficulty FROM raw_notes))""",
    "identity_resolution": f"""SELECT lookup_id, min(u.user_id) AS user_id,
  CASE WHEN folded = '' THEN 'blank' WHEN min(u.user_id) IS NULL THEN 'not_found' ELSE 'found' END
    AS status
FROM (SELECT lookup_id, {_FOLD.format("trim(identifier, " + _BLANK + ")")} AS folded FROM lookups) l
LEFT JOIN all_users u ON folded <> ''
  AND ({_FOLD.format("u.username")} = folded OR {_FOLD.format("u.email")} = folded)
GROUP BY lookup_id, folded""",
    "user_import_check": _IMPORT_CHECK,
    "imported_users": f"""SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY md5(seq::varchar))
  AS user_id, username, email, TIMESTAMP '2024-01-01 00:00:00' AS created_at, 1 AS email_verified
FROM ({_IMPORT_CHECK}) v WHERE accepted""",
    "module_upsert": """SELECT w.request_id, w.user_id, w.module_name,
  coalesce(m.module_id, c.module_id) AS module_id, c.module_id IS NOT NULL AS created
FROM wanted w LEFT JOIN modules m ON m.user_id = w.user_id AND m.module_name = w.module_name
LEFT JOIN (
  SELECT user_id, module_name, (SELECT max(module_id) FROM modules) + row_number() OVER (
    ORDER BY md5(concat(user_id, '/', module_name)), user_id, module_name) AS module_id
  FROM (SELECT DISTINCT user_id, module_name FROM wanted w WHERE module_name <> '' AND NOT EXISTS (
    SELECT 1 FROM modules m WHERE m.user_id = w.user_id AND m.module_name = w.module_name))) c
ON c.user_id = w.user_id AND c.module_name = w.module_name""",
    "answers_replace": """SELECT answer_id, user_id, quiz_id, question_id, user_answer, is_correct FROM kept_answers
WHERE attempt = CASE WHEN quiz_id % 5 = 0 THEN 2 ELSE 1 END""",
    "user_answers_table": f"""SELECT row_number() OVER (ORDER BY {_ANSWER_ORDER}) AS answer_id,
  user_id, quiz_id, question_id, user_answer, is_correct FROM kept_answers
WHERE attempt = CASE WHEN quiz_id % 5 = 0 THEN 2 ELSE 1 END""",
    "performance_table": "SELECT * FROM performance",
    "fk_audit": _FK_AUDIT,
    "response_status": """SELECT request_id, attempt, status, CASE status
  WHEN 'invalid_json' THEN 'Invalid JSON from model'
  WHEN 'invalid_structure' THEN 'Model returned invalid quiz structure' END AS message FROM judged""",
    "first_valid_attempt": """SELECT r.request_id,
  CASE WHEN f.attempt IS NULL THEN 'failed' ELSE 'ready' END AS status, f.attempt,
  CASE WHEN f.attempt IS NULL THEN concat('Failed after 3 attempts: ', CASE r.last_status
    WHEN 'invalid_json' THEN 'Invalid JSON from model'
    ELSE 'Model returned invalid quiz structure' END) END AS error,
  cast(coalesce(f.n, 0) as int) AS n_questions
FROM (SELECT request_id, arg_max(status, attempt) AS last_status FROM judged
      WHERE attempt <= 3 GROUP BY request_id) r LEFT JOIN first_ok f USING (request_id)""",
    "curated_questions": "SELECT * FROM curated",
    "quiz_export": """SELECT f.request_id, concat('{"questions":[', coalesce(d.body, ''), ']}') AS document
FROM first_ok f LEFT JOIN (SELECT request_id, string_agg(to_json({'question': question,
    'options': cast(options::json as varchar[]), 'answer': answer, 'explanation': explanation})::varchar,
    ',' ORDER BY position) AS body FROM curated GROUP BY request_id) d USING (request_id)""",
    "saved_quizzes": """SELECT quiz_id, user_id, module_id, "timestamp", notes_hash, difficulty FROM saved_headers""",
    "saved_questions": """SELECT (SELECT max(question_id) FROM questions) + row_number() OVER (
    ORDER BY substr(md5(cast(c.request_id as varchar)), 1, 3), c.position // 1048576,
             md5(cast(c.request_id as varchar)), c.request_id, c.position) AS question_id,
  h.quiz_id, c.question AS question_text, c.options, c.answer AS correct_answer, c.explanation
FROM curated c JOIN saved_headers h USING (request_id)""",
    "streamed_attempts": """SELECT performance_id, user_id, module_id, "timestamp", score, total, percentage
FROM performance""",
    "streamed_refusals": """SELECT submission_id, quiz_id,
  concat('Please answer all questions. Missing: ', missing) AS reason FROM scored WHERE missing > 0
UNION ALL SELECT -submission_id, -1 - quiz_id, 'Quiz not found' FROM scored WHERE quiz_id % 5 = 0""",
}


def _needed(sql: str) -> list[str]:
    """The CTEs a statement refers to, directly or not, in defining order."""
    found: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"\b[a-z_]+\b", texts.pop()))
        for name in words & _CTES.keys() - found:
            found.add(name)
            texts.append(_CTES[name])
    return [name for name in _CTES if name in found]


# Read by several others of a statement: computed once.
_SHARED = {"responses", "parsed", "items", "judged", "first_ok", "curated"}


def oracle_queries() -> dict[str, str]:
    statements = {}
    for name, sql in _SQL.items():
        ctes = ",\n".join(
            f"{cte} AS {'MATERIALIZED ' if cte in _SHARED else ''}({_CTES[cte]})" for cte in _needed(sql)
        )
        statements[name] = f"WITH {ctes}\n{sql}" if ctes else sql
    return statements
