"""SQL building blocks shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

# Python's whitespace, spelled out.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


ELEMENTS = """
sentences AS (
  SELECT doc_id, source, unnest(range(len(string_split(text, '. ')))) AS pos,
         unnest(string_split(text, '. ')) AS s FROM documents),
parts AS (
  SELECT doc_id, source, s, pos * 2 - pos % 2 + nth AS idx, nth > 0 AS inserted
  FROM sentences, range(3) AS places(nth) WHERE nth = 0 OR pos % 2 = 1),
keyed AS (
  SELECT *, (doc_id*7919 + idx*idx*31 + idx*17 + (doc_id % 13)*idx) % 23 AS k FROM parts),
elements AS (
  SELECT doc_id, source, idx,
    CASE WHEN inserted AND k=1 THEN 'Image' WHEN inserted AND k BETWEEN 7 AND 12 THEN 'FormKeysValues'
         WHEN inserted THEN 'NarrativeText' WHEN k=0 AND doc_id%10<>0 THEN 'Title' WHEN k=2 THEN 'Header'
         ELSE 'NarrativeText' END AS type,
    CASE WHEN inserted THEN CASE WHEN k=1 THEN NULL WHEN k IN (3,4,11) THEN 'Yes' WHEN k IN (5,6,12) THEN 'No' ELSE '' END
         WHEN k IN (13,14) THEN concat(s,'?') WHEN k=15 THEN concat(s,':') ELSE s END AS text,
    CASE WHEN inserted AND k IN (7,8,11) THEN '<input class="Checkbox" type="checkbox" checked/>'
         WHEN inserted AND k IN (9,10,12) THEN '<input class="Checkbox" type="checkbox"/>' ELSE '' END AS text_as_html,
    idx // 10 + 1 AS page_number
  FROM keyed)"""

NORMALISED = f"""{ELEMENTS},
plain AS (
  SELECT doc_id, source, idx, type, {strip("coalesce(text, '')")} AS text, text_as_html, page_number,
         text IS NULL AS null_text
  FROM elements)"""

STATES = f"""{NORMALISED},
seen AS (
  SELECT *, lag(text) OVER w AS back1, lag(text, 2) OVER w AS back2, lag(text, 3) OVER w AS back3,
         lag(text, 4) OVER w AS back4, lead(text) OVER w AS following,
         lag(null_text) OVER w AS null1, lag(null_text, 2) OVER w AS null2,
         lag(null_text, 3) OVER w AS null3, lag(null_text, 4) OVER w AS null4,
         lead(null_text) OVER w AS null_next
  FROM plain WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
stated AS (
  SELECT *, CASE WHEN contains(text_as_html, '<input class="Checkbox"') THEN
      CASE WHEN back1 IN ('Yes','No') THEN
             CASE WHEN NOT contains(text_as_html, 'checked') THEN 'unchecked'
                  WHEN back1 = 'Yes' THEN 'checked_yes' ELSE 'checked_no' END
           WHEN following IN ('Yes','No') THEN
             CASE WHEN NOT contains(text_as_html, 'checked') THEN 'unchecked'
                  WHEN following = 'Yes' THEN 'checked_yes' ELSE 'checked_no' END
      END END AS state
  FROM seen),
boxes AS (SELECT *, state IS NOT NULL AND type <> 'Title' AS is_checkbox FROM stated),
candidates AS (
  SELECT *, coalesce(lag(is_checkbox) OVER (PARTITION BY doc_id ORDER BY idx), false)
            AND text IN ('Yes','No') AS candidate FROM boxes),
consumption AS (
  SELECT *, candidate AND (idx - max(CASE WHEN NOT candidate THEN idx END)
              OVER (PARTITION BY doc_id ORDER BY idx)) % 2 = 1 AS consumed
  FROM candidates)"""

ANNOTATED = f"""{STATES},
sectioned AS (
  SELECT *, coalesce(
      last_value(CASE WHEN type = 'Title' AND NOT consumed THEN text END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY idx),
      CASE WHEN NOT bool_or(type = 'Title') OVER (PARTITION BY doc_id) THEN 'Document Content' END) AS section
  FROM consumption),
texts AS (
  SELECT *, is_checkbox AND NOT consumed AS answers,
    NOT consumed AND NOT is_checkbox AND type NOT IN ('Title','Image','Header') AND text <> ''
      AND text NOT IN ('Yes','No') AND section IS NOT NULL AS is_text
  FROM sectioned),
islands AS (
  SELECT *, coalesce(sum(answers::INT) OVER (PARTITION BY doc_id ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM texts),
annotated AS (
  SELECT *,
    last_value(CASE WHEN is_text AND (contains(text,'?') OR text LIKE '%:') THEN text END IGNORE NULLS)
      OVER (PARTITION BY doc_id, island ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending,
    coalesce(
      CASE WHEN idx-1 >= 1 AND (contains(back1,'?') OR back1 LIKE '%:') THEN back1 END,
      CASE WHEN idx-2 >= 1 AND (contains(back2,'?') OR back2 LIKE '%:') THEN back2 END,
      CASE WHEN idx-3 >= 1 AND (contains(back3,'?') OR back3 LIKE '%:') THEN back3 END,
      CASE WHEN idx-4 >= 1 AND (contains(back4,'?') OR back4 LIKE '%:') THEN back4 END,
      'Unknown question') AS looked_back
  FROM islands)"""

ITEMS = f"""{ANNOTATED},
labelled AS (
  SELECT *, CASE WHEN answers THEN 'checkbox' WHEN is_text THEN 'text'
      WHEN type = 'Title' THEN CASE WHEN text <> '' THEN 'text' END
      WHEN type = 'Image' THEN 'image'
      WHEN type = 'Header' AND text <> '' THEN 'text' END AS item
  FROM annotated WHERE NOT consumed AND section IS NOT NULL),
items AS (
  SELECT doc_id, source, idx, item AS type,
    CASE WHEN item = 'checkbox' THEN coalesce(pending, looked_back) END AS question,
    CASE WHEN item = 'text' THEN text END AS value_text,
    CASE WHEN item = 'checkbox' THEN CASE state WHEN 'checked_yes' THEN true WHEN 'checked_no' THEN false END
    END AS value_bool,
    section, page_number
  FROM labelled WHERE item IS NOT NULL)"""

# Items with a few headers and unknown kinds, and some markup-only texts.
TYPED = f"""{ITEMS},
typed AS (
  SELECT doc_id, idx,
    CASE WHEN idx % 11 = 5 THEN 'table' WHEN type = 'text' AND idx % 7 = 3 THEN 'header' ELSE type END AS type,
    question,
    CASE WHEN value_text IS NOT NULL AND idx % 5 = 2 THEN '<br> &nbsp;' ELSE value_text END AS value_text,
    value_bool, CASE WHEN idx % 9 = 4 THEN '<b></b>' ELSE section END AS section, page_number
  FROM items)"""


def strip_html(x: str) -> str:
    out = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for name in ("script", "style", "template"):
        out = f"regexp_replace({out}, '<{name}\\b[^>]*>.*?</{name}\\s*>', ' ', 'gsi')"
    tag = "</?[A-Za-z!?](?:[^<>\"'']|\"[^\"]*\"|''[^'']*'')*>"
    out = f"regexp_replace({out}, '{tag}', ' ', 'g')"
    entities = [
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"),
        ("&middot;", "·"), ("&amp;", "&"),
    ]
    for entity, char in entities:
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def strip_controls(x: str) -> str:
    return f"regexp_replace({x}, '[\\x00-\\x1F\\x7F-\\x{{9F}}]', '', 'g')"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse_ws(strip_controls(f"nfc_normalize({strip_html(x)})"))


VOCAB = f"""
tokens AS (
  SELECT doc_id, source, unnest(range(len(w))) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, source, {words("text")} AS w FROM documents)),
vocab AS (
  SELECT word, n, 3 + row_number() OVER (ORDER BY n DESC, md5(word), word) AS token_id
  FROM (SELECT word, count(*) AS n FROM tokens GROUP BY word))"""

ENCODED = f"""{VOCAB},
encoded AS (
  SELECT d.doc_id, d.source, [2::BIGINT] || coalesce(i.ids, []::BIGINT[]) || [1::BIGINT] AS ids
  FROM documents d LEFT JOIN (
    SELECT doc_id, list(token_id ORDER BY pos) AS ids FROM tokens JOIN vocab USING (word) GROUP BY doc_id
  ) i ON d.doc_id = i.doc_id)"""

FIXED_CHUNKS = """
fixed AS (
  SELECT doc_id, source, chunk, substring(text, chunk * 1700 + 1, 2000) AS document
  FROM (SELECT doc_id, source, text,
          unnest(range(greatest(CAST(ceil((length(text) - 300) / 1700.0) AS BIGINT), 1))) AS chunk
        FROM documents WHERE length(text) > 0))"""

# The splitter on texts whose lines are cut at spaces when they are too long. A run
# is what is merged together: neighbouring short lines, or the words of a long line.
# The recursion goes from chunk to chunk of a run over the running piece lengths.
SPLIT_CHUNKS = f"""
cut AS (
  SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS s, contains(text, chr(10)) AS by_line
  FROM (SELECT doc_id, text, string_split(text, CASE WHEN contains(text, chr(10)) THEN chr(10) ELSE ' ' END) AS p
        FROM documents WHERE {strip("text")} <> '')),
lines AS (
  SELECT doc_id, line, CASE WHEN line > 0 THEN CASE WHEN by_line THEN chr(10) ELSE ' ' END ELSE '' END || s AS piece
  FROM cut),
runs AS (
  SELECT *, 2 * sum((length(piece) >= 2000)::INT) OVER (PARTITION BY doc_id ORDER BY line)
            - (length(piece) >= 2000)::INT AS run
  FROM lines WHERE piece <> ''),
worded AS (
  SELECT doc_id, run, line, 0 AS word, piece FROM runs WHERE length(piece) < 2000
  UNION ALL
  SELECT doc_id, run, line, word, CASE WHEN word > 0 THEN ' ' ELSE '' END || w
  FROM (SELECT doc_id, run, line, unnest(range(len(string_split(piece, ' ')))) AS word,
               unnest(string_split(piece, ' ')) AS w FROM runs WHERE length(piece) >= 2000)),
lengths AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, run ORDER BY line, word)::BIGINT AS upto
  FROM worded WHERE piece <> ''),
merged AS (
  SELECT doc_id, run, string_agg(piece, '' ORDER BY line, word) AS body, list(upto ORDER BY line, word) AS ends
  FROM lengths GROUP BY doc_id, run),
steps AS (
  SELECT doc_id, run, 1 AS k, 1 AS first, len(list_filter(ends, lambda x: x <= 2000)) AS last FROM merged
  UNION ALL
  SELECT doc_id, run, k + 1, first,
    len(list_filter(ends, lambda x: x <= (CASE WHEN first > 1 THEN ends[first - 1] ELSE 0 END) + 2000))
  FROM (
    SELECT s.doc_id, s.run, s.k, m.ends, greatest(s.first, 1 + len(list_filter([0::BIGINT] || m.ends,
             lambda x: x < greatest(m.ends[s.last] - 300, m.ends[s.last + 1] - 2000)))) AS first
    FROM steps s JOIN merged m USING (doc_id, run) WHERE s.last < len(m.ends))),
chunks AS (
  SELECT s.doc_id, s.run, s.k, {strip("""substring(body, (CASE WHEN first > 1 THEN ends[first - 1] ELSE 0 END) + 1,
    ends[last] - (CASE WHEN first > 1 THEN ends[first - 1] ELSE 0 END))""")} AS document
  FROM steps s JOIN merged m USING (doc_id, run)),
numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, k) - 1 AS chunk, document
  FROM chunks WHERE document <> '')"""

PAIRS = """
pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS pair_id,
         'app' || (u.conv_id % 20) AS application_id, (u.conv_id // 20) % 5 + 1 AS question_id,
         u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
gold AS (
  SELECT 'app' || (item_id % 20) AS application_id, (item_id // 20) % 5 + 1 AS question_id,
         text AS answer, item_id, item_id // 100 AS ordinal FROM benchmark),
last_gold AS (
  SELECT application_id, question_id, answer AS gold, item_id
  FROM (SELECT *, max(ordinal) OVER (PARTITION BY application_id) AS last FROM gold) WHERE ordinal = last)"""

TFIDF = r"""
sides AS (
  SELECT pair_id, 'l' AS side, unnest(regexp_extract_all(lower(answer), '[\p{L}\p{N}_]{2,}')) AS token FROM judged
  WHERE gold IS NOT NULL
  UNION ALL
  SELECT pair_id, 'r', unnest(regexp_extract_all(lower(gold), '[\p{L}\p{N}_]{2,}')) FROM judged WHERE gold IS NOT NULL),
counted AS (
  SELECT pair_id, token, count(*) FILTER (side = 'l') AS a, count(*) FILTER (side = 'r') AS b
  FROM sides GROUP BY ALL),
weighed AS (
  SELECT pair_id, a * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5) + 1 END AS wa,
         b * CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5) + 1 END AS wb FROM counted),
cosines AS (
  SELECT pair_id, CASE WHEN sum(wa*wa) > 0 AND sum(wb*wb) > 0
      THEN sum(wa*wb) / (sqrt(sum(wa*wa)) * sqrt(sum(wb*wb))) ELSE 0 END AS similarity
  FROM weighed GROUP BY pair_id)"""

CENTROIDS = """
dims AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings),
centroids AS (
  SELECT label AS query_id, list(m ORDER BY dim) AS v
  FROM (SELECT label, dim, avg(x::DOUBLE) AS m FROM dims GROUP BY ALL) GROUP BY label),
vectors AS (SELECT vec_id AS chunk_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

HITS = f"""{CENTROIDS},
hits AS (
  SELECT * FROM (
    SELECT q.query_id, c.chunk_id, list_distance(q.v, c.v) ** 2 AS distance,
      row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(q.v, c.v), c.chunk_id) AS rank
    FROM centroids q JOIN vectors c ON c.label = q.query_id) WHERE rank <= 20),
scored AS (
  SELECT *, coalesce(CAST(nullif(regexp_extract(
      'Score: ' || substring(md5(query_id || ':' || chunk_id), 1, 3), '[0-9]'), '') AS INT), 0) AS score
  FROM hits)"""

RERANKED = f"""{HITS},
reranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rerank
                 FROM scored) WHERE rerank <= 10)"""

TRAIN_LOG = """
log AS (
  SELECT user_id AS run, ts, value AS loss,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS eval
  FROM events),
steps AS (SELECT run, ts, loss, eval, (eval * 2) // 3 AS step FROM log)"""
