"""DuckDB SQL for the queries that SQL can express.

op4 (tokenizer), op6 (sampled borders), op7 (flow and seeded selection), op9 (calibrated verdicts) and
op10 (forest) have none; tests hold them against plain Python or by what they promise (tests/llm/test_brute_force.py).
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(regexp_replace(text, '([<\[])(~*)(/?(?:s>|INST\]))', '\1~\2\3', 'g')) + length(role) + 1 + CASE WHEN role = 'assistant' THEN 9 ELSE 15 END AS n FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, max(turn) OVER (PARTITION BY conv_id) AS last FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR turn = last))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

OP2 = f"""
WITH b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS z FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, z, array_to_string(w[i:i + z - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM bi)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, z, array_to_string(w[i:i + z - 1], ' ') AS k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM bw))),
hit AS (SELECT doc_id, item_id, i, z FROM dw JOIN bw USING (z, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def jaccard(n: int, percent: int, docs: str = "documents") -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM {docs}),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
r AS (SELECT DISTINCT a AS doc, a AS r FROM l UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, c.low), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc, min(r) AS low FROM r GROUP BY doc) c ON c.doc = w.doc_id"""


OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM k WHERE s IN (SELECT s FROM k GROUP BY s HAVING count(*) > 1)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM t ANTI JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP8 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, p, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

SQL = {
    "op1_chat_format": OP1,
    "op2_decontaminate": OP2,
    "op3_ngram_jaccard": jaccard(4, 85),
    "op5_substring_dedup": OP5,
    "op8_line_dedup": OP8,
}
