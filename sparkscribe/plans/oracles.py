"""DuckDB SQL with the same results as the registered queries; None exists for those that fold sequentially or solve a system."""

from __future__ import annotations

from sparkscribe.functions.text import LIGATURES, TITLE_KEYWORDS
from sparkscribe.operators.bandit import POISSON
from sparkscribe.operators.concepts import ANCHOR
from sparkscribe.plans.inputs import REPLY_CONCEPTS, REPLY_RELATIONS, TEST_CUES, TEST_LEXICON, TEST_PHRASES

_WS = r"[\s\x0b\x1c-\x1f]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def normal_text(x: str) -> str:
    return f"lower({strip(rf"regexp_replace({x}, '{_WS}+', ' ', 'g')")})"


def slug(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"


def clean(x: str) -> str:
    t = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    for a, b in LIGATURES.items():
        t = f"replace({t}, '{a}', '{b}')"
    t = rf"regexp_replace({t}, '-\n([\p{{L}}\p{{N}}_])', '-\1', 'g')"
    t = rf"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: NOT regexp_full_match(x, '\d+'))"
    t = strip(f"regexp_replace(array_to_string({t}, chr(10)), '[ \\t]+', ' ', 'g')")
    return rf"array_to_string(list_transform(regexp_split_to_array({t}, '\n{{2,}}'), lambda p: replace(p, chr(10), ' ')), chr(10) || chr(10))"


def title(x: str) -> str:
    keys = " OR ".join(f"contains(lower({x}), '{k}')" for k in TITLE_KEYWORDS)
    return rf"({x} <> '' AND ({keys} OR (length({x}) < 80 AND NOT regexp_matches({x}, '[.!?;:]$') AND len(list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')) <= 8)))"


def words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"


def uniform(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"


def embedding(x: str, dim: int) -> str:
    raw = f"list_transform(range(0, {dim}), lambda j: (('0x' || substr(sha256((j // 8)::VARCHAR || ':' || {x}), (8 * (j % 8) + 1)::BIGINT, 8))::UBIGINT::DOUBLE / 4294967296.0 * 2 - 1)::FLOAT)"
    return raw


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


COS = "CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE d / (na * nb) END"

DOCS = "docs AS (SELECT doc_id, printf('doc_%07d', doc_id) AS chunk_id, source, text, length(text) AS chars, greatest(1, length(text) // 4) AS toks FROM documents)"

LEX = "lex AS (SELECT * FROM (VALUES {}) t(ord, kw, type, name))".format(", ".join(f"({i}, '{k}', '{t}', '{n}')" for i, (k, t, n) in enumerate(TEST_LEXICON)))
MENTIONS = f"""{DOCS}, {LEX},
hit AS (SELECT d.chunk_id, d.doc_id, {slug('l.type')} || '::' || {slug('l.name')} AS concept_id, l.name, l.type, l.kw AS aliases, 'Keyword match for ''' || l.kw || '''.' AS description, 0.7::DOUBLE AS confidence
        FROM docs d JOIN lex l ON contains(lower(d.text), l.kw)),
men AS (SELECT * FROM hit UNION ALL SELECT DISTINCT chunk_id, doc_id, 'concept::medical_imaging', '{ANCHOR[0]}', '{ANCHOR[1]}', '{ANCHOR[2]}', '{ANCHOR[3]}', {ANCHOR[4]}::DOUBLE FROM hit),
rel AS (SELECT concept_id || '|used_for|concept::medical_imaging|' || chunk_id AS relation_id, concept_id AS source_concept_id, 'used_for' AS relation, 'concept::medical_imaging' AS target_concept_id,
        0.6::DOUBLE AS confidence, 'Heuristic default relation.' AS evidence, chunk_id FROM hit WHERE type = 'modality')"""

EDGES = "edge AS (SELECT DISTINCT r.source_concept_id, s.name AS source_name, r.relation, r.target_concept_id, t.name AS target_name, r.confidence FROM rel r JOIN men s ON s.concept_id = r.source_concept_id JOIN men t ON t.concept_id = r.target_concept_id)"

EMB = f"qry AS (SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS query_no, text AS query FROM benchmark), {DOCS}"
HITS = f"""{EMB},
qraw AS (SELECT query_no, query, {embedding('query', 32)} AS r FROM qry), draw AS (SELECT *, {embedding('text', 32)} AS r FROM docs),
qv AS (SELECT query_no, query, list_transform(r, lambda x: (x::DOUBLE / sqrt({dot('r', 'r')}))::FLOAT) AS v FROM qraw),
dv AS (SELECT doc_id, list_transform(r, lambda x: (x::DOUBLE / sqrt({dot('r', 'r')}))::FLOAT) AS v FROM draw),
qn AS (SELECT *, sqrt({dot('v', 'v')}) AS nb FROM qv), dn AS (SELECT *, sqrt({dot('v', 'v')}) AS na FROM dv),
sc AS (SELECT q.query_no, q.query, d.doc_id, {dot('d.v', 'q.v')} AS d, na, nb FROM qn q, dn d),
hit AS (SELECT query_no, query, doc_id, {COS} AS score, row_number() OVER (PARTITION BY query_no ORDER BY {COS} DESC, doc_id)::INT AS rank FROM sc QUALIFY rank <= 10)"""
ARMS = f"""{HITS},
arm AS (SELECT h.query_no, h.query, h.rank, d.chunk_id, h.score AS f1, 1.0::DOUBLE / h.rank AS f2, least(1.0, d.chars / 3000.0)::DOUBLE AS f3, least(1.0, d.toks / 800.0)::DOUBLE AS f4,
        len(list_intersect({words('h.query')}, {words('substr(d.text, 1, 800)')}))::DOUBLE / greatest(1, len({words('h.query')})) AS f5, d.text FROM hit h JOIN docs d USING (doc_id))"""
EVENTS = f"""{ARMS},
rnd AS (SELECT range::INT AS round, (range % (SELECT count(*) FROM qry))::INT AS query_no FROM range(200)),
n AS (SELECT query_no, count(*) AS k, arg_max(rank, (f1, -rank)) - 1 AS best FROM arm GROUP BY query_no),
pick AS (SELECT r.round, r.query_no, n.k, n.best::INT AS best, CASE WHEN {uniform("'42'", 'r.round::VARCHAR', "'explore'")} < 0.2 THEN floor({uniform("'42'", 'r.round::VARCHAR', "'arm'")} * n.k)::INT ELSE n.best::INT END AS arm_index FROM rnd r JOIN n USING (query_no)),
ev AS (SELECT sha256('42:' || p.round) AS event_id, p.round, p.query_no, p.k, p.best, p.arm_index, CASE WHEN p.arm_index = p.best THEN 0.8 ELSE 0 END::DOUBLE + 0.2::DOUBLE / p.k AS propensity, a.chunk_id, a.f1, a.f2, a.f3, a.f4, a.f5,
       greatest(0.0, least(1.0, least(1.0, len(list_intersect({words('a.query')}, {words('substr(a.text, 1, 1500)')}))::DOUBLE / greatest(1, len({words('a.query')})))
         + sqrt(-2 * ln(greatest({uniform("'42'", 'p.round::VARCHAR', "'u'")}, 1e-12))) * cos(2 * 3.141592653589793 * {uniform("'42'", 'p.round::VARCHAR', "'v'")}) * 0.05))::DOUBLE AS reward
       FROM pick p JOIN arm a ON a.query_no = p.query_no AND a.rank = p.arm_index + 1)"""
Q = "0.1 * f1 + 0.2 * f2 + 0.05 * f3 + 0.05 * f4 + 0.5 * f5"


def terms(q: str, more: str = "", others: str = "") -> str:
    return f"""{EVENTS}{more},
pol AS (SELECT 'retrieval' AS policy, ev.*, ev.best AS b FROM ev UNION ALL SELECT 'random', ev.*, floor({uniform("'42'", 'event_id', "'random'")} * k)::INT FROM ev{others}),
qh AS (SELECT query_no, rank - 1 AS i, {q} FROM {'arm, sol' if more else 'arm'}), qs AS (SELECT query_no, sum(q) AS s FROM qh GROUP BY query_no),
term AS (SELECT p.policy, p.round, p.reward, (CASE WHEN p.b = p.arm_index THEN 0.95 ELSE 0 END + 0.05 / p.k) / greatest(1e-8, p.propensity) AS weight, qs.s * 0.05 / p.k + x.q * 0.95 AS v_hat, l.q AS q_logged
         FROM pol p JOIN qs USING (query_no) JOIN qh x ON x.query_no = p.query_no AND x.i = p.b JOIN qh l ON l.query_no = p.query_no AND l.i = p.arm_index),
tm AS (SELECT *, v_hat + weight * (reward - q_logged) AS dr FROM term)"""


TERMS = terms(f"{Q} AS q")


def solved(source: str, n: int = 5) -> str:
    """From rows of f1 to f5 and reward: g5 with the weights w_i of a ridge of 1 and the inverse v_i_j of its matrix, by elimination."""
    cell = lambda i, j: f"m_{i}_{j}"
    start = [f"sum(f{i + 1} * f{j + 1}) + {float(i == j)} AS {cell(i, j)}" for i in range(n) for j in range(n)]
    start += [f"sum(f{i + 1} * reward) AS {cell(i, n)}" for i in range(n)] + [f"{float(i == j)}::DOUBLE AS {cell(i, n + 1 + j)}" for i in range(n) for j in range(n)]
    steps = [f"g0 AS (SELECT {', '.join(start)}, count(*) AS n_trained, avg(reward) AS mean_reward FROM {source})"]
    for k in range(n):
        rows = [f"{cell(k, j)} / {cell(k, k)} AS {cell(k, j)}" if i == k else f"{cell(i, j)} - {cell(i, k)} * {cell(k, j)} / {cell(k, k)} AS {cell(i, j)}" for i in range(n) for j in range(2 * n + 1)]
        steps.append(f"g{k + 1} AS (SELECT {', '.join(rows)}, n_trained, mean_reward FROM g{k})")
    names = [f"{cell(i, n)} AS w_{i}" for i in range(n)] + [f"{cell(i, n + 1 + j)} AS v_{i}_{j}" for i in range(n) for j in range(n)]
    return ", ".join([*steps, f"sol AS (SELECT {', '.join(names)}, n_trained, mean_reward FROM g{n})"])


WX = " + ".join(f"w_{i} * f{i + 1}" for i in range(5))
UCB = f"{WX} + sqrt(greatest(0, {' + '.join(f'v_{i}_{j} * f{i + 1} * f{j + 1}' for i in range(5) for j in range(5))}))"


BOOT = f"""dw AS (SELECT policy, b.range AS b, dr, {uniform("'59'", 'b.range::VARCHAR', 'round::VARCHAR')} AS u FROM tm, range(200) b),
bw AS (SELECT policy, b, dr, {' + '.join(f'(u > {c!r})::INT' for c in POISSON)} AS w FROM dw), bm AS (SELECT policy, b, sum(w * dr) / sum(w) AS m FROM bw GROUP BY ALL)"""

_EMB_TOP = f"""e AS (SELECT vec_id, label, embedding, sqrt({dot('embedding', 'embedding')}) AS n FROM embeddings),
s AS (SELECT q.vec_id AS qid, q.label AS own, v.vec_id AS vid, v.label, {dot('v.embedding', 'q.embedding')} / (v.n * q.n) AS score FROM e q, e v WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid)::INT AS rk FROM s)"""

_RAW = clean("replace(text, chr(10), chr(10) || chr(10))")
PAGES = f"pg AS (SELECT source AS source_name, doc_id AS page_num, {_RAW} AS clean_text FROM documents)"
#: Page numbers that repeat or are missing (0), sources that are missing.
ODD_PAGES = f"pg AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN source END AS source_name, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 50 ELSE 0 END AS page_num, {_RAW} AS clean_text FROM documents)"


def paras(pages: str) -> str:
    return f"""{pages},
pl AS (SELECT source_name, page_num, list_filter(list_transform(string_split(clean_text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ps, clean_text FROM pg),
par AS (SELECT source_name, page_num, unnest(range(0, len(ps)))::INT AS para_no, unnest(ps) AS para, clean_text FROM (SELECT * FROM pl ORDER BY source_name, page_num, clean_text))"""


def chunks(pages: str) -> str:
    opens = "f.fresh OR (f.len >= 600 AND (k.title OR f.len + 2 + k.size > 1800))"
    return f"""{paras(pages)},
kept AS (SELECT *, length(para) AS size, {title('para')} AS title, regexp_matches(para, '[.!?;]$') AS final, row_number() OVER (PARTITION BY source_name ORDER BY page_num, clean_text, copy, para_no) AS rn
         FROM (SELECT *, row_number() OVER (PARTITION BY source_name, page_num, clean_text, para_no) AS copy FROM par) WHERE length(clean_text) >= 80 OR {title('clean_text')}),
f AS (SELECT source_name, rn, 1 AS chunk_no, size AS len, false AS fresh FROM kept WHERE rn = 1
      UNION ALL
      SELECT k.source_name, k.rn, CASE WHEN {opens} THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN {opens} THEN k.size ELSE f.len + 2 + k.size END,
             CASE WHEN {opens} THEN false ELSE f.len + 2 + k.size >= 1200 AND k.final END
      FROM f JOIN kept k ON k.source_name IS NOT DISTINCT FROM f.source_name AND k.rn = f.rn + 1),
ch AS (SELECT f.source_name, f.chunk_no, min(page_num) AS page_start, max(page_num) AS page_end, string_agg(para, chr(10) || chr(10) ORDER BY f.rn) AS t
       FROM f JOIN kept k ON k.source_name IS NOT DISTINCT FROM f.source_name AND k.rn = f.rn GROUP BY ALL)"""


PARAS, CHUNKS = paras(PAGES), chunks(PAGES)

_HASH = normal_text("t")
VERSIONS = f"""v1 AS (SELECT printf('doc_%07d', doc_id) AS chunk_id, sha256({normal_text('text')}) AS h FROM documents WHERE doc_id % 7 <> 0),
v2 AS (SELECT printf('doc_%07d', doc_id) AS chunk_id, sha256({_HASH}) AS h FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' edited' WHEN doc_id % 5 = 0 THEN '  ' || replace(text, ' ', '   ') ELSE text END AS t FROM documents WHERE doc_id % 13 <> 0))"""

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
BM25 = f"""tok AS (SELECT doc_id, {TOK} AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT q.query_id, t.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt q JOIN tf t USING (term) JOIN df USING (term), tot GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sc QUALIFY rank <= 10)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


REPORT = f"""{terms(f'{WX} AS q', f", {solved('ev')}, ub AS (SELECT query_no, arg_max(rank, (u, -rank)) - 1 AS b FROM (SELECT query_no, rank, {UCB} AS u FROM arm, sol) GROUP BY query_no)", " UNION ALL SELECT 'linucb', ev.*, ub.b FROM ev JOIN ub USING (query_no)")}, {BOOT}"""
#: The report reads whole texts, the other queries of these events the first 800 and 1500 characters.
REPORT = REPORT.replace("substr(d.text, 1, 800)", "d.text").replace("substr(a.text, 1, 1500)", "a.text")

_ROUND = "s.round + 1"
_NOISE = f"sqrt(-2 * ln(greatest({uniform("'42'", f'({_ROUND})::VARCHAR', "'u'")}, 1e-12))) * cos(2 * 3.141592653589793 * {uniform("'42'", f'({_ROUND})::VARCHAR', "'v'")}) * 0.05"
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_TIMES = lambda m, x: f"list_transform({m}, lambda r: {_DOT('r', x)})"
#: The inverse matrix and the sums as lists, updated round by round (Sherman-Morrison).
FOLD = f"""{ARMS},
qa AS (SELECT query_no, list({{'x': [f1, f2, f3, f4, f5], 'base': least(1.0, len(list_intersect({words('query')}, {words('substr(text, 1, 1500)')}))::DOUBLE / greatest(1, len({words('query')})))}} ORDER BY rank) AS arms FROM arm GROUP BY query_no),
nq AS (SELECT count(*) AS nq FROM qry),
st AS (SELECT -1 AS round, -1 AS query_no, -1 AS arm_index, 0::DOUBLE AS propensity, 0::DOUBLE AS reward, list_transform(range(5), lambda i: list_transform(range(5), lambda j: (i = j)::INT::DOUBLE)) AS inv, [0.0, 0, 0, 0, 0]::DOUBLE[] AS b
  UNION ALL
  SELECT round, query_no, c - 1, CASE WHEN c = best THEN 0.8 ELSE 0 END::DOUBLE + 0.2::DOUBLE / k, rw,
         list_transform(list_zip(inv, y), lambda p: list_transform(list_zip(p[1], y), lambda t: t[1] - p[2] * t[2] / den)), list_transform(list_zip(b, x), lambda t: t[1] + rw * t[2])
  FROM (SELECT *, {_TIMES('inv', 'x')} AS y, 1 + {_DOT('x', _TIMES('inv', 'x'))} AS den
    FROM (SELECT *, arms[c].x AS x, greatest(0.0, least(1.0, arms[c].base + noise))::DOUBLE AS rw
      FROM (SELECT *, CASE WHEN eu < 0.2 THEN floor(av * k)::INT + 1 ELSE best END AS c
        FROM (SELECT *, list_position(u, list_max(u)) AS best
          FROM (SELECT {_ROUND} AS round, q.query_no, q.arms, len(q.arms) AS k, s.inv, s.b, {_NOISE} AS noise, {uniform("'42'", f'({_ROUND})::VARCHAR', "'explore'")} AS eu, {uniform("'42'", f'({_ROUND})::VARCHAR', "'arm'")} AS av,
                       list_transform(q.arms, lambda a: {_DOT('a.x', _TIMES('s.inv', 's.b'))} + sqrt(greatest(0, {_DOT('a.x', _TIMES('s.inv', 'a.x'))}))) AS u
                FROM st s, nq JOIN qa q ON true WHERE s.round < 199 AND q.query_no = (s.round + 1) % nq.nq))))))"""

_VALUES = lambda rows: ", ".join(repr(tuple(r)) for r in rows)
_SURE = lambda w: f"((doc_id * 7 + ord * 13 + length({w})) % 50) / 100.0::DOUBLE + 0.5::DOUBLE"
REPLIES = f"""{DOCS}, rw AS (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) >= 2) AS w FROM docs),
rc AS (SELECT chunk_id, ord, w[n + 1] AS name, CASE WHEN ord = 4 THEN 'task' ELSE ['method', 'concept', 'signal'][length(w[n + 1]) % 3 + 1] END AS type, [lower(w[n + 1]), w[n + 2]] AS als,
              CASE WHEN doc_id % 3 <> 0 AND w[n + 2] IS NOT NULL THEN 'About ' || w[n + 2] ELSE '' END AS description, {_SURE('w[n + 1]')} AS confidence FROM rw, (VALUES {_VALUES(REPLY_CONCEPTS)}) t(ord, n)),
rm AS (SELECT *, {slug('type')} || '::' || {slug('name')} AS concept_id FROM rc WHERE name IS NOT NULL AND confidence >= 0.6),
rn AS (SELECT chunk_id, lower(name) AS key, arg_max(concept_id, ord) AS id FROM rm GROUP BY ALL),
rr AS (SELECT chunk_id, ord, w[n + 1] AS s, ['depends_on', 'part_of', 'depends_on', 'likes'][doc_id % 4 + 1] AS relation, w[m + 1] AS t, concat_ws(' ', w[n + 1], w[m + 1], ord::VARCHAR) AS evidence, {_SURE('w[n + 1]')} AS confidence
       FROM rw, (VALUES {_VALUES(REPLY_RELATIONS)}) t(ord, n, m)),
rj AS (SELECT x.id || '|' || relation || '|' || y.id || '|' || r.chunk_id AS relation_id, x.id AS source_concept_id, relation, y.id AS target_concept_id, confidence, evidence, r.chunk_id,
              row_number() OVER (PARTITION BY x.id, relation, y.id, r.chunk_id ORDER BY confidence DESC, ord) AS best
       FROM rr r JOIN rn x ON x.chunk_id = r.chunk_id AND x.key = lower(s) JOIN rn y ON y.chunk_id = r.chunk_id AND y.key = lower(t) WHERE relation <> 'likes' AND confidence >= 0.6),
rel AS (SELECT * EXCLUDE (best) FROM rj WHERE best = 1),
ideas AS (SELECT concept_id, arg_min(name, (chunk_id, ord)) AS name, arg_min(type, (chunk_id, ord)) AS type, array_to_string(list_sort(list_distinct(list_filter(flatten(list(als)), lambda a: a IS NOT NULL))), ';') AS aliases,
              coalesce(arg_min(description, (chunk_id, ord)) FILTER (description <> ''), '') AS description, max(confidence) AS max_confidence, count(DISTINCT chunk_id)::INT AS n_mentions, min(chunk_id) AS first_chunk FROM rm GROUP BY concept_id),
ment AS (SELECT DISTINCT chunk_id, concept_id FROM rm),
edge AS (SELECT DISTINCT r.source_concept_id, s.name AS source_name, r.relation, r.target_concept_id, t.name AS target_name, r.confidence FROM rel r JOIN ideas s ON s.concept_id = r.source_concept_id JOIN ideas t ON t.concept_id = r.target_concept_id)"""
WALK = f"""{REPLIES}, dep AS (SELECT DISTINCT source_concept_id AS a, target_concept_id AS b FROM rel WHERE relation = 'depends_on'),
root AS (SELECT source_concept_id AS c FROM rel WHERE relation = 'depends_on' GROUP BY 1 HAVING count(*) >= 2),
walk AS (SELECT c AS start, c AS concept_id, 0 AS depth FROM root UNION SELECT start, b, depth + 1 FROM walk JOIN dep ON a = concept_id WHERE depth < 3),
nearest AS (SELECT start, concept_id, min(depth) AS depth FROM walk GROUP BY ALL)"""
CUED = rf"""{DOCS}, se AS (SELECT chunk_id, unnest(range(0, len(p)))::INT AS sentence, unnest(p) AS s FROM (SELECT chunk_id, regexp_split_to_array(lower(text), '[.!?

]') AS p FROM docs)),
sw AS (SELECT chunk_id, sentence, regexp_extract_all(s, '[\p{{L}}\p{{N}}]+') AS w FROM se),
sp AS (SELECT chunk_id, sentence, (i - 1)::INT AS start, (i - 1 + m)::INT AS stop, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sw), (VALUES (1), (2), (3), (4)) t(m) WHERE i + m - 1 <= len(w)),
co AS (SELECT chunk_id, sentence, start, stop, 'concept::' || {slug('n')} AS id FROM sp JOIN (VALUES {_VALUES(TEST_PHRASES)}) t(p, n) ON p = phrase),
cu AS (SELECT chunk_id, sentence, start, stop, relation FROM sp JOIN (VALUES {_VALUES(TEST_CUES)}) t(p, relation) ON p = phrase),
lo AS (SELECT cu.*, co.start AS s_start, co.id AS s_id FROM cu JOIN co ON co.chunk_id = cu.chunk_id AND co.sentence = cu.sentence AND co.stop <= cu.start QUALIFY row_number() OVER (PARTITION BY cu.chunk_id, cu.sentence, cu.start, cu.stop, relation ORDER BY co.stop DESC, co.start, co.id) = 1),
hi AS (SELECT cu.*, co.stop AS t_stop, co.id AS t_id FROM cu JOIN co ON co.chunk_id = cu.chunk_id AND co.sentence = cu.sentence AND co.start >= cu.stop QUALIFY row_number() OVER (PARTITION BY cu.chunk_id, cu.sentence, cu.start, cu.stop, relation ORDER BY co.start, co.stop DESC, co.id) = 1)"""
TFIDF = f"""tok AS (SELECT doc_id, {TOK} AS w FROM documents), nn AS (SELECT count(*) AS n FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nn), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS size FROM dw GROUP BY doc_id),
qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL), qw AS (SELECT query_id, term, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN df USING (term), nn),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS size FROM qw GROUP BY query_id),
sc AS (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (term) GROUP BY ALL),
ti AS (SELECT query_id, doc_id, dot / (qn.size * dn.size) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(dot / (qn.size * dn.size), 9) DESC, doc_id)::INT AS rank FROM sc JOIN qn USING (query_id) JOIN dn USING (doc_id) QUALIFY rank <= 10)"""
_EDGE = r"""ln AS (SELECT source, doc_id, text, i - 1 AS place, trim(l[i]) AS line FROM (SELECT source, doc_id, text, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
full_ AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY place) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY place DESC) AS z FROM ln WHERE line <> ''),
ed AS (SELECT * FROM full_ WHERE a <= 2 OR z <= 2), hv AS (SELECT source AS source_name, line, count(DISTINCT doc_id) AS n_pages FROM ed GROUP BY ALL HAVING n_pages >= 3)"""

ORACLES = {
    "vector_topk": _with(_EMB_TOP, "SELECT qid, rk, vid, round(score, 6) AS score FROM t WHERE rk <= 10"),
    "vector_topk_metadata": _with(_EMB_TOP, "SELECT t.qid, t.rk, t.vid, CASE WHEN d.doc_id IS NOT NULL THEN t.label END AS label, substr(d.text, 1, 350) AS preview FROM t LEFT JOIN documents d ON d.doc_id = t.vid WHERE rk <= 5"),
    "l2_normalized": f"SELECT vec_id, unnest(range(0, len(x)))::INT AS pos, unnest(list_transform(x, lambda y: round(y::DOUBLE / sqrt({dot('x', 'x')}), 6))) AS value FROM (SELECT vec_id, list_transform(embedding, lambda y: y::DOUBLE * 3) AS x FROM embeddings)",
    "hash_embeddings": f"WITH r AS (SELECT item_id, {embedding('text', 32)} AS r FROM benchmark) SELECT item_id, unnest(range(0, 32))::INT AS pos, unnest(list_transform(r, lambda x: round((x::DOUBLE / sqrt({dot('r', 'r')}))::FLOAT::DOUBLE, 6))) AS value FROM r",
    "content_hashes": f"SELECT doc_id, sha256({normal_text('text')}) AS hash FROM documents",
    "slug_ids": f"SELECT doc_id, {slug("source || ' ' || lang")} || '::' || {slug('text')} AS concept_id FROM documents",
    "token_sets": f"SELECT doc_id, len({words('text')})::INT AS n_tokens, sha256(array_to_string(list_sort({words('text')}), ' ')) AS tokens_sha FROM documents",
    "json_recovery": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events",
    "clean_pages": f"SELECT doc_id AS page_num, {clean('text')} AS clean_text, length({clean('text')})::INT AS char_count FROM documents WHERE doc_id >= 5",
    "page_filter": f"WITH p AS (SELECT doc_id AS page_num, {clean('text')} AS t FROM documents) SELECT page_num, t <> '' AND (length(t) >= 80 OR {title('t')}) AS keep, {title('t')} AS is_title FROM p",
    "paragraphs": _with(PARAS, "SELECT page_num, para_no, length(para)::INT AS size, greatest(1, length(para) // 4)::INT AS tokens FROM par"),
    "chunks": _with(CHUNKS, "SELECT source_name, printf('chunk_chunk_%04d', chunk_no) AS chunk_id, page_start, page_end, length(t)::INT AS char_count, greatest(1, length(t) // 4)::INT AS token_estimate, sha256(t) AS text_sha FROM ch", True),
    "chunks_repeated_pages": _with(chunks(ODD_PAGES), "SELECT source_name, printf('chunk_chunk_%04d', chunk_no) AS chunk_id, page_start, page_end, lead(printf('chunk_chunk_%04d', chunk_no)) OVER (PARTITION BY source_name ORDER BY chunk_no) AS next_chunk_id, sha256(t) AS text_sha FROM ch", True),
    "chunk_links": _with(CHUNKS, "SELECT source_name, printf('chunk_chunk_%04d', chunk_no) AS chunk_id, lag(printf('chunk_chunk_%04d', chunk_no)) OVER w AS prev_chunk_id, lead(printf('chunk_chunk_%04d', chunk_no)) OVER w AS next_chunk_id FROM ch WINDOW w AS (PARTITION BY source_name ORDER BY chunk_no)", True),
    "change_detection": _with(VERSIONS, "SELECT CASE WHEN v1.h = v2.h THEN 'unchanged' WHEN v1.h IS NOT NULL THEN 'changed' ELSE 'new' END AS status, count(*) AS n FROM v2 LEFT JOIN v1 USING (chunk_id) GROUP BY 1"),
    "upsert_result": _with(VERSIONS, "SELECT coalesce(v2.chunk_id, v1.chunk_id) AS chunk_id, coalesce(v2.h, v1.h) AS content_hash, CASE WHEN v2.h IS NULL OR v1.h = v2.h THEN 1 ELSE 2 END::INT AS version FROM v1 FULL JOIN v2 USING (chunk_id)"),
    "index_map": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_index, vec_id FROM embeddings",
    "concept_mentions": _with(MENTIONS, "SELECT chunk_id, concept_id, name, type, aliases, description, confidence FROM men"),
    "concept_aggregate": _with(MENTIONS, "SELECT concept_id, arg_min(name, chunk_id) AS name, arg_min(type, chunk_id) AS type, array_to_string(list_sort(list_distinct(list(aliases))), ';') AS aliases, arg_min(description, chunk_id) AS description, max(confidence) AS max_confidence, count(DISTINCT chunk_id)::INT AS n_mentions, min(chunk_id) AS first_chunk FROM men GROUP BY concept_id"),
    "relation_dedup": _with(MENTIONS, "SELECT * FROM rel"),
    "chunk_concept_map": _with(MENTIONS, "SELECT DISTINCT chunk_id, concept_id FROM men"),
    "extraction_log": """WITH d AS (SELECT doc_id % 10 AS m, m NOT IN (3, 5, 7, 8, 9) AS ok FROM documents)
SELECT CASE WHEN ok THEN 'ok' ELSE 'error' END AS status,
       CASE m WHEN 3 THEN 'unreadable reply' WHEN 9 THEN 'unreadable reply' WHEN 5 THEN 'unreadable confidence' WHEN 7 THEN 'concepts and relations must be lists' WHEN 8 THEN 'entries must be objects' END AS error,
       count(*) AS n, sum(CASE WHEN ok THEN 2 END)::BIGINT AS concepts, sum(CASE WHEN ok THEN 1 END)::BIGINT AS relations FROM d GROUP BY 1, 2""",
    "graph_stats": _with(MENTIONS, "SELECT (SELECT count(*) FROM docs) AS chunks, (SELECT count(DISTINCT concept_id) FROM men) AS concepts, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, concept_id FROM men)) AS mentions, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1) AS next_edges"),
    "graph_expand": _with(f"{MENTIONS}, {EDGES}", "SELECT m.chunk_id, row_number() OVER (PARTITION BY m.chunk_id ORDER BY e.source_concept_id, e.relation, e.target_concept_id, e.confidence)::INT AS edge_no, e.* FROM (SELECT DISTINCT chunk_id, concept_id FROM men) m JOIN edge e ON e.source_concept_id = m.concept_id QUALIFY edge_no <= 8"),
    "index_binding": _with(DOCS, "SELECT chunk_id, CASE WHEN r.doc_id IS NOT NULL THEN 'main' END AS index_name, r.n AS row_index, CASE WHEN r.doc_id IS NOT NULL THEN 384 END::INT AS embedding_dim FROM docs LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM docs) r USING (doc_id)"),
    "hybrid_retrieve": _with(
        f"{HITS}, {MENTIONS.replace(DOCS + ', ', '').replace('hit AS', 'khit AS').replace('FROM hit', 'FROM khit')}, {EDGES}",
        "SELECT h.query_no AS query_id, h.rank, d.chunk_id, round(h.score, 6) AS score, d.source AS source_name, d.doc_id::INT AS page_start, substr(d.text, 1, 350) AS chunk_preview, coalesce(mm.x, '') AS mentions, coalesce(rr.x, '') AS related FROM hit h JOIN docs d USING (doc_id) LEFT JOIN (SELECT chunk_id, string_agg(concept_id || '/' || name || '/' || type, ';' ORDER BY concept_id, name, type) AS x FROM (SELECT DISTINCT chunk_id, concept_id, name, type FROM men) GROUP BY chunk_id) mm ON mm.chunk_id = d.chunk_id LEFT JOIN (SELECT chunk_id, string_agg(source_concept_id || '/' || source_name || '/' || relation || '/' || target_concept_id || '/' || target_name, ';' ORDER BY n) AS x FROM (SELECT m.chunk_id, e.*, row_number() OVER (PARTITION BY m.chunk_id ORDER BY e.source_concept_id, e.relation, e.target_concept_id, e.confidence) AS n FROM (SELECT DISTINCT chunk_id, concept_id FROM men) m JOIN edge e ON e.source_concept_id = m.concept_id) WHERE n <= 8 GROUP BY chunk_id) rr ON rr.chunk_id = d.chunk_id WHERE h.rank <= 5",
    ),
    "arm_features": _with(ARMS, "SELECT query_no, rank, chunk_id, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) AS f3, round(f4, 6) AS f4, round(f5, 6) AS f5 FROM arm"),
    "greedy_choice": _with(ARMS, "SELECT query_no, (arg_max(rank, (f1, -rank)) - 1)::INT AS by_score, (arg_max(rank, (f5, -rank)) - 1)::INT AS by_overlap FROM arm GROUP BY query_no"),
    "replay_log": _with(EVENTS, "SELECT event_id, round, query_no, chunk_id, arm_index, round(propensity, 6) AS propensity, round(reward, 6) AS reward FROM ev"),
    "gram_matrix": _with(EVENTS, " UNION ALL ".join([f"SELECT 'a_{i}_{j}' AS entry, round(sum(f{i + 1} * f{j + 1}), 6) AS value FROM ev" for i in range(5) for j in range(i, 5)] + [f"SELECT 'b_{i}', round(sum(f{i + 1} * reward), 6) FROM ev" for i in range(5)])),
    "ope_ips_snips": _with(TERMS, "SELECT policy, round(sum(weight * reward) / count(*), 6) AS ips, round(sum(weight * reward) / greatest(1e-8, sum(weight)), 6) AS snips, count(*) AS n_events FROM tm GROUP BY policy"),
    "ope_dm_dr": _with(TERMS, "SELECT policy, round(avg(v_hat), 6) AS dm, round(avg(dr), 6) AS dr FROM tm GROUP BY policy"),
    "ope_bootstrap": _with(
        f"{TERMS}, {BOOT}",
        "SELECT policy, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bm GROUP BY policy",
    ),
    "ucb_scores": _with(f"{EVENTS}, {solved('ev')}", f"SELECT query_no, rank, round({UCB}, 6) AS ucb FROM arm, sol"),
    "ridge_weights": _with(f"{EVENTS}, {solved('ev')}", " UNION ALL ".join(f"SELECT 'w_{i}' AS entry, round(w_{i}, 6) AS value FROM sol" for i in range(5))),
    "linucb_training": _with(f"{EVENTS}, {solved('ev')}", f"SELECT 200::BIGINT AS seen, n_trained AS trained, (200 - n_trained)::BIGINT AS skipped, round(mean_reward, 6) AS mean_reward, {', '.join(f'round(w_{i}, 6) AS theta_{i}' for i in range(5))} FROM sol"),
    "ope_report": _with(
        REPORT,
        "SELECT policy, round(sum(weight * reward) / count(*), 6) AS ips, round(sum(weight * reward) / greatest(1e-8, sum(weight)), 6) AS snips, round(avg(v_hat), 6) AS dm, round(avg(dr), 6) AS dr, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n_events FROM tm JOIN (SELECT policy, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM bm GROUP BY policy) USING (policy) GROUP BY policy",
    ),
    "replay_linucb": _with(FOLD, "SELECT round::INT AS round, query_no, arm_index::INT AS arm_index, round(propensity, 6) AS propensity, round(reward, 6) AS reward FROM st WHERE round >= 0", True),
    "index_build": _with(HITS, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, printf('doc_%07d', doc_id) AS chunk_id, round(na, 6) AS vector_norm FROM dn"),
    "index_map_rows": _with(DOCS, "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, chunk_id, 'hash-v1' AS embedding_model, 32 AS embedding_dim, 'main' AS index_name FROM docs"),
    "vector_manifest": _with(VERSIONS, "SELECT count(*) AS chunks_total, count(*) FILTER (v1.h = v2.h) AS skipped, count(*) FILTER (v1.h IS DISTINCT FROM v2.h) AS recomputed, 'hash-v1' AS embedding_model FROM v2 LEFT JOIN v1 USING (chunk_id)"),
    "graph_manifest": _with(MENTIONS, "SELECT (SELECT count(*) FROM docs) AS chunks_processed, 0::BIGINT AS log_errors, (SELECT count(DISTINCT concept_id) FROM men) AS concepts_total, (SELECT count(*) FROM rel) AS relations_total, 'heuristic' AS backend"),
    "linked_count": "SELECT count(*) AS linked FROM documents",
    "chunk_quality": "SELECT source AS source_name, count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_chars, round(count(*) FILTER (length(text) BETWEEN 600 AND 1800) / count(*), 6) AS pct_in_range, count(*) FILTER (length(text) < 300 OR length(text) > 2200) AS n_outliers FROM documents GROUP BY source",
    "bm25_topk": _with(BM25, "SELECT query_id, rank, id AS doc_id, round(score, 6) AS score FROM bm"),
    "retrieval_metrics": _with(
        _EMB_TOP + ", tot AS (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY label), h AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rk) AS rank, t.label = own AS rel, total FROM t JOIN tot ON tot.label = t.own WHERE vid <> qid), p AS (SELECT qid, count(*) FILTER (rel) AS found, min(CASE WHEN rel THEN rank END) AS first, max(total) AS total FROM h WHERE rank <= 10 GROUP BY qid)",
        "SELECT 10 AS k, round(avg(found / 10), 6) AS precision, round(avg(found / greatest(1, total)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM p",
    ),
    "rank_fusion": _with(
        f"{HITS}, {BM25.replace('sc AS', 'bsc AS').replace('FROM sc', 'FROM bsc')}, bo AS (SELECT query_id, id, rank FROM bm UNION ALL SELECT query_no::BIGINT, doc_id, rank FROM hit), fu AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM bo GROUP BY ALL)",
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, id)::INT AS rank, id AS doc_id, round(rrf, 6) AS rrf FROM fu QUALIFY rank <= 10",
    ),
    "source_rollup": _with(BM25, "SELECT query_id, source, round(max(score), 6) AS best, round(sum(score), 6) AS total FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY ALL"),
    "vector_topk_pruned": _with(_EMB_TOP, "SELECT qid, rk, vid, round(score, 6) AS score FROM t WHERE rk <= 10"),
    "tfidf_topk": _with(TFIDF, "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ti"),
    "reply_concepts": _with(REPLIES, "SELECT * REPLACE (round(max_confidence, 6) AS max_confidence) FROM ideas"),
    "reply_relations": _with(REPLIES, "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM rel"),
    "reply_graph_stats": _with(REPLIES, "SELECT (SELECT count(*) FROM docs) AS chunks, (SELECT count(*) FROM ideas) AS concepts, (SELECT count(*) FROM ment) AS mentions, (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM docs a JOIN docs b ON b.doc_id = a.doc_id + 1) AS next_edges"),
    "reply_expand": _with(REPLIES, "SELECT m.chunk_id, row_number() OVER (PARTITION BY m.chunk_id ORDER BY e.source_concept_id, e.relation, e.target_concept_id, e.confidence)::INT AS edge_no, e.* REPLACE (round(e.confidence, 6) AS confidence) FROM ment m JOIN edge e ON e.source_concept_id = m.concept_id QUALIFY edge_no <= 8"),
    "learning_path": _with(WALK, "SELECT start, concept_id, depth::INT AS depth, row_number() OVER (PARTITION BY start ORDER BY depth DESC, concept_id)::INT AS step FROM nearest", True),
    "pattern_relations": _with(CUED, "SELECT chunk_id, sentence, start AS word_no, s_id AS source_concept_id, relation, t_id AS target_concept_id, array_to_string(w[s_start + 1:t_stop], ' ') AS evidence FROM lo JOIN hi USING (chunk_id, sentence, start, stop, relation) JOIN sw USING (chunk_id, sentence) WHERE s_id <> t_id"),
    "running_lines": _with(_EDGE, "SELECT * FROM hv"),
    "page_flags": _with(
        _EDGE + r""", gn AS (SELECT doc_id, list(place) AS gone FROM ed JOIN hv ON hv.line = ed.line AND source_name IS NOT DISTINCT FROM source GROUP BY doc_id),
bo AS (SELECT d.doc_id, coalesce(len(gone), 0)::INT AS removed, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)) AS body FROM documents d LEFT JOIN gn USING (doc_id))""",
        r"SELECT doc_id AS page_num, sha256(body) AS body_sha, removed, CASE WHEN body = '' THEN 0 ELSE round(length(regexp_replace(body, '[\p{L}\p{N}\s]+', '', 'g')) / length(body), 6) END::DOUBLE AS symbol_ratio, regexp_matches(body, '\p{N}') AND NOT regexp_matches(body, '\p{L}') AS numeric_only FROM bo",
    ),
    "corpus_report": "SELECT GROUPING_ID(source, lang, toxic)::INT AS level, source, lang, toxic, count(*) AS n_docs, sum(coalesce(length(text), 0))::BIGINT AS chars, max(coalesce(length(text), 0))::BIGINT AS longest FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id) GROUP BY CUBE (source, lang, toxic)",
    "as_of_events": "WITH c AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT event_id, CASE WHEN c.ts >= e.ts - INTERVAL 6 HOUR THEN click_id END AS click_id, CASE WHEN c.ts >= e.ts - INTERVAL 6 HOUR THEN round(click_value, 6) END AS click_value FROM events e ASOF LEFT JOIN c ON c.user_id = e.user_id AND e.ts >= c.ts",
    "sketch_report": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n_rows, true AS users_near, true AS quantiles_near FROM events GROUP BY event_type",
    "session_windows": "WITH o AS (SELECT user_id, ts, value, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS opens FROM events WHERE ts IS NOT NULL), s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS opened, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS closed, count(*) AS n, round(sum(coalesce(value, 0)), 6) AS total FROM s GROUP BY user_id, no",
    "policy_models": """
WITH e AS (SELECT event_type AS policy, [1.0::DOUBLE, value / 100, (props::JSON->>'$.k')::DOUBLE / 100, hour(ts) / 24.0::DOUBLE, (((user_id % 7) + 7) % 7) / 7.0::DOUBLE] AS x, value / (value + 50) AS r FROM events WHERE ts IS NOT NULL),
f AS (SELECT * FROM e WHERE r IS NOT NULL AND NOT list_contains(list_transform(x, lambda v: v IS NULL), true)),
ij AS (SELECT i, j, (row_number() OVER (ORDER BY i, j) - 1)::INT AS place FROM range(1, 6) a(i), range(1, 6) b(j) WHERE i <= j)
SELECT policy, count(*) AS n, place, round(sum(x[i] * x[j]), 6) AS value FROM f, ij GROUP BY policy, place
UNION ALL SELECT policy, count(*), (14 + i)::INT, round(sum(x[i] * r), 6) FROM f, range(1, 6) a(i) GROUP BY policy, i
""",
    "bad_json_lines": """
WITH l AS (SELECT event_id // 1000 AS block, event_id, CASE WHEN event_id % 97 = 0 THEN substr(props, 1, 4) WHEN event_id % 89 = 0 THEN ' ' ELSE props END AS line FROM events)
SELECT block, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY event_id, line) AS line_no FROM l) WHERE event_id % 97 = 0
""",
}
