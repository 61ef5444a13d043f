"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from quern.operators import bootstrap

#: events as sampled completions
ROLL = """roll AS (
  SELECT event_id AS ordinal, event_id, user_id, event_type, value, props, ts,
    user_id::VARCHAR || '-' || strftime(ts, '%Y-%m-%d') AS prompt_id,
    event_type IN ('purchase', 'signup') AS correct,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
    ['gsm8k', 'math', 'finchain'][(user_id % 3 + 1)::INT] AS source,
    (row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1)::BIGINT AS sample_index
  FROM events)"""

#: graded texts: `parsed` is what stands in the text, `gold_answer` what it is held against in its spelling, `gold_value` what that says
COMP = """comp AS (
  SELECT event_id AS example_id, event_type AS checkpoint, ['gsm8k', 'math', 'finchain'][(user_id % 3 + 1)::INT] AS source, value, user_id,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE printf('%.2f', value) END AS parsed,
    printf('%.3f', CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE value + 1 END) AS gold_value,
    [gold_value, replace(gold_value, '.', '') || 'e-3', gold_value || repeat('0', 40), '0_0' || gold_value, '+' || gold_value][(event_id % 5 + 1)::INT] AS gold_answer
  FROM events),
graded AS (SELECT *, parsed AS predicted, coalesce(parsed::DECIMAL(18, 3) = gold_value::DECIMAL(18, 3), false) AS correct FROM comp),
texts AS (
  SELECT *, CASE WHEN parsed IS NULL THEN 'no result'
    WHEN source = 'gsm8k' THEN 'first #### 1' || chr(10) || 'then' || chr(10) || '#### $' || parsed || '. done'
    WHEN source = 'math' THEN 'so $\\boxed{1}$ or \\boxed{' || parsed || '}$'
    ELSE 'Answer: 1' || chr(10) || 'Final Answer: $' || parsed || '% of all' END AS completion FROM graded),
chain AS (
  SELECT *, CASE WHEN parsed IS NULL THEN NULL WHEN source = 'math' OR source = 'finchain' OR source = 'gsm8k' THEN parsed END AS marked,
  coalesce(parsed::DECIMAL(18, 3) = gold_value::DECIMAL(18, 3), false) AS marked_ok FROM texts)"""

BUCKETS = """buckets AS (
  SELECT *, CASE WHEN success_rate >= 0.8 THEN 'easy' WHEN success_rate <= 0.2 THEN 'hard' ELSE 'ambiguous' END AS bucket
  FROM (SELECT prompt_id, count(*) AS n, avg(reward) AS success_rate, min(ordinal) AS first_order FROM roll GROUP BY prompt_id))"""

SPLIT = """split AS (
  SELECT doc_id, source, lang, n_chars AS n_tokens, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || source || ':' || doc_id::VARCHAR), doc_id)
    <= greatest(round_even(count(*) OVER (PARTITION BY source) * 0.05::DOUBLE, 0), 1) AS is_val FROM documents)"""

LANG_SPLIT = """split AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || lang || ':' || doc_id::VARCHAR), doc_id)
    <= greatest(round_even(count(*) OVER (PARTITION BY lang) * 0.1::DOUBLE, 0), 1) AS is_val FROM documents)"""

SFT = """sft AS (
  SELECT conv_id, turn, text AS prompt, next_text AS response FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

#: next-fit packing of numbered documents of a batch: places, one document at a time
PACK = """packed AS (
  SELECT batch, k, o, 0::BIGINT AS row_no, 0::BIGINT AS start, n AS "end" FROM docs WHERE k = 1
  UNION ALL
  SELECT d.batch, d.k, d.o, p.row_no + (CASE WHEN p."end" > 0 AND p."end" + d.n + 1 > {max} THEN 1 ELSE 0 END),
    CASE WHEN p."end" = 0 OR p."end" + d.n + 1 > {max} THEN 0 ELSE p."end" + 1 END,
    d.n + CASE WHEN p."end" = 0 OR p."end" + d.n + 1 > {max} THEN 0 ELSE p."end" + 1 END
  FROM docs d JOIN packed p ON d.batch = p.batch AND d.k = p.k + 1)"""

DOC_PACK = "docs AS (SELECT doc_id // 8 AS batch, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS k, doc_id AS o, least(n_chars, 2048) AS n FROM documents), " + PACK.format(max=2048)
#: all documents of a language as one batch
LANG_PACK = "docs AS (SELECT coalesce(lang, '') AS batch, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS k, doc_id AS o, least(n_chars, 2048) AS n FROM documents), " + PACK.format(max=2048)
#: whole turns, cut only where they are longer than a row
TURN_PACK = (
    SFT + ", docs AS (SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn AS o,"
    " least(length(prompt), 2048) AS p, least(length(prompt) + length(response), 2048) AS n FROM sft), " + PACK.format(max=2048)
)

LOGP = """logp AS (
  SELECT vec_id, label, x[label + 1] - (m + ln(list_sum(list_transform(x, lambda v: exp(v - m))))) AS logp
  FROM (SELECT *, list_max(x) AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)))"""



def _bootstrap(table: str, by: str, value: str, row: str, rounds: int, seed: int) -> str:
    """Weights from two halves of a row's hash and the round, then quantiles of the rounds' means."""
    half = "('0x' || substr(md5('{seed}:' || {row}), {at}, 8))::UBIGINT"
    mix = "SELECT * EXCLUDE (x), xor(x, x >> 16) AS x FROM (SELECT * EXCLUDE (x), (xor(x, x >> 15) * {b}) % 4294967296 AS x FROM (SELECT * EXCLUDE (x), (xor(x, x >> 16) * {a}) % 4294967296 AS x FROM ({of})))"
    mixed = lambda of: mix.format(a=bootstrap.MIX[0], b=bootstrap.MIX[1], of=of)
    low = mixed(f"SELECT k, v, high, (low + r * {bootstrap.STEP}) % 4294967296 AS x FROM h, (SELECT unnest(range({rounds}))::UBIGINT AS r) WHERE v IS NOT NULL").replace("SELECT k, v, high,", "SELECT k, v, high, r,")
    both = mixed(f"SELECT k, v, r, xor(x, high) AS x FROM ({low})")
    drawn = " + ".join(f"(x >= {s})::INT" for s in bootstrap.steps())
    return f"""h AS (SELECT {by} AS k, {value}::DOUBLE AS v, {half.format(seed=seed, row=row, at=1)} AS high, {half.format(seed=seed, row=row, at=9)} AS low FROM {table}),
      w AS (SELECT k, v, r, {drawn} AS c FROM ({both})),
      m AS (SELECT k, r, sum(v * c) / sum(c) AS m FROM w GROUP BY k, r HAVING sum(c) > 0),
      q AS (SELECT k, list_sort(list(m)) AS ms FROM m GROUP BY k)
      SELECT a.k AS {by}, n, round(mean, 6) AS mean, round(ms[floor(len(ms) * 0.025)::INT + 1], 6) AS lo, round(ms[floor(len(ms) * 0.975)::INT + 1], 6) AS hi
      FROM (SELECT k, count(v) AS n, avg(v) AS mean FROM h GROUP BY k HAVING count(v) > 0) a LEFT JOIN q ON q.k IS NOT DISTINCT FROM a.k"""


#: the first pair numbers of each prompt that a Feistel network on two digits puts in front, those beyond the range permuted again
_TURN = "('0x' || substr(md5('42:' || prompt_id || ':{k}:' || {digit}), 1, 12))::BIGINT"
DRAWN = f"""side AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, correct ORDER BY sample_index) - 1 AS rank FROM roll),
  size AS (SELECT *, ceil(pairs / base)::BIGINT AS other FROM (SELECT *, ceil(sqrt(pairs))::BIGINT AS base FROM (SELECT prompt_id, i, c * i AS pairs FROM (SELECT prompt_id, count(*) FILTER (correct) AS c, count(*) FILTER (NOT correct) AS i FROM roll GROUP BY prompt_id) WHERE c > 0 AND i > 0))),
  walk AS (SELECT prompt_id, x, x AS y, 0 AS step FROM (SELECT prompt_id, unnest(range(least({{cap}}, pairs))) AS x FROM size)
    UNION ALL SELECT prompt_id, x, high * other + (low + {_TURN.format(k=3, digit="high")}) % other, step + 1 FROM (
      SELECT * EXCLUDE (high), (high + {_TURN.format(k=2, digit="low")}) % base AS high FROM (
      SELECT * EXCLUDE (low), (low + {_TURN.format(k=1, digit="high")}) % other AS low FROM (
      SELECT * EXCLUDE (high), (high + {_TURN.format(k=0, digit="low")}) % base AS high FROM (
      SELECT prompt_id, x, step, pairs, base, other, y // other AS high, y % other AS low FROM walk JOIN size USING (prompt_id) WHERE step = 0 OR y >= pairs))))),
  drawn AS (SELECT w.prompt_id, g.sample_index AS chosen_index, b.sample_index AS rejected_index FROM walk w JOIN size s ON s.prompt_id = w.prompt_id AND step > 0 AND y < pairs
    JOIN side g ON g.prompt_id = w.prompt_id AND g.correct AND g.rank = y // s.i JOIN side b ON b.prompt_id = w.prompt_id AND NOT b.correct AND b.rank = y % s.i)"""

#: chains as lists of (key, words), and the least cost of aligning them, a row of the whole table for each reference step
CHAINS = r"""line AS (SELECT l_orderkey AS id, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem),
  said AS (SELECT id, k, CASE WHEN id % 4 = 0 THEN -k ELSE k END AS turn, 2 AS side, 0 AS sub, CASE WHEN p % 7 = 1 THEN printf('%.2f', x) WHEN p % 11 = 2 THEN printf('%.1f', x + 1) ELSE printf('%.2f', x) END::DECIMAL(18, 2)::VARCHAR AS key,
      CASE WHEN p % 7 = 1 THEN 'so we get ' || printf('%.2f', x) || '0.' WHEN p % 11 = 2 THEN 'part ' || p || ' comes to ' || printf('%.1f', x + 1) ELSE 'part ' || p || ' comes to ' || printf('%.2f', x) END AS words, s FROM line WHERE p % 5 <> 0),
  chain AS (SELECT id, list([key, words] ORDER BY turn, sub) AS b FROM (SELECT id, turn, sub, key, words FROM said UNION ALL SELECT id, turn, 1, 'let us check that', 'let us check that' FROM said WHERE s % 6 = 0) GROUP BY id),
  gold AS (SELECT id, list([printf('%.2f', x)::DECIMAL(18, 2)::VARCHAR, 'part ' || p || ' comes to ' || printf('%.2f', x)] ORDER BY k) AS a FROM line GROUP BY id),
  two AS (SELECT id, a, coalesce(b, []) AS b, least(len(a), len(coalesce(b, []))) + 1 AS far FROM gold LEFT JOIN chain USING (id)),
  dp AS (SELECT id, a, b, far, 0 AS i, list_transform(range(len(b) + 1), lambda j: j * far) AS cost FROM two
    UNION ALL SELECT id, a, b, far, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, least(acc[j[1]] + far, cost[j[1] + 1] + far,
      CASE WHEN a[i + 1][1] = b[j[1]][1] THEN cost[j[1]] + (a[i + 1][2] <> b[j[1]][2])::INT ELSE 1000000 END)), [(i + 1) * far]) FROM dp WHERE i < len(a)),
  aligned AS (SELECT id AS chain_id, len(a) AS n_gold, len(b) AS n_response, (len(a) + len(b) - cost[-1] // far) // 2 AS matched, cost[-1] % far AS reworded FROM dp WHERE i = len(a))"""

ORACLES: dict[str, str] = {
    "chain_alignment": f"WITH RECURSIVE {CHAINS} SELECT chain_id, n_gold, n_response, matched, reworded, n_gold - matched AS missing, n_response - matched AS extra FROM aligned",
    "chain_step_report": f"""WITH RECURSIVE {CHAINS} SELECT chain_id % 4 = 0 AS reversed, count(*) AS chains, count(*) FILTER (n_gold = matched AND n_response = matched) AS complete, round(sum(matched) / sum(n_gold), 6) AS step_recall,
      round(sum(matched) / sum(n_response), 6) AS step_precision, sum(reworded)::BIGINT AS reworded, sum(n_gold - matched)::BIGINT AS missing, sum(n_response - matched)::BIGINT AS extra FROM aligned GROUP BY 1""",
    "grade_accuracy_by_source": f"""WITH {COMP} SELECT checkpoint, source, count(*) AS n, round(avg(correct::INT), 6) AS accuracy,
      round(avg((predicted IS NOT NULL)::INT), 6) AS parse_success_rate FROM graded GROUP BY checkpoint, source""",
    "grade_accuracy_rollup": f"""WITH {COMP} SELECT checkpoint, source, count(*) AS n, round(avg(correct::INT), 6) AS accuracy,
      round(avg((predicted IS NOT NULL)::INT), 6) AS parse_success_rate FROM graded GROUP BY ROLLUP (checkpoint, source)""",
    "finchain_grade_reasons": f"""WITH {COMP}, g AS (
      SELECT source, CASE WHEN parsed IS NULL THEN 'parse_failure' WHEN marked_ok THEN 'correct' ELSE 'answer_mismatch' END AS reason
      FROM chain) SELECT source, reason, count(*) AS n FROM g GROUP BY source, reason""",
    "grade_summary": f"""WITH {COMP} SELECT count(*)::DOUBLE AS n, round(avg((parsed IS NOT NULL)::INT), 6) AS parse_success_rate, round(avg(marked_ok::INT), 6) AS final_answer_accuracy FROM chain""",
    "answer_normalise": """SELECT event_id, form, CASE WHEN form < 2 THEN small WHEN form = 2 THEN '-' || big ELSE big || '%' END AS answer
      FROM (SELECT event_id, unnest([0, 1, 2, 3])::BIGINT AS form, printf('%.2f', value) AS small, printf('%.2f', value * 100) AS big FROM events)""",
    "hash_answers": f"""WITH {COMP} SELECT example_id, CASE WHEN source = 'gsm8k' THEN '$' || parsed END AS gold, CASE WHEN source = 'gsm8k' THEN parsed END AS generated, CASE WHEN source = 'gsm8k' THEN '$' || parsed ELSE parsed END AS loose FROM texts""",
    "math_boxed_extract": r"""SELECT event_id,
      CASE event_id % 5 WHEN 0 THEN '\frac{' || event_id || '}{' || user_id || '}' WHEN 1 THEN event_id::VARCHAR WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN ' $' || event_id || '$ ' END AS gold,
      CASE event_id % 5 WHEN 0 THEN '\frac{' || event_id || '}{' || user_id || '}' WHEN 1 THEN event_id::VARCHAR WHEN 3 THEN user_id::VARCHAR WHEN 4 THEN event_id::VARCHAR END AS generated
      FROM events""",
    "math_score_ladder": """SELECT event_id % 6 AS form, count(*) AS n, count(*) FILTER (event_id % 6 < 4 OR (event_id % 6 = 4 AND user_id % 2 <> 0)) AS n_correct,
      count(*) FILTER (event_id % 6 = 5) AS n_failed FROM events GROUP BY 1""",
    "latex_normal_forms": r"""SELECT p_partkey, form, CASE form WHEN 0 THEN '\frac{1}{2}+\sqrt{3}' || p_size WHEN 1 THEN '\frac{' || p_size || '}{7}' WHEN 2 THEN '0.5' || p_size
      WHEN 3 THEN p_size::VARCHAR WHEN 5 THEN '\frac{1}{2}' END AS answer, form = 4 AS fault FROM (SELECT p_partkey, p_size, unnest([0, 1, 2, 3, 4, 5])::BIGINT AS form FROM part)""",
    "decimal_scores": "SELECT event_id % 4 AS form, count(*) AS n, count(*) FILTER (event_id % 4 < 3) AS n_correct FROM events GROUP BY 1",
    "difficulty_category": """SELECT CASE WHEN p_size < 10 THEN CASE WHEN p_size % 8 BETWEEN 1 AND 5 THEN p_size % 8 END WHEN p_size < 20 THEN 3 WHEN p_size < 30 THEN 5 WHEN p_size < 40 THEN NULL
      ELSE CASE WHEN p_size % 7 BETWEEN 1 AND 5 THEN p_size % 7 END END::INT AS difficulty, replace(replace(lower(p_type || ' & ' || p_name), ' & ', '_and_'), ' ', '_') AS category, count(*) AS n FROM part GROUP BY ALL""",
    "difficulty_levels": """SELECT CASE WHEN p_partkey % 9 <> 0 AND p_size % 8 BETWEEN 1 AND 5 THEN p_size % 8 END::INT AS difficulty, p_partkey % 9 <> 0 AND NOT p_size % 8 BETWEEN 1 AND 5 AS fault, count(*) AS n FROM part GROUP BY ALL""",
    "accepted_examples": """WITH r AS (SELECT CASE WHEN doc_id % 11 = 2 OR coalesce(text, '') = '' THEN 'prompt_empty' WHEN doc_id % 11 IN (1, 3) THEN 'response_empty' WHEN doc_id % 11 = 4 THEN 'difficulty_range' ELSE 'accepted' END AS state FROM documents)
      SELECT state, count(*) AS n FROM r GROUP BY state UNION ALL SELECT 'written', count(*) FROM r WHERE state = 'accepted'""",
    "reject_reasons": """WITH r AS (SELECT CASE WHEN doc_id % 11 = 2 OR coalesce(text, '') = '' THEN 'prompt_empty' WHEN doc_id % 11 IN (1, 3) THEN 'response_empty' WHEN doc_id % 11 = 4 THEN 'difficulty_range' END AS reason FROM documents)
      SELECT reason, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM r), 6) AS pct FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "math_skip_reasons": """WITH r AS (SELECT CASE event_id % 9 WHEN 0 THEN 'parse_failure' WHEN 1 THEN 'empty_answer' WHEN 2 THEN 'difficulty_failure' WHEN 3 THEN 'validation_failure' END AS reason FROM events)
      SELECT reason, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM r), 6) AS pct FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "source_examples": f"""WITH {COMP} SELECT 'finchain-train-' || example_id AS id, CASE WHEN source = 'math' THEN 'p' || user_id ELSE 'q' || example_id END AS prompt,
      CASE WHEN source = 'gsm8k' THEN gold_answer ELSE parsed END AS final_answer, 3::INT AS difficulty, checkpoint AS category, NULL::VARCHAR AS domain,
      CASE WHEN source <> 'gsm8k' AND parsed IS NULL THEN 'final_answer_empty' END AS reject_reason FROM chain""",
    "selected_sources": f"""WITH {COMP} SELECT CASE source WHEN 'math' THEN 0 ELSE 1 END::INT AS source_place, source, count(*) AS n, max(example_id) AS last_id FROM comp WHERE source <> 'finchain' GROUP BY ALL""",
    "source_budgets": f"WITH {ROLL} SELECT source, CASE source WHEN 'math' THEN 768 ELSE 256 END::BIGINT AS budget, count(*) AS n FROM roll GROUP BY ALL",
    "listed_counts": f"WITH {ROLL} SELECT s.source, count(r.source) AS n FROM (SELECT unnest(['gsm8k', 'math', 'finchain', 'other']) AS source) s LEFT JOIN roll r ON r.source = s.source GROUP BY s.source",
    "sample_exact_n": "SELECT doc_id, lang, n_chars AS n_tokens FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 50",
    "first_documents": "SELECT doc_id, lang, n_chars AS n_tokens FROM documents ORDER BY doc_id LIMIT 10",
    "document_at_place": "SELECT doc_id, n_chars AS n_tokens, 100::BIGINT AS ordinal FROM documents ORDER BY n_chars, doc_id LIMIT 1 OFFSET 100",
    "balanced_prompts": """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || lang || ':' || doc_id::VARCHAR), doc_id) AS k FROM documents WHERE lang IN ('en', 'de', 'fr', 'es'))
      WHERE k <= CASE WHEN lang IN ('en', 'de') THEN 13 ELSE 12 END""",
    "stratified_split": f"WITH {SPLIT} SELECT doc_id, source, is_val FROM split",
    "strided_shards": "SELECT doc_id % 4 AS rank, count(*) AS n, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1",
    "document_batches": "SELECT doc_id // 8 AS batch, (count(*) * max(n_chars))::BIGINT AS rectangular, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1",
    "retention_top_n": """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'note-' ELSE 'step-' END || o_orderkey AS path, o_totalprice FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey = 7
      OR o_orderkey IN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 ORDER BY o_orderkey DESC LIMIT 3)""",
    "latest_checkpoint": "SELECT 'step-' || max(o_orderkey) AS path FROM orders",
    "epoch_positions": """SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || doc_id), doc_id) - 1 AS place
      FROM documents, (SELECT unnest([0, 1])::BIGINT AS epoch)""",
    "completion_group_census": f"""WITH {ROLL}, g AS (SELECT prompt_id, count(*) FILTER (correct) AS c, count(*) AS n FROM roll GROUP BY prompt_id)
      SELECT count(*) AS prompts, count(*) FILTER (c > 0 AND c < n) AS pairable, count(*) FILTER (c = n) AS all_correct, count(*) FILTER (c = 0) AS all_incorrect, 0::BIGINT AS empty FROM g""",
    "completion_totals": f"""WITH {ROLL}, g AS (SELECT prompt_id, count(*) FILTER (correct) AS c, count(*) FILTER (NOT correct) AS i FROM roll GROUP BY prompt_id)
      SELECT sum(c)::BIGINT AS correct, sum(i)::BIGINT AS incorrect, sum(c * i)::BIGINT AS pairs FROM g""",
    "pair_yield_gate": f"""WITH {ROLL}, g AS (SELECT prompt_id, count(*) FILTER (correct) AS c, count(*) AS n FROM roll GROUP BY prompt_id),
      t AS (SELECT count(*) AS prompts, count(*) FILTER (c > 0 AND c < n) AS pairable, count(*) FILTER (c = n) AS all_correct, count(*) FILTER (c = 0) AS all_incorrect FROM g)
      SELECT *, 0::BIGINT AS empty, round(pairable / prompts, 6) AS pair_yield, pairable / prompts >= 0.3 AS passes FROM t""",
    "preference_pairs_all": f"WITH {ROLL} SELECT c.prompt_id, c.sample_index AS chosen_index, r.sample_index AS rejected_index FROM roll c JOIN roll r ON c.prompt_id = r.prompt_id AND c.correct AND NOT r.correct",
    "preference_pairs_capped": f"WITH RECURSIVE {ROLL}, {DRAWN.format(cap=2)} SELECT prompt_id, chosen_index, rejected_index FROM drawn",
    "preference_pair_texts": f"""WITH RECURSIVE {ROLL}, {DRAWN.format(cap=2)} SELECT d.prompt_id, chosen_index, rejected_index, '#### ' || printf('%.2f', c.value) AS chosen, '#### ' || printf('%.2f', r.value) AS rejected
      FROM drawn d JOIN roll c ON c.prompt_id = d.prompt_id AND c.sample_index = chosen_index JOIN roll r ON r.prompt_id = d.prompt_id AND r.sample_index = rejected_index""",
    "preference_pairs_ordered": f"""WITH {ROLL} SELECT c.prompt_id, c.sample_index AS chosen_index, r.sample_index AS rejected_index, row_number() OVER (ORDER BY c.prompt_id, c.sample_index, r.sample_index) - 1 AS ordinal
      FROM roll c JOIN roll r ON c.prompt_id = r.prompt_id AND c.correct AND NOT r.correct""",
    "user_pairs_drawn": f"""WITH RECURSIVE {ROLL.replace("roll AS", "raw AS")}, roll AS (SELECT user_id::VARCHAR AS prompt_id, correct, event_id AS sample_index FROM raw), {DRAWN.format(cap=50)}
      SELECT prompt_id::BIGINT AS user_id, chosen_index, rejected_index FROM drawn""",
    "one_to_one_pairs": f"""WITH {ROLL}, k AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, correct ORDER BY sample_index) AS rank FROM roll)
      SELECT c.prompt_id, c.rank, c.sample_index AS chosen_index, r.sample_index AS rejected_index FROM k c JOIN k r ON c.prompt_id = r.prompt_id AND c.rank = r.rank AND c.correct AND NOT r.correct""",
    "opd_best_worst": f"""WITH {ROLL}, g AS (SELECT prompt_id, arg_max(ordinal, row(reward, ordinal)) AS chosen_order, arg_min(ordinal, row(reward, ordinal)) AS rejected_order, max(reward) AS chosen_reward,
        min(reward) AS rejected_reward, avg(reward) AS rate, min(ordinal) AS first_order, count(*) AS n FROM roll GROUP BY prompt_id HAVING count(*) >= 2 AND max(reward) - min(reward) > 0),
      b AS (SELECT *, CASE WHEN rate >= 0.8 THEN 'easy' WHEN rate <= 0.2 THEN 'hard' ELSE 'ambiguous' END AS bucket FROM g)
      SELECT prompt_id, chosen_order, rejected_order, chosen_reward, rejected_reward, chosen_reward - rejected_reward AS margin, round(rate, 6) AS success_rate, bucket,
        CASE bucket WHEN 'easy' THEN 0.25::DOUBLE WHEN 'hard' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, first_order FROM b""",
    "opd_value_margin": f"""WITH {ROLL} SELECT prompt_id, arg_max(ordinal, row(value, ordinal)) AS chosen_order, arg_min(ordinal, row(value, ordinal)) AS rejected_order, round(max(value) - min(value), 6) AS margin
      FROM roll GROUP BY prompt_id HAVING count(*) >= 2 AND max(value) - min(value) > 50""",
    "dpo_examples": f"""WITH {ROLL}, g AS (SELECT prompt_id, max(reward) AS chosen_reward, avg(reward) AS rate FROM roll GROUP BY prompt_id HAVING count(*) >= 2 AND max(reward) > min(reward))
      SELECT prompt_id, chosen_reward, CASE WHEN rate >= 0.8 THEN '0.25' WHEN rate <= 0.2 THEN '0.5' ELSE '1.0' END AS weight, 'one' AS run, 3::BIGINT AS n_metadata FROM g""",
    "rollout_buckets": f"""WITH {ROLL}, {BUCKETS} SELECT bucket, CASE bucket WHEN 'ambiguous' THEN 12 ELSE 0 END::BIGINT AS extra, CASE bucket WHEN 'easy' THEN 0.25::DOUBLE WHEN 'hard' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      count(*) AS prompts, sum(n)::BIGINT AS samples FROM buckets GROUP BY bucket""",
    "resample_plan": f"WITH {ROLL}, {BUCKETS} SELECT prompt_id, unnest(range(n, n + 12)) AS sample_index FROM buckets WHERE bucket = 'ambiguous'",
    "grpo_advantages": f"""WITH {ROLL}, s AS (SELECT *, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS sd, count(*) OVER w AS n FROM roll WINDOW w AS (PARTITION BY prompt_id))
      SELECT ordinal, prompt_id, round(CASE WHEN sd > 1e-8 THEN (reward - m) / greatest(sd, 1e-8) ELSE 0 END, 6) AS advantage FROM s WHERE n >= 2""",
    "grpo_centred": f"""WITH {ROLL}, s AS (SELECT *, avg(reward) OVER w AS m, count(*) OVER w AS n FROM roll WINDOW w AS (PARTITION BY prompt_id)) SELECT ordinal, round(reward - m, 6) AS advantage FROM s WHERE n >= 2""",
    "first_appearance_order": f"WITH {ROLL} SELECT prompt_id, min(ordinal) AS first_order FROM roll GROUP BY prompt_id",
    "sample_expansion": "SELECT lang, sample_index, count(*) AS n FROM (SELECT lang, unnest([0, 1, 2, 3])::BIGINT AS sample_index FROM documents) GROUP BY ALL",
    "checkpoint_source_grid": f"WITH {COMP} SELECT * FROM (SELECT DISTINCT checkpoint FROM comp) CROSS JOIN (SELECT DISTINCT source FROM comp)",
    "zip_generations": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "attach_reference_scores": "SELECT event_type, round(sum(-value / 100), 6) AS total FROM events GROUP BY event_type",
    "train_without_benchmark": """SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 50 <> 0 AND text IS NOT NULL AND lower(trim(text, ' ')) NOT IN (SELECT lower(trim(text, ' ')) FROM benchmark WHERE text IS NOT NULL)""",
    "split_membership": f"WITH {LANG_SPLIT} SELECT lang, count(*) AS n, CASE WHEN is_val THEN 'val' ELSE 'train' END AS part FROM split GROUP BY ALL",
    "cache_misses": f"WITH {ROLL} SELECT DISTINCT prompt_id, event_type FROM roll WHERE length(prompt_id) % 2 <> 0",
    "bucketed_cache_misses": f"WITH {ROLL} SELECT DISTINCT prompt_id, event_type, 1::BIGINT AS round FROM roll WHERE length(prompt_id) % 2 <> 0",
    "reused_summary": f"WITH {COMP} SELECT DISTINCT checkpoint, source, CASE WHEN source = 'math' THEN 'missing' ELSE 'reused' END AS state FROM comp",
    "split_coverage": "SELECT 0::BIGINT AS in_both, 0::BIGINT AS in_none, 0::BIGINT AS from_elsewhere",
    "generated_completions": f"WITH {SFT} SELECT conv_id, turn, unnest([0, 1, 2, 3])::BIGINT AS sample_index, length(prompt)::VARCHAR AS answer FROM sft",
    "custom_tokenizer": f"WITH {SFT} SELECT conv_id, turn, len(string_split(prompt, ' ')) AS n, length(replace(prompt, ' ', '')) AS total FROM sft",
    "method_comparison": f"""WITH {COMP} SELECT checkpoint, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg((parsed IS NOT NULL)::INT), 6) AS parse_success_rate, sum(length(completion))::BIGINT AS tokens,
      round(sum(value / 100), 6) AS sec, round(sum(value / 100) / 3600 * 0.44, 6) AS cost FROM texts GROUP BY checkpoint""",
    "length_stats_all": "SELECT count(*) AS count, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS p50, list_sort(list(n_chars))[(floor(count(*) * 0.95::DOUBLE) + 1)::INT] AS p95, max(n_chars) AS max FROM documents",
    "value_places": """SELECT o_orderpriority, count(*) AS count, x[1] AS least, x[(floor(count(*) * 0.1::DOUBLE) + 1)::INT] AS p10, x[(count(*) // 2 + 1)::INT] AS p50, x[(floor(count(*) * 0.999::DOUBLE) + 1)::INT] AS p999, NULL::DOUBLE AS beyond
      FROM (SELECT o_orderpriority, unnest(x) AS y, x FROM (SELECT o_orderpriority, list_sort(list(sqrt(o_totalprice) - 250)) AS x FROM orders GROUP BY 1)) GROUP BY o_orderpriority, x""",
    "length_stats_by_lang": """SELECT lang, count(*) AS count, round(avg(n_chars), 6) AS mean, list_sort(list(n_chars))[(count(*) // 2 + 1)::INT] AS p50, list_sort(list(n_chars))[(floor(count(*) * 0.95::DOUBLE) + 1)::INT] AS p95, max(n_chars) AS max
      FROM documents GROUP BY lang""",
    "sft_length_stats": f"""WITH {SFT}, l AS (SELECT unnest(['prompt', 'response', 'total']) AS name, unnest([length(prompt), length(response), length(prompt) + length(response)]) AS v FROM sft)
      SELECT name, count(*) AS count, round(avg(v), 6) AS mean, list_sort(list(v))[(count(*) // 2 + 1)::INT] AS p50, list_sort(list(v))[(floor(count(*) * 0.95::DOUBLE) + 1)::INT] AS p95, max(v) AS max FROM l GROUP BY name""",
    "value_frequency": "SELECT nullif(event_type, 'error') AS category, count(*) AS n FROM events GROUP BY 1",
    "eval_summary": f"""WITH {COMP} SELECT checkpoint, source, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg((parsed IS NOT NULL)::INT), 6) AS parse_success_rate,
      sum(length(completion))::BIGINT AS generated_tokens_decoded, (count(*) * max(length(completion)))::BIGINT AS generated_tokens FROM texts GROUP BY checkpoint, source""",
    "run_cost": f"""WITH {COMP}, t AS (SELECT sum(length(completion))::BIGINT AS generated_tokens, sum(length(gold_answer))::BIGINT AS generated_tokens_decoded, sum(value / 100) AS sec FROM texts)
      SELECT generated_tokens, generated_tokens_decoded, round(sec, 6) AS generation_sec, round(generated_tokens / sec, 6) AS tokens_per_sec, 5400::DOUBLE AS elapsed_sec, 1.5::DOUBLE AS hours, 0.44::DOUBLE AS rate, 0.66::DOUBLE AS cost FROM t""",
    "run_estimate": """SELECT count(*) * 3 AS generations, (count(*) * 3 * 768)::BIGINT AS worst_tokens, round(count(*) * 3 * 768 / 100.0::DOUBLE / 3600, 6) AS hours FROM events""",
    "loss_pivot": f"""WITH {ROLL} SELECT event_type AS arm, round(avg(value) FILTER (source = 'gsm8k'), 6) AS gsm8k, round(avg(value) FILTER (source = 'math'), 6) AS math, round(avg(value) FILTER (source = 'finchain'), 6) AS finchain FROM roll GROUP BY event_type""",
    "trajectory_with_base": f"""WITH {COMP} SELECT checkpoint || '-only' AS arm, user_id % 4 * 500 AS step, source, round(avg(value), 6) AS loss FROM comp GROUP BY ALL
      UNION ALL SELECT 'base', 0, source, round(avg(value), 6) FROM comp GROUP BY source""",
    "lr_schedule": "SELECT event_id, step, round(CASE WHEN step < 200 THEN step / 200.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * (step - 200) / 1800)) END, 6) AS scale FROM (SELECT event_id, event_id % 2001 AS step FROM events)",
    "count_window_throughput": """SELECT event_id // 10 AS "window", sum(CASE WHEN event_type <> 'error' THEN length(props) ELSE 0 END)::BIGINT AS tokens, round(sum(value / 100), 6) AS seconds,
      round(sum(CASE WHEN event_type <> 'error' THEN length(props) ELSE 0 END) / sum(value / 100), 6) AS per_sec FROM events GROUP BY 1 HAVING count(*) = 10""",
    "metadata_json": "SELECT event_id, props->>'$.k' AS k, props->>'$.none' AS \"none\" FROM events",
    "failure_table": f"""WITH {COMP} SELECT source, checkpoint, example_id % 10 AS day, count(*) AS n, count(*) FILTER (NOT correct) AS failures, round(avg(correct::INT), 6) AS accuracy FROM graded GROUP BY ALL""",
    "gold_self_check": f"WITH {COMP} SELECT source, count(*) AS n, count(*) AS verified, 0::BIGINT AS corrupt_verified FROM comp GROUP BY source",
    "pass_at_k": f"""WITH {ROLL}, g AS (SELECT count(*) AS n, count(*) FILTER (correct) AS c FROM roll GROUP BY prompt_id HAVING count(*) >= 3)
      SELECT count(*) AS prompts, round(avg(1 - greatest(n - c, 0) / n::DOUBLE * greatest(n - c - 1, 0) / (n - 1)::DOUBLE * greatest(n - c - 2, 0) / (n - 2)::DOUBLE), 6) AS pass_at_k FROM g""",
    "bootstrap_ci": f"WITH {ROLL}, {_bootstrap('roll', 'source', 'reward', 'ordinal', 200, 42)}",
    "bootstrap_user_values": f"WITH {_bootstrap('events', 'user_id', 'sqrt(abs(value))', 'event_id', 40, 7)}",
    "cost_per_accuracy_point": f"WITH {COMP}, a AS (SELECT checkpoint, avg(correct::INT) AS x FROM graded GROUP BY checkpoint) SELECT checkpoint, round(CASE WHEN x > 0.1 THEN 3.5 / ((x - 0.1) * 100) END, 6) AS per_point FROM a",
    "pack_languages": f'WITH RECURSIVE {LANG_PACK} SELECT batch, o AS doc_id, row_no, start, "end" FROM packed',
    "pack_documents": f'WITH RECURSIVE {DOC_PACK} SELECT batch, o AS doc_id, row_no, start, "end" FROM packed',
    "packed_row_stats": f"""WITH RECURSIVE {DOC_PACK}, r AS (SELECT batch, row_no, max("end") AS used, count(*) AS docs FROM packed GROUP BY batch, row_no)
      SELECT batch, count(*) AS rows, (count(*) * max(used))::BIGINT AS rectangular, sum(used)::BIGINT AS tokens, max(docs) AS most_docs FROM r GROUP BY batch""",
    "packed_rows": f"""WITH RECURSIVE {TURN_PACK}, r AS (SELECT x.batch, row_no, max("end") AS used, count(*) AS docs, sum(n - p) AS labels, sum(n * (n - 1) // 2) AS positions FROM packed x JOIN docs d ON x.batch = d.batch AND x.k = d.k GROUP BY x.batch, row_no)
      SELECT batch AS conv_id, row_no, max(used) OVER (PARTITION BY batch) AS width, docs, labels::BIGINT AS labels, used, positions::BIGINT AS positions FROM r""",
    "isolated_attention": f"""WITH RECURSIVE {TURN_PACK}, r AS (SELECT x.batch, row_no, max("end") AS used, sum(n * (n + 1) // 2) AS seen, sum(n) AS real FROM packed x JOIN docs d ON x.batch = d.batch AND x.k = d.k GROUP BY x.batch, row_no)
      SELECT batch AS conv_id, row_no, (seen + max(used) OVER (PARTITION BY batch) - real)::BIGINT AS visible FROM r""",
    "attention_intervals": f"""WITH RECURSIVE {TURN_PACK}, w AS (SELECT batch, max("end") AS width FROM packed GROUP BY batch),
      q AS (SELECT r.batch, row_no, unnest(range(width)) AS query FROM (SELECT DISTINCT batch, row_no FROM packed) r JOIN w ON w.batch = r.batch)
      SELECT q.batch AS conv_id, q.row_no, q.query, coalesce(p.start, q.query) AS first_key FROM q LEFT JOIN packed p ON p.batch = q.batch AND p.row_no = q.row_no AND p.start <= q.query AND p."end" > q.query""",
    "pad_and_mask": f"WITH {SFT} SELECT conv_id, turn, length(prompt) + length(response) + 5 AS width, length(response) AS useful FROM sft",
    "sft_serialise": f"""WITH {SFT}, s AS (SELECT conv_id, turn, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p, response || '<|im_end|>' || chr(10) AS r FROM sft)
      SELECT conv_id, turn, length(p) AS prompt_chars, length(p) + length(r) AS total_chars, md5(p || r) AS digest FROM s""",
    "encoded_pairs": f"""WITH {SFT}, s AS (SELECT conv_id, turn, length(prompt) AS p, least(2048, length(prompt) + length(response)) AS c, least(2048, length(prompt) + length(prompt)) AS r FROM sft),
      k AS (SELECT * FROM s WHERE c > p AND r > p AND c > 1 AND r > 1)
      SELECT conv_id, turn, max(greatest(c, r)) OVER (PARTITION BY conv_id // 8) AS width, c - p AS chosen_useful, r - p AS rejected_useful, max(greatest(c, r)) OVER (PARTITION BY conv_id // 8) AS rejected_width FROM k""",
    "parameter_bands": "SELECT CASE WHEN p_size % 3 = 0 OR p_size % 4 = 1 THEN 'no_decay' ELSE 'decay' END AS band, count(*) AS n FROM part GROUP BY 1",
    "token_logprob": f"WITH {LOGP} SELECT vec_id, round(logp, 6) AS logp FROM logp",
    "sequence_logprob": """WITH x AS (SELECT vec_id // 5 AS seq, list_transform(embedding, lambda v: v::DOUBLE) AS e,
        lead(CASE WHEN vec_id % 5 < 2 THEN NULL ELSE label END) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS next FROM embeddings), y AS (SELECT *, list_max(e) AS m FROM x WHERE next IS NOT NULL)
      SELECT seq, round(sum(e[next + 1] - (m + ln(list_sum(list_transform(e, lambda v: exp(v - m)))))), 6) AS logp, count(*) AS tokens FROM y GROUP BY seq""",
    "masked_ce": f"WITH {LOGP} SELECT vec_id % 6 AS part, round(coalesce(-avg(logp) FILTER (vec_id % 3 <> 0), 0), 6) AS loss, count(*) FILTER (vec_id % 3 <> 0) AS tokens FROM logp GROUP BY 1",
    "perplexity": f"WITH {LOGP} SELECT label::BIGINT AS label, round(avg(-logp), 6) AS loss, round(exp(avg(-logp)), 6) AS perplexity, count(*) AS tokens FROM logp GROUP BY label",
    "val_loss_two_ways": f"WITH {LOGP} SELECT round((SELECT avg(m) FROM (SELECT avg(-logp) AS m FROM logp GROUP BY vec_id // 7)), 6) AS batch_mean, round((SELECT avg(-logp) FROM logp), 6) AS token_mean",
    "dpo_loss": """WITH x AS (SELECT event_type, -value / 50 AS pc, -((value * 7) % 400.0::DOUBLE) / 50 AS pr, -value / 60 AS rc, -((value * 3) % 300.0::DOUBLE) / 60 AS rr FROM events),
      z AS (SELECT *, (pc - pr) - (rc - rr) AS margin FROM x), l AS (SELECT *, greatest(-0.2 * margin, 0) + ln(1 + exp(-abs(0.2 * margin))) AS loss FROM z)
      SELECT event_type, round(avg(loss), 6) AS loss, round(avg((margin > 0)::INT), 6) AS accuracy, round(avg(margin), 6) AS margin, round(avg(0.2 * (pc - rc)), 6) AS chosen_reward, round(avg(0.2 * (pr - rr)), 6) AS rejected_reward FROM l GROUP BY event_type""",
    "grpo_token_loss": f"""WITH {ROLL}, s AS (SELECT *, avg(reward) OVER w AS m, stddev_pop(reward) OVER w AS sd, count(*) OVER w AS n FROM roll WINDOW w AS (PARTITION BY prompt_id)),
      t AS (SELECT source, (event_type <> 'error')::INT AS k, CASE WHEN sd > 1e-8 THEN (reward - m) / sd ELSE 0 END AS a, -value / 300 AS p, -((value * 3) % 500.0::DOUBLE) / 400 AS o, -((value * 5) % 500.0::DOUBLE) / 350 AS f FROM s WHERE n >= 2),
      u AS (SELECT *, exp(p - o) AS r, exp(f - p) - (f - p) - 1 AS kl FROM t), l AS (SELECT *, -(least(r * a, greatest(least(r, 1.2), 0.8) * a) - 0.05 * kl) AS loss FROM u)
      SELECT source, round(sum(loss * k) / sum(k), 6) AS loss, round(sum(kl * k) / sum(k), 6) AS kl, round(sum(r * k) / sum(k), 6) AS ratio, sum(k)::DOUBLE AS tokens FROM l GROUP BY source""",
    "stream_count_windows": """WITH k AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS w FROM events)
      SELECT event_type, w::BIGINT AS "window", count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY event_type, w HAVING count(*) = 64""",
    "stream_first_requests": "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "stream_sessions": """WITH e AS (SELECT user_id::VARCHAR AS name, epoch_us(ts) // 1000 AS t, value FROM events),
      b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY name ORDER BY t) < 21600000 THEN 0 ELSE 1 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b)
      SELECT name, min(t) AS start, max(t) AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY name, k HAVING max(t) + 21600000 <= (SELECT max(t) FROM e) - 3600000""",
    "ledger_daily_window": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}

#: queries that write, read back and report; the SQL says what was to be written
ORACLES |= {
    "ordinal_examples": """SELECT 'gsm8k-train-' || (row_number() OVER (ORDER BY value, event_id) - 1) AS id, printf('%.2f', value) AS final_answer, row_number() OVER (ORDER BY value, event_id) - 1 AS ordinal FROM events""",
    "split_paths": "SELECT split, 'data/finchain/' || split || '.jsonl' AS path, count(*) AS n FROM (SELECT ['train', 'validation', 'test'][(doc_id % 3 + 1)::INT] AS split FROM documents) GROUP BY split",
    "pairs_jsonl": f"""WITH RECURSIVE {ROLL}, {DRAWN.format(cap=2)} SELECT d.prompt_id, c.source, 'größer ' || printf('%.2f', c.value) || ' 🙂' AS chosen, printf('%.2f', r.value) AS rejected, 0::BIGINT AS n_metadata
      FROM drawn d JOIN roll c ON c.prompt_id = d.prompt_id AND c.sample_index = chosen_index JOIN roll r ON r.prompt_id = d.prompt_id AND r.sample_index = rejected_index""",
    "jsonl_lines": "SELECT row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) - 1 AS line, event_type FROM events",
    "config_round_trip": """SELECT unnest(['data.sources: ["' || string_agg(DISTINCT lang, '", "' ORDER BY lang) || '"]', 'training.max_steps: ' || count(*) // 8, 'training.warmup_steps: 9']) AS line FROM documents""",
    "summary_round_trip": f"""WITH {COMP} SELECT form, checkpoint, source, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM texts, (SELECT unnest(['csv', 'json']) AS form) GROUP BY form, checkpoint, source""",
    "details_round_trip": f"""WITH {COMP} SELECT checkpoint, source, count(*) AS n, sum(length(completion))::BIGINT AS chars, count(parsed) AS predicted, count(*) FILTER (correct) AS n_correct FROM texts GROUP BY checkpoint, source""",
    "schema_drift": """SELECT part, name, drift, n FROM (SELECT event_id % 3 AS part, count(*) AS n FROM events GROUP BY 1)
      JOIN (SELECT unnest([1, 2, 2]) AS part, unnest(['value', 'user_id', 'reward']) AS name, unnest(['missing', 'retyped', 'extra']) AS drift) USING (part)""",
    "metric_history": "SELECT event_id AS _step, value AS loss FROM events WHERE event_type = 'click'",
    "metric_log": "SELECT event_type AS run, 'loss' AS name, 2 * count(*) AS n, round(2 * sum(value), 4) AS total FROM events GROUP BY event_type",
    "record_round_trip": """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
      SELECT unnest(['counts', 'note', 'rows']) AS key, unnest(['{' || string_agg('"' || event_type || '": ' || n, ', ' ORDER BY event_type) || '}', '{"é": null}', sum(n)::VARCHAR]) AS value FROM c""",
    "ledger_append": "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type",
    "safe_names": "SELECT name, regexp_full_match(name, '[A-Za-z0-9_.-]+') AS safe FROM (SELECT DISTINCT replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN '-' ELSE '/' END) AS name FROM part)",
    "cached_table": "SELECT lang, count(*) AS n, true AS hit FROM documents GROUP BY lang",
    "length_report": "SELECT lang, printf('%s: n=%d mean=%.1f p50=%d p95=%d max=%d', lang, count(*), avg(n_chars), list_sort(list(n_chars))[(count(*) // 2 + 1)::INT], list_sort(list(n_chars))[(floor(count(*) * 0.95::DOUBLE) + 1)::INT], max(n_chars)) AS line FROM documents GROUP BY lang",
    "verified_only": f"WITH {COMP} SELECT source, count(*) AS n, sum(example_id)::BIGINT AS ids FROM graded WHERE correct GROUP BY source",
    "finite_losses": "SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type",
    "required_rows": "SELECT count(*) AS n FROM events",
    "transfer_accuracy": f"WITH {COMP} SELECT 'transfer' AS source, count(*) AS n, round(avg((correct AND source = 'gsm8k')::INT), 6) AS accuracy, round(avg((parsed IS NOT NULL AND source = 'gsm8k')::INT), 6) AS parse_success_rate FROM graded",
    "cost_ledger": f"""WITH {COMP}, t AS (SELECT checkpoint, sum(length(completion))::BIGINT AS tokens, count(*) AS verifier_calls, sum(value / 100) / 3600 AS h, count(parsed) AS p, count(*) FILTER (correct) AS c FROM texts GROUP BY checkpoint)
      SELECT checkpoint, tokens, verifier_calls, round(h, 6) AS gpu_hours, round(h * 0.44, 6) AS dollars, round(p / verifier_calls, 6) AS parse_rate, round(c / verifier_calls, 6) AS accuracy,
        round(p / (h * 0.44), 6) AS parsed_per_dollar, round(c / (h * 0.44), 6) AS correct_per_dollar FROM t""",
    "overwritten_table": "SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
